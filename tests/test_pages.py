import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions import pixels as px
from hushframe.operators import blocks, boxes, raster
from hushframe.sources import files, models, ocr

NAME, CITY, STREET = "primary_subject_name", "city_district", "street_address"
ENTITIES = "page_id bigint, ent_idx int, category string, kind string, bbox struct<x0:int,y0:int,x1:int,y1:int>, l1 string, text string, score double"


def entities(spark, rows, page=1):
    return spark.createDataFrame([(page, i, c, "visual" if t is None else "text", b, "person", t, 0.9) for i, (c, b, t) in enumerate(rows)], ENTITIES)


def groups(spark, rows):
    return [(r["category"], tuple(r["bbox"]), r["text"]) for r in blocks.grouped(entities(spark, rows)).orderBy("group_idx").collect()]


def test_a_form(spark):
    """One page with all that makes or parts groups: lines, gaps, categories between, stacks, and what lies in a picture."""
    form = [
        (NAME, (318, 207, 361, 233), "Quill"), (STREET, (40, 400, 97, 424), "Unit"), (NAME, (247, 204, 310, 230), "Maren"), (CITY, (103, 400, 121, 424), "K"),
        (STREET, (128, 403, 190, 425), "Seven"), (CITY, (47, 431, 139, 455), "Lund"), (NAME, (420, 206, 470, 232), "Osei"), ("logo", (500, 10, 640, 120), None),
        (NAME, (520, 30, 600, 60), "inside"), (NAME, (610, 90, 720, 119), "outside"), (NAME, (247, 520, 330, 546), "Ivo"), (NAME, (322, 520, 390, 546), "Bly"),
    ]
    assert groups(spark, form) == [
        (NAME, (610, 90, 720, 119), "outside"),  # half of it or more would have to lie in the logo
        (NAME, (247, 204, 361, 233), "Maren Quill"),
        (NAME, (420, 206, 470, 232), "Osei"),  # 59 pixels on, over 1.5 of the line's 26
        (STREET, (40, 400, 190, 425), "Unit Seven"),  # the city between doesn't part them
        (CITY, (47, 400, 139, 455), "K Lund"),  # one under the other, with all of the narrower one in common
        (NAME, (247, 520, 330, 546), "Ivo"),
        (NAME, (322, 520, 390, 546), "Bly"),  # begins before the other ends
    ]
    assert groups(spark, [("signature", (3, 3, 44, 21), None)]) == []


def test_stacked_blocks():
    two = [[CITY, (0, 0, 100, 20), "a", [20]], [CITY, (10, 25, 90, 45), "b", [20]]]
    assert blocks.stack_blocks(two) == [[CITY, (0, 0, 100, 45), "a b", [20, 20]]]
    assert len(blocks.stack_blocks([two[0], [CITY, (10, 40, 90, 60), "b", [20]]])) == 2
    assert len(blocks.stack_blocks([two[0], [CITY, (90, 25, 190, 45), "b", [20]]])) == 2
    assert blocks.print_height([20, 20, 4], (0, 0, 1, 50)) == 20 and blocks.print_height([], (0, 3, 1, 50)) == 47


def test_label_order():
    assert blocks.label_rows([(50, 0, 60, 20), (0, 5, 10, 25), (0, 40, 10, 60)]) == [[1, 0], [2]]


def test_sizes_and_heights(spark):
    draw = random.Random(2)
    rows = [(p, g, (0, 0, 10, draw.randrange(5, 60)), [draw.randrange(4, 40) for _ in range(draw.randrange(6))]) for p in range(20) for g in range(draw.randrange(1, 6))]
    df = spark.createDataFrame(rows, "page_id bigint, group_idx int, bbox struct<x0:int,y0:int,x1:int,y1:int>, word_heights array<int>")
    got = {(r["page_id"], r["group_idx"]): (r["type_height"], r["em_size"]) for r in boxes.em_sizes(df).collect()}
    for page in range(20):
        own = [(g, blocks.print_height(h, b), len(h)) for p, g, b, h in rows if p == page]
        every = sorted(t for _, t, n in own for _ in range(max(1, n)))
        body = every[len(every) // 2]
        for g, t, _ in own:
            bucket = 0.8 if t / body < 0.55 else 1.6 if t / body > 1.5 else 1.0
            assert got[page, g] == (t, max(8, int(1.2 * bucket * body)))


def test_normal_boxes_and_redaction_boxes(spark):
    def norm(b, w=200, h=100):
        df = spark.createDataFrame([(b,)], "b struct<x0:int,y0:int,x1:int,y1:int>")
        return tuple(df.select(boxes.normalized(F.col("b"), F.lit(w), F.lit(h))).first()[0])

    assert norm((0, 0, 200, 100)) == (0, 0, 1000, 1000) and norm((50, 25, 100, 50)) == (250, 250, 500, 500) and norm((-3, 0, 205, 101)) == (0, 0, 1000, 1000)
    assert norm((1, 1, 3, 3), 2000, 2000) == (0, 0, 2, 2)  # halves to even
    pages = spark.createDataFrame([(1, 100, 50)], "page_id bigint, width int, height int")
    got = boxes.redaction_boxes(entities(spark, [(NAME, (10, 10, 20, 20), "a"), (NAME, (120, 10, 130, 20), "b")]), pages).collect()
    assert [tuple(r["area"]) for r in got] == [(8, 8, 22, 22)]


def test_own_words(spark):
    for words, bs, said in ((["a"], None, "BOTH"), (None, [[0, 0, 1, 1]], "BOTH"), (["a", "b"], [[0, 0, 1, 1]], "same length"), (["a"], [[0, 0, 1]], r"boxes\[0\]"), (["a"], [[10, 0, 5, 1]], "inverted")):
        with pytest.raises(ValueError, match=said):
            ocr.check_lists(words, bs)
    ocr.check_lists([], [])
    df = spark.createDataFrame([(1, 0, "a", [1.9, 0.0, 5.0, 7.2]), (1, 1, "b", [9.0, 0.0, 5.0, 7.0])], "page_id bigint, word_idx int, word string, box array<double>")
    assert [tuple(r["box"]) for r in ocr.own_words(df.where("word_idx = 0")).collect()] == [(1, 0, 5, 7)]
    assert [(r["word_idx"], r["reason"]) for r in ocr.rejects(df).collect()] == [(1, "is inverted")]
    with pytest.raises(Exception, match="is inverted"):
        ocr.own_words(df).collect()
    raw = spark.createDataFrame([(1, 0, "Hi", 0.5, 0.1, 0.25, 0.75, 200, 100), (1, 1, "", 0.5, 0.1, 0.25, 0.75, 200, 100), (1, 2, "px", 20.0, 10.0, 3.0, 7.0, 200, 100)],
        "page_id bigint, word_idx int, text string, left double, right double, upper double, lower double, width int, height int")
    assert [(r["word"], tuple(r["box"])) for r in ocr.adapted(raw).orderBy("word_idx").collect()] == [("Hi", (20, 25, 100, 75)), ("px", (10, 3, 20, 7))]


def picture(high=60, wide=200, value=255):
    return np.full((high, wide, 3), value, np.uint8)


def test_png_round_trip():
    image = np.random.default_rng(1).integers(0, 255, (13, 7, 3), dtype=np.uint8)
    assert (px.from_bytes(px.to_png(image)) == image).all()


def test_pixels():
    image = picture()
    px.redact(image, (10, 10, 20, 20))
    assert (image[10:21, 10:21] == 0).all() and (image[:10] == 255).all() and (image[21:] == 255).all()
    noise = np.random.default_rng(1).integers(0, 255, (48, 48, 3), dtype=np.uint8)
    for mode in ("blur", "pixelate"):
        x = noise.copy()
        px.redact(x, (0, 0, 48, 48), mode)
        assert x.std() < noise.std() and x.shape == noise.shape
    with pytest.raises(ValueError, match="mode"):
        px.redact(noise, (0, 0, 5, 5), "sparkle")
    grey = picture(value=90)
    grey[20:30, 20:40] = 0
    assert px.surrounding(grey, (20, 20, 40, 30)) == (90, 90, 90) and px.erase(grey, (20, 20, 40, 30)) == (90, 90, 90) and (grey[20:30, 20:40] == 90).all()
    assert px.surrounding(grey, (300, 300, 310, 310)) == (255, 255, 255)
    print_ = picture()
    print_[5:15, 120:130] = 0
    assert px.content_limit(print_, (0, 20), 50, 190, (255, 255, 255)) == 120 and px.content_limit(print_, (0, 20), 50, 100, (255, 255, 255)) == 100
    assert px.ink((255, 255, 255)) == px.DARK_INK and px.ink((0, 0, 0)) == px.LIGHT_INK


def test_pages_are_painted(spark):
    image = picture(100, 100)
    pages = spark.createDataFrame([(1, "r", 1, 100, 100, px.to_png(image)), (2, "r", 2, 100, 100, px.to_png(image))], "page_id bigint, record_id string, page_no bigint, width int, height int, content binary")
    seen = entities(spark, [("signature", (20, 20, 80, 80), None), (NAME, (5, 2, 30, 12), "John")])
    out = {r["page_id"]: px.from_bytes(r["content"]) for r in raster.anonymize(pages, seen, draw=False).collect()}
    assert tuple(out[1][50, 50]) == (0, 0, 0) and (out[2] == 255).all()
    named, mapping = raster.deidentify(pages, seen, draw=False)
    first = {r["page_id"]: px.from_bytes(r["content"]) for r in named.collect()}[1]
    assert tuple(first[50, 50]) == px.FILL and tuple(first[20, 20]) == px.EDGE
    assert [(r["pseudonym"], r["original"]) for r in mapping.collect()] == [("Person_1", "John")]
    solid = {r["page_id"]: px.from_bytes(r["content"]) for r in raster.redact(pages, seen, colour=(9, 8, 7)).collect()}[1]
    assert tuple(solid[10, 10]) == (9, 8, 7) and tuple(solid[1, 50]) == (255, 255, 255)
    framed = {r["page_id"]: px.from_bytes(r["content"]) for r in raster.overlaid(pages, seen, {"person": (1, 2, 3)}).collect()}[1]
    assert tuple(framed[20, 50]) == (1, 2, 3) and tuple(framed[50, 50]) == (255, 255, 255)
    with pytest.raises(ValueError, match="mode"):
        raster.redact(pages, seen, mode="sparkle")
    with pytest.raises(ValueError, match="vault"):
        raster.deidentify(pages, seen, strategy="vault", draw=False)


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(px.to_png(picture(6, 9)))
    (tmp_path / "note.txt").write_text("hello")
    r = files.images(spark, str(tmp_path)).collect()
    assert [(x["width"], x["height"]) for x in r] == [(9, 6)]
    assert [x["text"] for x in files.texts(spark, str(tmp_path / "note.txt"), "text").collect()] == ["hello"]
    out = files.write_files(files.images(spark, str(tmp_path)), f"file://{tmp_path}/out").collect()
    assert px.from_bytes(open(out[0]["path"], "rb").read()).shape == (6, 9, 3)
    body = files.entities_json(spark.range(1, 3).withColumnRenamed("id", "page_id"), entities(spark, [("logo", (1, 2, 3, 4), None)])).orderBy("page_id").collect()
    assert body[0]["body"] == '{"entities":[{"category":"logo","kind":"visual","bbox":[1,2,3,4],"l1":"person","text":null,"score":0.9}]}' and body[1]["body"] == '{"entities":[]}'


def test_brought_models(spark):
    def detector():
        def run(batch):
            return [[(0, i, i, i + 1, "B-AGE" if c.isdigit() else "O", 0.5) for i, c in enumerate(t)] for t in batch]

        return run

    docs = spark.createDataFrame([(1, "a 7"), (2, "  "), (3, None)], "doc_id bigint, text string")
    got = models.token_labels(docs, detector).where("label <> 'O'").collect()
    assert [(r["doc_id"], r["char_start"]) for r in got] == [(1, 2)]

    def visual():
        return lambda data, least: [("logo", (0, 0, 5.9, 5), 0.91239), ("signature", (0, 0, 1, 1), 0.1)]

    pages = spark.createDataFrame([(1, b"x", 10, 10)], "page_id bigint, content binary, width int, height int")
    r = models.visual_entities(pages, visual).collect()
    assert [(x["category"], tuple(x["bbox"]), x["score"], x["l1"]) for x in r] == [("logo", (0, 0, 5, 5), 0.9124, "biometric_visual")]
    assert models.visual_entities(pages, visual, categories=["signature"]).count() == 0
    with pytest.raises(ImportError, match="install it"):
        models.require("no_such_module_here", "install it")

    def engine():
        return lambda data: [("w", (0, 0, 999, 500))]

    assert [tuple(x["box"]) for x in ocr.engine_words(pages, engine).collect()] == [(0, 0, 9, 5)]
