"""The queries over pictures, pixel by pixel against plain numpy; and models brought along, end to end."""

import hashlib

import numpy as np
import pytest

from hushframe.operators import spans, tokens
from hushframe.plans import inputs
from hushframe.plans.queries import QUERIES
from hushframe.sources import models

NAMES = {3: "oak moss pewter", 4: "a bb ccc dddd eeeee ffffff ggggggg", 11: "one"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pictures")
    spark.createDataFrame([(k, n, "m") for k, n in NAMES.items()], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


def words(page):
    """(category, box, text) of each word."""
    out = []
    for i, w in enumerate(NAMES[page].split(" ")):
        x, y = 4 + i % 3 * 30, 6 + i // 3 * 20
        out.append((("other_person_name", "city_district", "age")[(page + i) % 3], (x, y, x + min(28, 4 * len(w)), y + 10), w))
    return out


def digests(spark, folder, query):
    return {r["page_id"]: r["pixels"] for r in QUERIES[query](spark, folder).collect()}


def digest(image):
    return hashlib.sha256(np.ascontiguousarray(image).tobytes()).hexdigest()


LOGO = (60, 22, 94, 60)


def test_solid(spark, folder):
    want = {}
    for page in NAMES:
        image = inputs.pattern(page)
        for x0, y0, x1, y1 in [*(b for _, b, _ in words(page)), LOGO]:
            image[max(0, y0 - 2) : min(64, y1 + 2) + 1, max(0, x0 - 2) : min(96, x1 + 2) + 1] = (9, 8, 7)
        want[page] = digest(image)
    assert digests(spark, folder, "page_redact_solid") == want


def test_blur_and_pixelate_stay_in_their_boxes(spark, folder):
    both = [digests(spark, folder, q) for q in ("page_redact_blur", "page_redact_pixelate")]
    assert all(set(d) == set(NAMES) for d in both) and all(both[0][p] != both[1][p] for p in NAMES)
    want = {}
    for page in NAMES:
        image = inputs.pattern(page)
        for x0, y0, x1, y1 in [*(b for _, b, _ in words(page)), LOGO]:
            x0, y0, x1, y1 = max(0, x0 - 2), max(0, y0 - 2), min(96, x1 + 2), min(64, y1 + 2)
            part, (h, w) = image[y0:y1, x0:x1].copy(), (max(1, (y1 - y0) // 12), max(1, (x1 - x0) // 12))
            for y in range(y1 - y0):
                for x in range(x1 - x0):
                    # the middle pixel of the large pixel that this one is in
                    image[y0 + y, x0 + x] = part[int((y * h // (y1 - y0) + 0.5) * (y1 - y0) / h), int((x * w // (x1 - x0) + 0.5) * (x1 - x0) / w)]
        want[page] = digest(image)
    assert both[1] == want


def test_overlay(spark, folder):
    colours, groups = {"person": (200, 0, 0), "location": (0, 0, 200)}, {"other_person_name": "person", "age": "person", "city_district": "location"}
    want = {}
    for page in NAMES:
        image, marks = inputs.pattern(page), [(i, b, c) for i, (c, b, _) in enumerate(words(page))] + [(0, LOGO, "logo")]
        for _, (x0, y0, x1, y1), c in sorted(marks):
            colour = colours.get(groups.get(c), (120, 120, 120))
            for y in range(y0, min(63, y1) + 1):
                for x in range(x0, min(95, x1) + 1):
                    if min(x - x0, x1 - x, y - y0, y1 - y) < 3:
                        image[y, x] = colour
        want[page] = digest(image)
    assert digests(spark, folder, "page_overlay") == want


def test_erased_pages_and_their_mapping(spark, folder):
    black, grey = digests(spark, folder, "page_anonymize"), digests(spark, folder, "page_deidentify")
    assert set(black) == set(grey) == set(NAMES) and all(black[p] != grey[p] for p in NAMES)
    (_, (x0, y0, x1, y1), _), image = words(11)[0], inputs.pattern(11)
    seen = image[max(0, y0 - 4) : y1 + 4, max(0, x0 - 4) : x1 + 4]
    ring = np.ones(seen.shape[:2], bool)
    ring[2:-2, 2:-2] = False
    image[y0 - 2 : y1 + 3, x0 - 2 : x1 + 3] = [int(v) for v in np.median(seen[ring], axis=0)]
    image[22:61, 60:95] = 0
    assert black[11] == digest(image)
    got = sorted((r["label"], r["pseudonym"], r["original"]) for r in QUERIES["page_mapping"](spark, folder).collect())
    # ccc, ffffff and what else lies in the logo is part of it
    inside = lambda b: max(0, min(b[2], 94) - max(b[0], 60)) * max(0, min(b[3], 60) - max(b[1], 22)) >= 0.7 * (b[2] - b[0]) * (b[3] - b[1])
    shown = {w for p in NAMES for _, b, w in words(p) if not inside(b)}
    assert {w for _, _, original in got for w in original.split()} == shown


def test_a_model_from_texts_to_redaction(spark):
    def detector():
        def run(batch):
            """A person wherever a word begins with a capital."""
            out = []
            for text in batch:
                at, found = 0, []
                for i, w in enumerate(text.split(" ")):
                    found.append((0, i, at, at + len(w), "B-other_person_name" if w[:1].isupper() else "O", 0.75))
                    at += len(w) + 1
                out.append(found)
            return out

        return run

    docs = spark.createDataFrame([(1, "met Asha and Ivo there"), (2, "no one"), (3, None), (4, "")], "doc_id bigint, text string")
    found = tokens.decoded(docs, models.token_labels(docs, detector))
    assert sorted((r["doc_id"], r["start"], r["end"], r["category"], r["score"]) for r in found.collect()) == [(1, 4, 8, "other_person_name", 0.75), (1, 13, 16, "other_person_name", 0.75)]
    assert {r["doc_id"]: r["text"] for r in spans.redact(docs, found, "[{l1}]").collect()} == {1: "met [person] and [person] there", 2: "no one", 3: None, 4: ""}


def test_pages_go_to_python_in_batches(spark):
    """No Python call and no pandas frame for each page; small pages by plain numbers as large ones by arrays."""
    import random

    from hushframe.operators import blocks

    rows = [(p, i, "age", "text", (9 * i, 0, 9 * i + 5, 10), f"w{i}") for p in range(300) for i in range(3)]
    e = spark.createDataFrame(rows, "page_id bigint, ent_idx int, category string, kind string, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string")
    g = blocks.numbered_groups(blocks.grouped(e))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert [tuple(r) for r in g.select("group_idx", "text", "label_idx").distinct().collect()] == [(0, "w0 w1 w2", 0)] and g.count() == 300
    draw = random.Random(3)
    for _ in range(200):
        boxes = [(x := draw.randrange(200), y := draw.randrange(90), x + draw.randrange(60), y + draw.randrange(40)) for _ in range(draw.randrange(1, 60))]
        few = blocks.place_lines(boxes), blocks.label_rows(boxes)
        kept, blocks.FEW = blocks.FEW, 0
        try:
            assert few == (blocks.place_lines(boxes), blocks.label_rows(boxes))
        finally:
            blocks.FEW = kept
