"""Page images with areas hidden or relabelled. Tables decide what goes where; one Arrow function a page paints it."""

from __future__ import annotations

import contextlib
import functools
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import pixels as px
from hushframe.functions.generalize import generalized
from hushframe.functions.text import token
from hushframe.operators import blocks, boxes, labels, pseudonyms
from hushframe.operators.spans import unused
from hushframe.taxonomy import placeholder_of

MODES = ("solid", "blur", "pixelate")


def _painted(pages: DataFrame, marks: DataFrame, column: str, paint: Callable[[np.ndarray, list], np.ndarray]) -> DataFrame:
    """pages (page_id, content) with the content painted; marks: (page_id, column array). Pages without marks pass too."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for data, areas in zip(content, found):
            out.append(None if data is None else px.to_png(paint(px.from_bytes(bytes(data)), [] if areas is None else list(areas))))
        return pd.Series(out, dtype=object)

    mine = unused(pages, column)
    rows = pages.join(marks.withColumnRenamed(column, mine).hint("shuffle_hash"), "page_id", "left")
    return rows.withColumn("content", run("content", mine)).select(*pages.columns)


def _box(b) -> tuple:
    return tuple(b[k] for k in ("x0", "y0", "x1", "y1"))


def redact(pages: DataFrame, entities: DataFrame, mode: str = "solid", colour: tuple = (0, 0, 0), pad: int = 2) -> DataFrame:
    """pages (page_id, width, height, content) with every entity's padded box hidden, one after the other; content is PNG.

    mode is solid, blur or pixelate; another is a ValueError here, before any page is read.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be 'solid', 'blur' or 'pixelate', got {mode!r}")
    areas = boxes.redaction_boxes(entities, pages, pad)
    order = F.struct((F.col("kind") != "text").alias("late"), "ent_idx", "area")
    marks = areas.groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("areas"))

    def paint(image: np.ndarray, areas: list) -> np.ndarray:
        for a in areas:
            px.redact(image, _box(a["area"]), mode, colour)
        return image

    return _painted(pages, marks, "areas", paint)


def relabelled(pages: DataFrame, entities: DataFrame, labels: DataFrame, black: bool, draw: bool = True) -> DataFrame:
    """pages with text groups erased and labelled, and visual entities filled: grey with a name, or black.

    labels: numbered groups with em_size, type_height and label. All areas are filled before any label is written, so
    that no filling hides a label. Written labels need Pillow, whose absence is an ImportError here; without `draw`
    the areas are filled only.
    """
    if draw:
        px.pillow()
    one = F.struct("label_idx", "group_idx", "bbox", "label", "em_size", "type_height")
    texts = labels.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("texts"))
    seen = entities.where("kind = 'visual'").withColumn("name", placeholder_of(F.col("category")))
    visuals = seen.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ent_idx", "bbox", "name"))).alias("visuals"))
    marks = texts.join(visuals, "page_id", "full").select("page_id", F.array(F.struct("texts", "visuals")).alias("marks"))

    def paint(image: np.ndarray, marks: list) -> np.ndarray:
        texts = list(marks[0]["texts"] if marks and marks[0]["texts"] is not None else [])
        visuals = list(marks[0]["visuals"] if marks and marks[0]["visuals"] is not None else [])
        ground = {t["group_idx"]: px.erase(image, _box(t["bbox"])) for t in sorted(texts, key=lambda t: t["group_idx"])}
        for v in visuals:
            if black:
                px.fill(image, _box(v["bbox"]), (0, 0, 0))
            else:
                px.placeholder(image, _box(v["bbox"]))
        return write_labels(image, texts, ground, [] if black else visuals) if draw else image

    return _painted(pages, marks, "marks", paint)


def _face(fonts, size: int):
    """The first of the usual sans faces that is there."""
    for name in ("DejaVuSans.ttf", "Arial.ttf", "LiberationSans-Regular.ttf"):
        with contextlib.suppress(OSError):
            return fonts.truetype(name, size)
    return fonts.load_default()


def write_labels(image: np.ndarray, texts: list, ground: dict, visuals: list) -> np.ndarray:
    """The picture with labels and names written where `operators.labels` puts them."""
    pil, drawing, _, fonts = px.pillow()
    sheet = pil.fromarray(image)
    pen, face = drawing.Draw(sheet), functools.cache(functools.partial(_face, fonts))
    extent = lambda text, size: (pen.textlength(text, font=face(size)), pen.textbbox((0, 0), text, font=face(size)))
    clear = lambda rows, left, right, colour: px.content_limit(np.asarray(sheet), rows, left, right, colour)
    groups = [labels.Group(_box(t["bbox"]), t["label"], t["em_size"], t["type_height"], ground[t["group_idx"]]) for t in texts]
    written = ((p, px.ink(p.colour)) for p in labels.label_places(groups, sheet.width, extent, clear))
    names = ((p, p.colour) for p in labels.name_places([(_box(v["bbox"]), v["name"]) for v in visuals], extent, px.LABEL_INK))
    for p, ink in itertools.chain(written, names):
        pen.text((p.x, p.y), p.text, fill=ink, font=face(p.size), anchor="ls" if p.on_line else None)
    return np.asarray(sheet)


def _sized(entities: DataFrame) -> DataFrame:
    return boxes.em_sizes(blocks.numbered_groups(blocks.grouped(entities)))


def deidentify(
    pages: DataFrame, entities: DataFrame, strategy: str = "counter", prior: DataFrame | None = None, counters: DataFrame | None = None,
    secret: str | None = None, draw: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(pages with pseudonyms in place of text groups, the mapping) of pages (page_id, record_id, page_no, width, height, content)."""
    if strategy not in ("counter", "hash"):
        raise ValueError(f"strategy must be 'counter' or 'hash', got {strategy!r}")
    groups = _sized(entities)
    found = blocks.group_occurrences(groups, pages)
    if strategy == "hash":
        mapping = pseudonyms.hashed(found, prior, secret)
        labels = groups.withColumn("label", token(F.col("category"), F.col("text"), secret))
    else:
        mapping = pseudonyms.numbered(found, prior, counters)
        key = ["record_id", "label", "norm_key"]
        named = found.select(*key, F.col("doc_id").alias("page_id"), F.col("start").alias("label_idx")).join(mapping.select(*key, "pseudonym"), key)
        labels = groups.join(named.select("page_id", "label_idx", F.col("pseudonym").alias("label")), ["page_id", "label_idx"])
    return relabelled(pages, entities, labels, black=False, draw=draw), mapping


def anonymize(pages: DataFrame, entities: DataFrame, draw: bool = True) -> DataFrame:
    """pages with generalised labels in place of text groups, and visual entities black."""
    labels = _sized(entities).withColumn("label", generalized(F.col("category"), F.col("text")))
    return relabelled(pages, entities, labels, black=True, draw=draw)


def overlaid(pages: DataFrame, entities: DataFrame, colours: dict[str, tuple], width: int = 3) -> DataFrame:
    """pages with every entity's box outlined in its group's colour."""
    marks = entities.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ent_idx", "bbox", "l1"))).alias("marks"))

    def paint(image: np.ndarray, marks: list) -> np.ndarray:
        for m in marks:
            px.outline(image, _box(m["bbox"]), colours.get(m["l1"], (120, 120, 120)), width)
        return image

    return _painted(pages, marks, "marks", paint)
