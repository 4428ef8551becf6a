"""Boxes of words, entities and images: arithmetic on columns.

A box is a struct of whole x0, y0, x1 and y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def normalized(b: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the page, to the even whole number, within 0 and 1000."""
    scale = lambda v, d: F.least(F.lit(1000), F.greatest(F.lit(0), F.rint(v / d * 1000).cast("int")))
    return box(scale(b["x0"], width), scale(b["y0"], height), scale(b["x1"], width), scale(b["y1"], height))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """A box in thousandths in pixels, cut to whole ones."""
    scale = lambda v, d: (v / 1000 * d).cast("int")
    return box(scale(b["x0"], width), scale(b["y0"], height), scale(b["x1"], width), scale(b["y1"], height))


def padded(b: Column, pad: Column, width: Column, height: Column) -> Column:
    return box(F.greatest(F.lit(0), b["x0"] - pad), F.greatest(F.lit(0), b["y0"] - pad), F.least(width, b["x1"] + pad), F.least(height, b["y1"] + pad))


def redaction_boxes(entities: DataFrame, pages: DataFrame, pad: int = 2) -> DataFrame:
    """entities (page_id, bbox, ...) of pages (page_id, width, height) with area: the padded box within the page; empty ones are left out."""
    rows = entities.join(pages.select("page_id", "width", "height"), "page_id")
    area = padded(F.col("bbox"), F.lit(pad), F.col("width"), F.col("height"))
    return rows.withColumn("area", area).where("area.x1 > area.x0 and area.y1 > area.y0").drop("width", "height")


def erasure_box(b: Column, width: Column, height: Column) -> Column:
    """The box with a fifth of its height around it, 2 at least, within the page."""
    return padded(b, F.greatest(F.lit(2), F.floor((b["y1"] - b["y0"]) * F.lit(0.2)).cast("int")), width, height)


def mostly_inside(inner: Column, outer: Column, share: float = 0.7) -> Column:
    """Whether that share of inner's area or more lies in outer; no for boxes without area."""
    over = lambda a, b: F.greatest(F.lit(0), F.least(inner[b], outer[b]) - F.greatest(inner[a], outer[a])).cast("double")
    area = (inner["x1"] - inner["x0"]).cast("double") * (inner["y1"] - inner["y0"])
    return (area > 0) & (over("x0", "x1") * over("y0", "y1") / F.when(area > 0, area) >= share)


def outside_visuals(entities: DataFrame) -> DataFrame:
    """The text entities that don't lie mostly inside a visual one of their page."""
    text, visual = entities.where("kind = 'text'").alias("t"), entities.where("kind = 'visual'").alias("v")
    inside = (F.col("t.page_id") == F.col("v.page_id")) & F.coalesce(mostly_inside(F.col("t.bbox"), F.col("v.bbox")), F.lit(False))
    return text.join(visual, inside, "left_anti")


def line_runs(words: DataFrame, gap: float = 1.5) -> DataFrame:
    """Runs of words (page_id, line_idx, word_idx, category, text, bbox): one line, one category, gaps from 0 to 1.5 line heights.

    Gives page_id, line_idx, category, bbox, text and word_heights, in order of the line's words; words of other
    categories between don't end a run, and an overlap to the left does.
    """
    line, own = Window.partitionBy("page_id", "line_idx"), Window.partitionBy("page_id", "line_idx", "category").orderBy("bbox.x0", "word_idx")
    rows = words.withColumn("height", F.max(F.col("bbox.y1") - F.col("bbox.y0")).over(line)).withColumn("was", F.lag("bbox.x1").over(own))
    space = F.col("bbox.x0") - F.col("was")
    rows = rows.withColumn("fresh", (F.col("was").isNull() | (space < 0) | (space > gap * F.col("height"))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct(F.col("bbox.x0").alias("x0"), "word_idx", F.coalesce("text", F.lit("")).alias("text"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("height"))
    out = rows.groupBy("page_id", "line_idx", "category", "run").agg(
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"), F.array_sort(F.collect_list(one)).alias("words")
    )
    # an empty text joins without a space, as a text that is trimmed after each word
    text = F.trim(F.aggregate("words", F.lit(""), lambda acc, w: F.trim(F.concat(acc, F.lit(" "), w["text"]))))
    return out.select(
        "page_id", "line_idx", "category", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), text.alias("text"),
        F.transform("words", lambda w: w["height"]).alias("word_heights"), F.col("words")[0]["word_idx"].alias("first_word"),
    )


def type_height(word_heights: Column, bbox: Column) -> Column:
    """The height that a group's text was printed at: the 85th percentile of its words', those under half the tallest left out."""
    kept = F.array_sort(F.filter(word_heights, lambda h: h >= F.array_max(word_heights) * 0.5))
    n = F.size(kept)
    at = F.least(n - 1, F.floor(n * F.lit(0.85)).cast("int")) + 1
    return F.when(F.size(word_heights) > 0, F.element_at(kept, F.greatest(at, F.lit(1)))).otherwise(bbox["y1"] - bbox["y0"])


def em_sizes(groups: DataFrame) -> DataFrame:
    """groups (page_id, group_idx, bbox, word_heights, ...) with em_size: small, body or large by the page's usual height.

    The usual height is the upper median of the groups' heights, each counted once for each word.
    """
    rows = groups.withColumn("type_height", type_height(F.col("word_heights"), F.col("bbox")))
    weight = F.greatest(F.lit(1), F.size("word_heights"))
    counted = rows.groupBy("page_id", F.col("type_height").alias("h")).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy("page_id").orderBy("h"))
    total = F.sum("w").over(Window.partitionBy("page_id"))
    # the value at place total // 2 of the sorted list
    body = counted.withColumns({"upto": upto, "total": total}).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("page_id").agg(F.min("h").alias("body"))
    ratio = F.when(F.col("body") != 0, F.col("type_height") / F.when(F.col("body") != 0, F.col("body"))).otherwise(1.0)
    bucket = F.when(ratio < 0.55, 0.8).when(ratio > 1.5, 1.6).otherwise(1.0)
    size = F.greatest(F.lit(8), F.floor(F.lit(1.2) * bucket * F.col("body")).cast("int"))
    return rows.join(body, "page_id").withColumn("em_size", size).drop("body")
