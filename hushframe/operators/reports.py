"""Counts and views of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.text import cut, escape_html
from hushframe.operators.spans import gathered

#: A colour for each group.
COLOURS = {"person": (220, 60, 60), "location": (60, 130, 220), "date_time": (150, 90, 200), "contact": (30, 160, 110), "uid": (230, 140, 30), "device_net": (90, 100, 120), "credential": (180, 30, 120), "entity": (110, 140, 40), "biometric_visual": (20, 150, 170)}


def counts(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*by).agg(F.count("*").alias("n"))


def kinds_per_page(entities: DataFrame) -> DataFrame:
    """(page_id, n_text, n_visual)."""
    return entities.groupBy("page_id").agg(F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") == "visual").alias("n_visual"))


def rolled_up(spans: DataFrame) -> DataFrame:
    """(l1, category, n) for each category, each group and all: our own addition."""
    return spans.rollup("l1", "category").agg(F.count("*").alias("n"))


def shown(spans: DataFrame) -> DataFrame:
    """Spans as a table to look at: scores to 3 places, no nulls."""
    return spans.select("doc_id", "category", "l1", F.coalesce("text", F.lit("")).alias("text"), "start", "end", F.round("score", 3).alias("score"))


def highlighted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, html): texts that have spans, escaped, with a mark around each; one that begins inside another is passed over."""
    both = docs.select("doc_id", "text").join(gathered(spans).hint("shuffle_hash"), "doc_id")
    text = F.col("text")
    kind = dict(both.dtypes)["spans"]
    # those that begin at or after the end of the last one kept
    state = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("end"))
    kept = F.aggregate("spans", state, lambda acc, s: F.when(
        s["start"] >= acc["end"], F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), s["end"].alias("end"))).otherwise(acc), lambda acc: acc["kept"])
    both = both.withColumn("spans", kept)
    title = lambda s: F.concat(escape_html(s["category"]), F.when(s["score"].isNotNull(), F.concat(F.lit(" · "), F.format_string("%.3f", s["score"]))).otherwise(""))
    mark = lambda s: F.concat(F.lit('<mark class="'), s["l1"], F.lit('" title="'), title(s), F.lit('">'), escape_html(cut(text, s["start"], s["end"])), F.lit("</mark>"))
    n = F.size("spans")
    at = lambda i: F.element_at("spans", i)
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(escape_html(cut(text, F.when(i == 1, F.lit(0)).otherwise(at(F.greatest(i - 1, F.lit(1)))["end"]), at(i)["start"])), mark(at(i))))
    tail = escape_html(F.substring(text, at(-1)["end"] + 1, 2**31 - 1))
    return both.select("doc_id", F.concat(F.array_join(pieces, ""), tail).alias("html"))


def detected_by(docs: DataFrame, spans: DataFrame, *by: str) -> DataFrame:
    """(by..., docs, docs_with, spans): how many texts there are, how many have spans, and how many spans."""
    per = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", *by).join(per, "doc_id", "left")
    return rows.groupBy(*by).agg(F.count("*").alias("docs"), F.count("n").alias("docs_with"), F.coalesce(F.sum("n"), F.lit(0)).alias("spans"))


def top_categories(spans: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent categories, ties by name."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "category"))  # of the categories alone
    return counts(spans, "category").withColumn("rank", rank).where(F.col("rank") <= n)

