"""Spans of personal data in texts: overlap union, adjacency merge, and texts with spans replaced.

A spans table has doc_id, span_idx, category, start, end, l1, text and score; offsets are half-open and count
characters. The rules are expressions on one row, a text and the array of its spans, so a stream runs what a batch
runs; the table forms below gather the spans of each text once and meet the texts once.
`operators.dense` has the same rules for many spans in each text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.exact import round4
from hushframe.functions.text import cells, cut_cells, is_blank, let
from hushframe.taxonomy import checked

SPAN = "struct<start:int,end:int,category:string,l1:string,text:string,score:double,parts:int>"
PLACED = "struct<start:int,shrink:int,span_idx:int,end:int,category:string,l1:string,text:string,score:double>"
SPAN_COLUMNS = "doc_id bigint, span_idx int, category string, start int, end int, l1 string, text string, score double"
REDACTED = "[REDACTED]"


def _span(start: Column, end: Column, like: Column, text: Column, score: Column, parts: Column) -> Column:
    return F.struct(
        start.alias("start"), end.alias("end"), like["category"].alias("category"), like["l1"].alias("l1"), text.alias("text"),
        score.alias("score"), parts.cast("int").alias("parts"),
    )


def placed(start: Column, end: Column, span_idx: Column, category: Column, l1: Column, text: Column, score: Column) -> Column:
    """A span whose order is that of the spans of a text: by start, then the longer, then span_idx."""
    return F.struct(
        start.alias("start"), (start - end).alias("shrink"), span_idx.alias("span_idx"), end.alias("end"), category.alias("category"), l1.alias("l1"), text.alias("text"),
        score.cast("double").alias("score"),
    )


def gathered(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans): the spans of each text, by start, then the longer, then span_idx. Empty and inverted ones are left out."""
    order = placed(*[F.col(c) for c in ("start", "end", "span_idx", "category", "l1", "text", "score")])
    return spans.where(F.col("end") > F.col("start")).groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("spans"))


def union_in_row(text: Column, spans: Column) -> Column:
    """Overlapping spans as one over all that they cover, described by the widest of them (of equals, the first).

    spans are ordered as `gathered` has them. Spans that only touch stay apart. What the widest covers alone keeps its
    text; a longer range takes its text from the text.
    """
    return let(cells(text), lambda pieces: _united(text, pieces, spans))


def _united(text: Column, pieces: Column, given: Column) -> Column:
    """No step copies what was done before, so the time grows with the number of spans and not with its square.

    A group begins where as many spans have ended as have begun: at i if the i-th of the sorted ends isn't after its
    start. The widest of a group has the greatest key, its width before its place from the end.
    """

    def groups(spans: Column, ends: Column, keys: Column, heads: Column) -> Column:
        def one(head: Column, k: Column) -> Column:
            after = F.coalesce(F.get(heads, k + 1), F.size(spans))
            best = F.pmod(-F.array_max(F.slice(keys, head + 1, after - head)), F.lit(1 << 32)).cast("int")
            return let(F.struct(F.get(spans, F.when(after == head + 1, head).otherwise(best)).alias("w"), F.get(spans, head)["start"].alias("start"), F.get(ends, after - 1).alias("end")), close)

        return F.transform(heads, one)

    def close(g: Column) -> Column:
        w, start, end = g["w"], g["start"], g["end"]
        own = F.when((w["start"] == start) & (w["end"] == end), w["text"]).otherwise(cut_cells(text, pieces, start, end))
        return _span(start, end, w, own, w["score"], F.lit(1))

    def sweep(spans: Column) -> Column:
        key = F.transform(spans, lambda s, i: F.shiftleft((s["end"] - s["start"]).cast("long"), 32) - i)
        places = lambda ends: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(spans, i)["start"]))
        return let(F.sort_array(F.transform(spans, lambda s: s["end"])), lambda ends: let(key, lambda keys: let(places(ends), lambda heads: groups(spans, ends, keys, heads))))

    none = F.array().cast(f"array<{SPAN}>")
    return let(given, lambda spans: F.when(F.size(spans) > 0, sweep(spans)).otherwise(none))


def merge_in_row(text: Column, spans: Column) -> Column:
    """Unions, of which those of one category with nothing but white space between are one; parts counts them.

    The score is the least of the parts' (to be rounded where parts > 1), or null if one has none.
    """
    return let(cells(text), lambda pieces: let(_united(text, pieces, spans), lambda united: _merged(text, pieces, united)))


def _merged(text: Column, pieces: Column, united: Column) -> Column:
    """Whether a union joins hangs on the one before it alone; a run of joining ones is a slice."""

    def joins(i: Column) -> Column:
        return let(F.struct(F.get(united, i - 1).alias("o"), F.get(united, i).alias("s")), lambda p: (p["o"]["category"] == p["s"]["category"])
            & ((p["o"]["end"] == p["s"]["start"]) & text.isNotNull() | is_blank(cut_cells(text, pieces, p["o"]["end"], p["s"]["start"]))))

    def run(heads: Column) -> Column:
        def one(head: Column, k: Column) -> Column:
            n = F.coalesce(F.get(heads, k + 1), F.size(united)) - head
            return F.when(n == 1, F.get(united, head)).otherwise(let(F.slice(united, head + 1, n), several))

        return F.transform(heads, one)

    def several(members: Column) -> Column:
        first, end = F.get(members, F.lit(0)), F.element_at(members, -1)["end"]
        scores = F.transform(members, lambda s: s["score"])
        low = F.when(~F.exists(scores, lambda x: x.isNull()), F.array_min(scores))
        return _span(first["start"], end, first, cut_cells(text, pieces, first["start"], end), low, F.size(members))

    heads = F.filter(F.sequence(F.lit(0), F.size(united) - 1), lambda i: (i == 0) | ~F.coalesce(joins(i), F.lit(False)))
    return F.when(F.size(united) > 0, let(heads, run)).otherwise(united)


def rebuilt(text: Column, spans: Column, substitute: Callable[[Column], Column]) -> Column:
    """text with each of its spans, disjoint and in order, replaced by substitute(span); gaps are taken once each."""
    n = F.size(spans)

    def pieces(parts: Column) -> Column:
        gap = lambda s, i: cut_cells(text, parts, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"])
        return F.transform(spans, lambda s, i: F.concat(gap(s, i), substitute(s)))

    whole = F.concat(F.array_join(let(cells(text), pieces), ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, 2**31 - 1))
    return F.when(n > 0, whole).otherwise(text)


def _fields(template: str) -> list[str]:
    """The parts of a template: {category}, {l1}, {{, }} and what is between. Other fields are a ValueError."""
    parts = re.split(r"(\{\{|\}\}|\{[^{}]*\})", template)
    for p in parts:
        if p.startswith("{") and p not in ("{{", "{category}", "{l1}") or p not in ("}}", "{{", "{category}", "{l1}") and ("}" in p or "{" in p):
            raise ValueError(f"mask fields are {{category}} and {{l1}}, not {p!r}")
    return [p for p in parts if p]


def mask(template: str = REDACTED) -> Callable[[Column], Column]:
    """A substitute: the template as it is, or with {category} and {l1} filled in. Other fields are a ValueError."""
    if "{" not in template:
        return lambda s: F.lit(template)
    parts = _fields(template)
    piece = {"{{": lambda s: F.lit("{"), "}}": lambda s: F.lit("}"), "{category}": lambda s: s["category"], "{l1}": lambda s: s["l1"]}
    return lambda s: F.concat(*[piece[p](s) if p in piece else F.lit(p) for p in parts])


def mask_of(template: str = REDACTED) -> Callable[[str, str], str]:
    """As `mask`, from the plain category and l1."""
    if "{" not in template:
        return lambda category, l1: template
    parts = _fields(template)
    return lambda category, l1: "".join({"{{": "{", "}}": "}", "{category}": category, "{l1}": l1}.get(p, p) for p in parts)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_spans(docs: DataFrame, spans: DataFrame, name: str = "spans") -> DataFrame:
    """docs with the array of their spans under a name, null where there are none. The texts are shuffled once, and not sorted."""
    return docs.join(gathered(spans).withColumnRenamed("spans", name).hint("shuffle_hash"), "doc_id", "left")


def _exploded(rows: DataFrame) -> DataFrame:
    # the outer form: before the other one the optimizer puts a filter that makes the array a second time
    out = rows.select("doc_id", F.posexplode_outer("spans").alias("span_idx", "s")).where("span_idx is not null")
    return out.select("doc_id", "span_idx", "s.category", "s.start", "s.end", "s.l1", "s.text", "s.score", "s.parts")


def only(spans: DataFrame, categories: Iterable[str] | None) -> DataFrame:
    """The spans of these categories: None stands for all, an empty list for none; unknown names are a ValueError."""
    asked = checked(categories)
    return spans if asked is None else spans.where(F.col("category").isin(*asked) if asked else F.lit(False))


def union_overlapping(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans table with overlapping spans united; only texts that have spans are read further."""
    both = docs.select("doc_id", "text").join(gathered(spans).hint("shuffle_hash"), "doc_id")
    return _exploded(both.select("doc_id", union_in_row(F.col("text"), F.col("spans")).alias("spans"))).drop("parts")


def merge_adjacent(docs: DataFrame, spans: DataFrame, rounded: bool = True) -> DataFrame:
    """The spans table united and merged. rounded: scores of merged spans to 4 places as Python rounds (by Arrow)."""
    both = docs.select("doc_id", "text").join(gathered(spans).hint("shuffle_hash"), "doc_id")
    out = _exploded(both.select("doc_id", merge_in_row(F.col("text"), F.col("spans")).alias("spans")))
    if rounded:
        out = out.withColumn("score", F.when(F.col("parts") > 1, round4("score")).otherwise(F.col("score")))
    return out.drop("parts")


def replaced(docs: DataFrame, spans: DataFrame, substitute: Callable[[Column], Column], merge: bool = True) -> DataFrame:
    """docs with their texts' spans replaced, after uniting and (if merge) merging; texts without spans as they are."""
    name = unused(docs, "spans")
    rows, mine = with_spans(docs, spans, name), F.col(name)
    join = merge_in_row if merge else union_in_row
    # the array is made once: the rebuilding reads it many times
    rows = rows.withColumn(name, F.when(mine.isNotNull(), join(F.col("text"), mine)))
    rows = rows.withColumn("text", F.when(mine.isNull(), F.col("text")).otherwise(rebuilt(F.col("text"), mine, substitute)))
    return rows.select(*docs.columns)


def redact(docs: DataFrame, spans: DataFrame, template: str = REDACTED) -> DataFrame:
    return replaced(docs, spans, mask(template))


def apply_mask(docs: DataFrame, spans: DataFrame, template: str = REDACTED) -> DataFrame:
    """As `redact`, but neighbours of one category keep a mask each."""
    return replaced(docs, spans, mask(template), merge=False)
