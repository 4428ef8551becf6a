"""A rule detector: regular expressions to spans. Our own addition, so that tables of texts flow end to end without a model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators.spans import only
from hushframe.taxonomy import group_of

#: (category, pattern, score), in the part of the syntax that Java and RE2 share; no look-around, no groups that count.
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.95),
    ("phone_mobile", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.9),
    ("ip_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.8),
    ("other_id", r"[0-9]{16}", 0.7),
    ("api_key_token", r"[0-9A-Fa-f]{40}", 0.85),
)


def either(rules=RULES) -> str:
    """The pattern of texts in which some rule matches."""
    return "|".join(f"(?:{p})" for _, p, _ in rules)


def rule_spans(docs: DataFrame, categories: Iterable[str] | None = None, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every match of the rules in docs (key, text), numbered by start, end and category.

    Offsets are sums of the lengths of gaps and matches, in characters. Texts without a match end at the first filter;
    only matches are shuffled, once, by key. Null and empty texts have no spans.
    """
    found = [
        F.struct(F.lit(c).alias("category"), F.lit(float(s)).alias("score"), F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), 0).alias("hits"), F.lit(i).alias("rule"))
        for i, (c, p, s) in enumerate(rules)
    ]
    rows = docs.where(F.col(text).rlike(either(rules))).select(F.col(key).alias("doc_id"), F.explode(F.array(*found)).alias("f")).where(F.size("f.hits") > 0)
    hits = rows.select("doc_id", "f.category", "f.score", "f.rule", F.posexplode(F.arrays_zip(F.slice("f.gaps", 1, F.size("f.hits")).alias("gap"), F.col("f.hits").alias("hit"))).alias("pos", "m"))
    hits = hits.select("doc_id", "category", "score", "rule", "pos", F.length("m.gap").alias("gap"), F.col("m.hit").alias("text")).repartition("doc_id")
    upto = Window.partitionBy("doc_id", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("text")).over(upto).cast("int")
    spans = hits.withColumn("end", end).withColumn("start", (F.col("end") - F.length("text")).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "category")
    out = spans.select("doc_id", (F.row_number().over(order) - 1).cast("int").alias("span_idx"), "category", "start", "end", group_of(F.col("category")).alias("l1"), "text", "score")
    return only(out, categories)


def spans_in_row(text, rules=RULES):
    """The array of a text's matches, ordered as `spans.gathered` has them, by expressions on the one row, so that streams can use it.

    Each match adds up the lengths before it: meant for texts with up to some hundred matches; `rule_spans` has no such cost.
    """
    parts = []
    for category, pattern, score in rules:
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
        both = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
        parts.append(F.when(F.size(both) > 0, F.transform(F.sequence(F.lit(1), F.size(both)), _match(both, category, score))).otherwise(F.array()))
    return F.transform(F.array_sort(F.concat(*parts)), lambda s: s.dropFields("shrink"))


def _match(both, category: str, score: float):
    """The span of the i-th of a text's gaps and hits."""

    def one(i):
        upto = F.aggregate(F.slice(both, 1, i), F.lit(0), lambda acc, m: acc + F.length(m["gap"]) + F.length(m["hit"]))
        hit = F.element_at(both, i)["hit"]
        return F.struct(
            (upto - F.length(hit)).alias("start"), (-F.length(hit)).alias("shrink"), upto.alias("end"), F.lit(category).alias("category"),
            group_of(F.lit(category)).alias("l1"), hit.alias("text"), F.lit(float(score)).alias("score"), F.lit(1).alias("parts"),
        )

    return one
