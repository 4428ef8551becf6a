"""Names for SQL: the rule detector as a table function, tokens and generalisation as functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hushframe.functions.generalize import generalized
from hushframe.sources.rules import RULES
from hushframe.taxonomy import group_of, plain_label

SPANS = "span_idx int, category string, start int, `end` int, text string, score double"


def detector(rules=RULES):
    """A table function of a text: its matches as rows, numbered by start, end and category. Null and empty texts give none."""
    patterns = [(c, re.compile(p), float(s)) for c, p, s in rules]

    class Spans:
        def eval(self, text: str) -> Iterator[tuple]:
            hits = sorted((m.start(), m.end(), c, m.group(), s) for c, p, s in patterns for m in p.finditer(text or ""))
            for i, (start, end, category, found, score) in enumerate(hits):
                yield i, category, start, end, found, score

    return F.udtf(Spans, returnType=SPANS)


def register(spark: SparkSession) -> None:
    """Registers pii_spans(text), pii_generalize(category, value), pii_group(category) and pii_token(category, value) for SQL.

    pii_generalize and pii_group are SQL functions that the optimiser writes out in the query: no Python runs for them.
    Tokens need the folding of letters, which is Arrow batches here. For whole tables `sources.rules.rule_spans` finds
    the spans of pii_spans without Python; the table function is for queries written in SQL.
    """
    spark.udtf.register("pii_spans", detector())
    category, value = F.col("category"), F.col("value")
    for name, result in (("pii_generalize(category STRING, value STRING)", generalized(category, value)), ("pii_group(category STRING)", group_of(category))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS STRING RETURN {_text(spark, result)}")

    @F.pandas_udf("string")
    def token(categories: pd.Series, values: pd.Series) -> pd.Series:
        both = zip(categories, values)
        return pd.Series([None if c is None or v is None else f"{plain_label(c)}_{hashlib.md5(' '.join(v.split()).casefold().encode()).hexdigest()[:6]}" for c, v in both], dtype=object)

    spark.udf.register("pii_token", token)


def _text(spark: SparkSession, column) -> str:
    """An expression over category and value as SQL."""
    rows = spark.createDataFrame([], "category string, value string").select(column)
    return rows._jdf.queryExecution().analyzed().expressions().head().child().sql()
