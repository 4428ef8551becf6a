"""Small tables for tests, and plain-Python statements of the rules to hold them against."""

from pyspark.sql import functions as F

from hushframe.taxonomy import group_of

SPANS = "doc_id bigint, span_idx int, category string, start int, end int, score double"


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def spans_of(spark, docs, rows):
    """rows: (doc_id, category, start, end) or with a score, in order."""
    full = [(r[0], i, r[1], r[2], r[3], r[4] if len(r) > 4 else 0.9) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, SPANS).withColumn("l1", group_of(F.col("category")))
    cut = F.substring(F.col("t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text")
    return df.join(docs.withColumnRenamed("text", "t"), "doc_id").select("doc_id", "span_idx", "category", "start", "end", "l1", cut, "score")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def covered(spans):
    """Positions under any of the spans (start, end)."""
    return {i for s, e in spans for i in range(s, e)}
