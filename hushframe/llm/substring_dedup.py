"""Passages that repeat across documents: paragraphs by banded MinHash, exact verdicts, removals by components.

Paragraphs are of two kinds. Lines of 40 words or more: near copies, by bands tuned to a recall, the exact Jaccard
similarity, and components. Windows of 51 words, one from every word on (`shared_spans`): equal ones wherever they begin,
within longer lines and across line breaks, by one band that equal paragraphs always share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, free_name, table
from hushframe.llm.set_links import classes, minhash_signatures, paragraphs, text_key
from hushframe.llm.shared_spans import shared_spans

#: Words that a line has at least to count as a paragraph.
LEAST_WORDS = 40
#: Values in a band, and the odds that a pair at the threshold shares a band.
ROWS, RECALL = 4, 0.999


def tune_bands(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands that find a pair at the threshold with the odds asked for."""
    bands = 1
    while 1 - (1 - (percent / 100) ** rows) ** bands < recall:
        bands += 1
    return bands


def repeated_passages(docs: DataFrame, k: int = 5, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """The lines of docs (doc_id, text) to remove: (doc_id, text_key, paragraph, first_word, n_words, kept_doc_id, kept_paragraph, kept_word, cluster, n_shingles).

    Paragraphs are lines, numbered from 0, of `least` words or more. Those whose sets of k-word shingles (A-Z read as
    a-z) have a similarity of percent or more, found by MinHash bands that share all values and then computed exactly,
    form clusters through each other; the paragraph of the smallest (doc_id, text_key, number) stays, the others are
    named here, with their words' place. Equal paragraphs are one item, so a passage in a third of all documents costs
    what a rare one does. Null and empty texts have no paragraphs; rows that repeat an id and text count as one, and
    text_key tells the texts of one id apart; rows with a null doc_id are left alone; an empty table gives none; other
    columns, whatever their names, are not read.
    """
    owned, linked, _ = classes(docs, paragraphs, k, percent, minhash_signatures(tune_bands(percent), ROWS), least)
    # of rows that are repeated, the same paragraph once
    owned = owned.where("id is not null").dropDuplicates(["id", "row", "number"])
    full = owned.hint("merge").join(linked.withColumnRenamed("node", "item").hint("merge"), "item", "left")
    full = cut(full.select("id", "row", "number", "first", "words", "n", F.coalesce("root", "item").alias("root")))
    heads = cut(full.groupBy("root").agg(F.min(F.struct("id", "row", "number", "first")).alias("head"), F.count("*").alias("times")).where("times > 1"))
    found = full.hint("merge").join(heads.hint("merge"), "root").where("id <> head.id or row <> head.row or number <> head.number")
    return found.select(
        F.col("id").alias("doc_id"), F.col("row").alias("text_key"), F.col("number").alias("paragraph"), F.col("first").alias("first_word"), F.col("words").alias("n_words"),
        F.col("head.id").alias("kept_doc_id"), F.col("head.number").alias("kept_paragraph"), F.col("head.first").alias("kept_word"), F.col("root").alias("cluster"),
        F.col("n").alias("n_shingles"),
    )


def removals(docs: DataFrame, k: int = 5, percent: int = 80, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, first_word, n_words, kept_doc_id, kept_word, kind): all passages of docs (doc_id, text) to remove, as runs of words.

    kind is `line` for lines with an earlier near copy (`repeated_passages`) and `run` for runs of 51 words or more that
    an earlier document has word by word (`shared_spans`); the two overlap where both hold. Odd rows are as there.
    """
    columns = ["doc_id", "text_key", "first_word", "n_words", "kept_doc_id", "kept_word"]
    lines = repeated_passages(docs, k, percent, least).select(*columns, F.lit("line").alias("kind"))
    return lines.union(shared_spans(docs).select(*columns, F.lit("run").alias("kind")))


def without_passages(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """docs without the lines that removals (doc_id, text_key, paragraph) name; n_chars, if there, follows the text.

    Rows of which nothing is left are dropped; all others stay, with all columns, whatever their names: rows that repeat
    an id lose only lines of their own text, and rows with a null doc_id or text are left alone.
    """
    mine, key, there = (free_name(docs, n) for n in ("gone", "key", "id"))
    gone = cut(removals.groupBy(F.col("doc_id").alias(there), F.col("text_key").alias(key)).agg(F.collect_set("paragraph").alias(mine)))
    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(there, F.col("doc_id").cast("bigint"))
    both = keyed.join(gone.hint("shuffle_hash"), [there, key], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(mine, i)), "\n")
    both = both.withColumn("text", F.when(F.col(mine).isNull(), F.col("text")).otherwise(left))
    both = both.where((F.col(mine).isNull()) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return both.select(*docs.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated passages of all documents, each with the place of the one that stays."""
    return removals(table(spark, sf_dir, "documents")).drop("text_key")
