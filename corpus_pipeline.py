"""A training corpus from documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import mixing, ngram_join, quality, sentence_pieces, shared_spans, substring_dedup
from hushframe.llm.common import scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labels.quality rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: 5-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents go, but for their first place: lines and their near copies, and runs of words anywhere."""
    return shared_spans.without_spans(docs, substring_dedup.removals(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated or left out."""
    return mixing.resample(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return sentence_pieces.encode(docs, sentence_pieces.model_file()).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("sentence pieces", as_pieces),
]
#: The classifier, the random draws and the tokenizer have no SQL; tests hold stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
