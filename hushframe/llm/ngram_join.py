"""N-gram Jaccard join: which documents' shingle sets are alike, by a blocked sparse product of their incidence matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, table
from hushframe.llm.set_links import classes, partition_signatures, sliced_signatures, whole_texts


#: From this similarity on, candidates come from signatures that miss nothing; below, from MinHash bands that miss a
#: pair at the threshold once in ten million times.
EXACT_FROM = 90


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) for every row of docs (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of k-word shingles, A-Z read as a-z, words
    parted by ASCII white space; fewer than k words make one shingle. n_links is the number of other rows with an id
    that link with the row directly; component_id is the smallest doc_id that links
    lead to, one's own included. No link is lost from 90 percent on, but for a clash of 64-bit hashes; below,
    see EXACT_FROM. Null and empty texts have no
    shingles and link with nothing; equal texts, repeated rows and ties of id each keep their row; a row whose doc_id
    is null has no links and no component; an empty table gives none; other columns are not read.
    """
    sign = partition_signatures(percent) if percent >= EXACT_FROM else sliced_signatures(percent)
    owned, linked, counted = classes(docs, whole_texts, k, percent, sign)
    copies = owned.where("id is not null").groupBy("item").agg(F.count("*").alias("times"))
    items = cut(
        copies.hint("merge").join(counted.hint("merge"), "item", "left").join(linked.withColumnRenamed("node", "item").hint("merge"), "item", "left")
        .select("item", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "root")
    )
    full = owned.hint("merge").join(items.hint("merge"), "item", "left")
    full = cut(full.select("id", "n", "n_links", F.coalesce("root", "item").alias("root")))
    heads = cut(full.groupBy("root").agg(F.min("id").alias("component_id")))
    known = F.col("id").isNotNull()
    alike = full.hint("merge").join(heads.hint("merge"), "root").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.col("n_links")).alias("n_links"), F.when(known, F.col("component_id")).alias("component_id")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    there, none = F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")
    blank = docs.where(~text.rlike(r"[^\x20\x09-\x0D]"))
    blank = blank.select(there.alias("doc_id"), none.alias("n_shingles"), F.when(there.isNotNull(), none).alias("n_links"), there.alias("component_id"))
    return alike.unionByName(blank)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component; all their columns.

    Of rows that repeat an id, as many stay as there are; rows with a null doc_id stay.
    """
    gone = jaccard_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut(gone).hint("shuffle_hash"), "doc_id", "left_anti")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all documents: 3-word shingles, similarity 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
