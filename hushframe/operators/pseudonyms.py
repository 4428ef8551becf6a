"""Pseudonyms for values: numbered within a record, or tokens from a hash; and the mapping back to the originals.

Mapping tables have record_id, label, norm_key, pseudonym and original; counter tables record_id, label and n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.generalize import generalized
from hushframe.functions.text import normal, token
from hushframe.operators.spans import gathered, merge_in_row, rebuilt, replaced, unused
from hushframe.taxonomy import label_of

MAPPING = "record_id string, label string, norm_key string, pseudonym string, original string"
COUNTERS = "record_id string, label string, n int"
#: Pages that are numbered in one task; the numbers of later pages go on from theirs.
PAGES = 1024


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING)


def occurrences(docs: DataFrame, spans: DataFrame, record: str = "doc_id", page: str = "doc_id") -> DataFrame:
    """(record_id, page_no, doc_id, start, label, norm_key, original, category): the values to replace, after merging."""
    both = docs.select("doc_id", "text", F.col(record).cast("string").alias("record_id"), F.col(page).cast("bigint").alias("page_no")).join(
        gathered(spans).hint("shuffle_hash"), "doc_id"
    )
    text = F.col("text")
    rows = both.select("doc_id", "record_id", "page_no", F.transform(merge_in_row(text, F.col("spans")), lambda s: F.struct(
        s["start"].alias("start"), s["category"].alias("category"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("original"),
    )).alias("found"))
    s = rows.select("doc_id", "record_id", "page_no", F.explode("found").alias("s"))
    out = s.select("record_id", "page_no", "doc_id", "s.start", "s.category", "s.original")
    return out.withColumns({"label": label_of(F.col("category")), "norm_key": normal(F.col("original"))})


def next_numbers(prior: DataFrame, counters: DataFrame) -> DataFrame:
    """(record_id, label, used): the greatest number in use: the counter, or a number that a stored pseudonym ends with.

    A mapping that comes without its counters goes on after its numbers, so that no stored pseudonym is given twice.
    """
    stored = F.regexp_extract("pseudonym", r"_([0-9]{1,9})$", 1)
    named = prior.where((stored != "") & F.col("pseudonym").startswith(F.concat("label", F.lit("_")))).select("record_id", "label", stored.cast("int").alias("n"))
    return named.unionByName(counters.select("record_id", "label", "n")).groupBy("record_id", "label").agg(F.max("n").alias("used"))


def numbered(found: DataFrame, prior: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """The mapping for occurrences: prior entries, and new values in order of (page_no, start) with the next numbers.

    New values are numbered page range by page range, each range going on from the count of those before, so a record
    with very many values isn't numbered in one task.
    """
    spark = found.sparkSession
    key = ["record_id", "label", "norm_key"]
    first = found.groupBy(*key).agg(F.min_by(F.struct("page_no", "start", "doc_id", "original"), F.struct("page_no", "start", "doc_id")).alias("at"))
    prior = empty_mapping(spark) if prior is None else prior
    counters = spark.createDataFrame([], COUNTERS) if counters is None else counters
    new = first.join(prior.select(*key).distinct(), key, "left_anti").withColumn("range", F.floor(F.col("at.page_no") / PAGES))
    per = new.groupBy("record_id", "label", "range").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy("record_id", "label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("record_id", "label", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    used = next_numbers(prior, counters)
    place = F.row_number().over(Window.partitionBy("record_id", "label", "range").orderBy("at.page_no", "at.start", "at.doc_id", "norm_key"))
    rows = new.withColumn("place", place).join(offsets, ["record_id", "label", "range"]).join(used, ["record_id", "label"], "left")
    number = F.coalesce("used", F.lit(0)) + F.col("offset") + F.col("place")
    fresh = rows.select(*key, F.concat("label", F.lit("_"), number.cast("string")).alias("pseudonym"), F.col("at.original").alias("original"))
    return prior.select(*key, "pseudonym", "original").unionByName(fresh)


def counters_of(mapping: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """(record_id, label, n) to store with a mapping."""
    none = mapping.sparkSession.createDataFrame([], COUNTERS)
    return next_numbers(mapping, none if counters is None else counters).select("record_id", "label", F.col("used").cast("int").alias("n"))


def hashed(found: DataFrame, prior: DataFrame | None = None, secret: str | None = None, digits: int = 6) -> DataFrame:
    """The mapping for occurrences by tokens: prior entries, and those of new values with their first spelling."""
    key = ["record_id", "label", "norm_key"]
    first = found.groupBy(*key).agg(F.min_by(F.struct("original", "category"), F.struct("page_no", "start", "doc_id")).alias("at"))
    prior = empty_mapping(found.sparkSession) if prior is None else prior
    new = first.join(prior.select(*key).distinct(), key, "left_anti")
    made = new.select(*key, token(F.col("at.category"), F.col("at.original"), secret, digits).alias("pseudonym"), F.col("at.original").alias("original"))
    return prior.select(*key, "pseudonym", "original").unionByName(made)


def collisions(mapping: DataFrame) -> DataFrame:
    """(label, pseudonym, n): tokens that stand for several values."""
    return mapping.groupBy("label", "pseudonym").agg(F.count_distinct("norm_key").cast("bigint").alias("n")).where("n > 1")


def deidentify(
    docs: DataFrame, spans: DataFrame, strategy: str = "counter", record: str = "doc_id", page: str = "doc_id",
    prior: DataFrame | None = None, counters: DataFrame | None = None, secret: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(docs with pseudonyms in their texts, the mapping). strategy is counter or hash; another is a ValueError.

    With hash, a value that the prior mapping has under another pseudonym is replaced by its token all the same.
    """
    if strategy == "hash":
        text = replaced(docs, spans, lambda s: token(s["category"], s["text"], secret))
        return text, hashed(occurrences(docs, spans, record, page), prior, secret)
    if strategy != "counter":
        raise ValueError(f"strategy must be 'counter' or 'hash', got {strategy!r}")
    found = occurrences(docs, spans, record, page)
    mapping = numbered(found, prior, counters)
    known = found.select("record_id", "label", "norm_key", "doc_id", "start").join(mapping.select("record_id", "label", "norm_key", "pseudonym"), ["record_id", "label", "norm_key"])
    mine, named = unused(docs, "spans"), unused(docs, "names")
    names = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("start", "pseudonym"))).alias(named))
    rows = docs.join(gathered(spans).withColumnRenamed("spans", mine).join(names, "doc_id").hint("shuffle_hash"), "doc_id", "left")
    rows = rows.withColumn(mine, F.when(F.col(mine).isNotNull(), merge_in_row(F.col("text"), F.col(mine))))
    text = F.when(F.col(mine).isNull(), F.col("text")).otherwise(rebuilt(F.col("text"), F.col(mine), lambda s: F.element_at(named, s["start"])))
    return rows.withColumn("text", text).select(*docs.columns), mapping


def anonymize(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with their texts' spans generalised; nothing is kept."""
    return replaced(docs, spans, lambda s: generalized(s["category"], s["text"]))


def exported(mapping: DataFrame, counters: DataFrame) -> DataFrame:
    """(record_id, mapping): each record's entries and counters as JSON. A pseudonym of two values keeps the last spelling in order."""
    entries = mapping.groupBy("record_id", "label", "pseudonym").agg(F.max_by("original", "norm_key").alias("original"))
    by_label = entries.groupBy("record_id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pseudonym", "original")))).alias("names"))
    whole = by_label.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "names"))).alias("entries"))
    counts = counters.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counters"))
    empty = F.create_map().cast("map<string,int>")
    return whole.join(counts, "record_id", "left").select("record_id", F.to_json(F.struct("entries", F.coalesce("counters", empty).alias("counters"))).alias("mapping"))


def imported(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, counters) of (record_id, mapping JSON); null gives none."""
    kind = "entries map<string,map<string,string>>, counters map<string,int>"
    rows = stored.select(F.col("record_id").cast("string").alias("record_id"), F.from_json("mapping", kind).alias("m")).where("m is not null")
    labels = rows.select("record_id", F.explode("m.entries").alias("label", "names"))
    flat = labels.select("record_id", "label", F.explode("names").alias("pseudonym", "original"))
    mapping = flat.withColumn("norm_key", normal(F.col("original"))).select("record_id", "label", "norm_key", "pseudonym", "original")
    return mapping, rows.select("record_id", F.explode("m.counters").alias("label", "n"))


def flattened(mapping: DataFrame) -> DataFrame:
    """(record_id, label, pseudonym, original), as a table to show."""
    return mapping.select("record_id", "label", "pseudonym", "original")


def relinked(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """names (record_id, pseudonym) with their originals: the way back for whoever holds the mapping. Our own addition."""
    return names.join(mapping.select("record_id", "pseudonym", "original"), ["record_id", "pseudonym"])

