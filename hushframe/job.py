"""A batch job over a table of texts: python -m hushframe.job redact --input IN --output OUT, and the like.

Every flag has a setting of the session, spark.hushframe.<flag>, which counts where the flag isn't given; give secrets
that way, as Spark hides settings of that name.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import pseudonyms
from hushframe.operators import spans as sp
from hushframe.sources.rules import rule_spans
from hushframe.taxonomy import checked

TASKS = ("detect", "redact", "anonymize", "deidentify")
#: Flags and what they are where neither they nor the settings say.
FLAGS = {
    "input": None, "output": None, "format": "parquet", "output-format": "parquet", "key": "doc_id", "text": "text", "categories": None, "mask": sp.REDACTED,
    "strategy": "counter", "record": None, "page": None, "secret": None, "mapping": None, "mapping-output": None,
}


def options(spark: SparkSession, arguments: Sequence[str]) -> argparse.Namespace:
    """Flags, then settings, then defaults. A missing input or output, or a flag that isn't one, ends the job with a message."""
    parser = argparse.ArgumentParser(prog="hushframe.job", description="Finds personal data in a table of texts, or removes it.")
    parser.add_argument("task", choices=TASKS)
    for name, default in FLAGS.items():
        parser.add_argument(f"--{name}", default=spark.conf.get(f"spark.hushframe.{name}", default))
    given = parser.parse_args(arguments)
    for name in ("input", "output"):
        if not getattr(given, name):
            parser.error(f"--{name} or spark.hushframe.{name} is needed")
    if given.task == "deidentify" and not given.mapping_output:
        parser.error("--mapping-output is needed: without it the pseudonyms lead nowhere")
    given.categories = checked([c for c in given.categories.split(",") if c]) if given.categories is not None else None
    return given


def applied(docs: DataFrame, given: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    """(what the task gives for docs (doc_id, text), the mapping if there is one)."""
    found = rule_spans(docs, given.categories)
    if given.task == "detect":
        return found, None
    if given.task == "redact":
        return sp.redact(docs, found, given.mask), None
    if given.task == "anonymize":
        return pseudonyms.anonymize(docs, found), None
    prior = docs.sparkSession.read.parquet(given.mapping) if given.mapping else None
    return pseudonyms.deidentify(docs, found, given.strategy, given.record or "doc_id", given.page or "doc_id", prior=prior, secret=given.secret)


def main(arguments: Sequence[str] | None = None) -> None:
    """Writes the result, and the mapping of pseudonyms, and prints a row for each category; an output that is there is an error."""
    spark = SparkSession.builder.appName("hushframe").getOrCreate()
    given = options(spark, arguments)
    docs = spark.read.format(given.format).load(given.input).withColumnsRenamed({given.key: "doc_id", given.text: "text"})
    rows, mapping = applied(docs, given)
    rows.write.format(given.output_format).save(given.output)
    if mapping is not None:
        mapping.write.parquet(given.mapping_output)
    if given.task == "detect":
        spark.read.schema(rows.schema).format(given.output_format).load(given.output).groupBy("l1", "category").agg(F.count("*").alias("n")).orderBy("l1", "category").show(100, False)


if __name__ == "__main__":
    main()
