"""Streams of texts: the batch's row expressions where rows are independent, keyed state where numbers go on from page to page."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.functions.generalize import generalized
from hushframe.functions.text import normal, token
from hushframe.operators.spans import mask, merge_in_row, rebuilt, unused
from hushframe.sources.rules import RULES, either, spans_in_row
from hushframe.taxonomy import label_of


def _replaced(docs: DataFrame, substitute, rules) -> DataFrame:
    # few texts hold a match: the others are looked at once
    text, name = F.col("text"), unused(docs, "spans")
    rows = docs.withColumn(name, F.when(text.rlike(either(rules)), merge_in_row(text, spans_in_row(text, rules))))
    return rows.withColumn("text", F.when(F.col(name).isNull(), text).otherwise(rebuilt(text, F.col(name), substitute))).select(*docs.columns)


def redacted(docs: DataFrame, template: str = "[REDACTED]", rules=RULES) -> DataFrame:
    """A stream or table with the rules' matches masked; no shuffle, no state."""
    return _replaced(docs, mask(template), rules)


def anonymized(docs: DataFrame, rules=RULES) -> DataFrame:
    return _replaced(docs, lambda s: generalized(s["category"], s["text"]), rules)


def hashed(docs: DataFrame, secret: str | None = None, rules=RULES) -> DataFrame:
    return _replaced(docs, lambda s: token(s["category"], s["text"], secret), rules)


def numbered(docs: DataFrame, rules=RULES) -> DataFrame:
    """A stream (record_id, page_no, doc_id, text) with numbered pseudonyms that go on over the record's pages, and each page's new entries.

    Gives record_id, page_no, doc_id, text and entries, a map of new pseudonyms to originals. Pages of one batch are
    taken in order of page_no; a page that comes late goes on from what was numbered before it. The state of a record
    holds its values: keep the checkpoint as safe as the mapping.
    """
    text = F.col("text")
    spans = F.when(text.rlike(either(rules)), merge_in_row(text, spans_in_row(text, rules)))
    found = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), label_of(s["category"]).alias("label"), normal(s["text"]).alias("norm"), s["text"].alias("original")))
    rows = docs.select(F.col("record_id").cast("string").alias("record_id"), F.col("page_no").cast("bigint").alias("page_no"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.to_json(found).alias("found"))
    out = "record_id string, page_no bigint, doc_id bigint, text string, entries map<string,string>"
    return rows.groupBy("record_id").applyInPandasWithState(_number, out, "names string, counters string", "append", GroupStateTimeout.NoTimeout)


def _number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names, counters = ({}, {}) if not state.exists else map(json.loads, state.get)
    pages = pd.concat(list(frames)).sort_values(["page_no", "doc_id"], kind="stable")
    done = []
    for page, doc, text, found in zip(pages["page_no"], pages["doc_id"], pages["text"], pages["found"]):
        parts, at, fresh = [], 0, {}
        for s in json.loads(found) if isinstance(found, str) else []:
            value = s["label"] + "\x00" + s["norm"]
            if value not in names:
                counters[s["label"]] = counters.get(s["label"], 0) + 1
                names[value] = f"{s['label']}_{counters[s['label']]}"
                fresh[names[value]] = s["original"]
            parts += [text[at : s["start"]], names[value]]
            at = s["end"]
        done.append((key[0], page, doc, None if text is None else "".join(parts) + text[at:], fresh))
    state.update((json.dumps(names), json.dumps(counters)))
    yield pd.DataFrame(done, columns=["record_id", "page_no", "doc_id", "text", "entries"])


def once(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream (record_id, page_no, ts, ...) without pages that come again within the delay."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record_id", "page_no"])


def counted(events: DataFrame, by: Column | str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, by, n) of a stream or table with a timestamp ts: our own addition."""
    by = F.col(by) if isinstance(by, str) else by
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), by).agg(F.count("*").alias("n")).withColumn("start", F.col("w.start")).drop("w")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table: runs it to the end of its input into Parquet files beside its checkpoint.

    Rows are added to the files; a stream in mode complete writes them anew with each batch.
    """
    rows, out = f"{checkpoint}-rows", stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(rows)) if mode == "complete" else out.format("parquet").option("path", rows)
    out.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
