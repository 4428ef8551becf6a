"""Detectors that the caller brings: functions built once a Python worker, fed in Arrow batches."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import is_blank
from hushframe.operators.spans import only
from hushframe.taxonomy import checked, group_of

TOKENS = "doc_id bigint, chunk_idx int, tok_idx int, char_start int, char_end int, label string, score double"


def require(module: str, hint: str) -> None:
    """ImportError with the hint if a module is absent: to be called before anything is fetched or read."""
    if importlib.util.find_spec(module) is None:
        raise ImportError(f"{module} is not installed: {hint}")


#: What this Python worker has built, by the digest of what builds it.
_BUILT: dict[str, object] = {}


def once_a_worker(make: Callable[[], object]) -> Callable[[], object]:
    """A function that gives what make() builds, and builds it when a Python worker first asks: its later tasks find it there."""
    key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def get() -> object:
        if key not in _BUILT:
            _BUILT[key] = make()
        return _BUILT[key]

    return get


def located(source: str, part: str | None = None) -> str:
    """The folder of a model, for use where it is built: a local folder, or a name that spark.sparkContext.addArchive or addFile shipped.

    If the folder has one named `part`, that one. FileNotFoundError if neither is there: nothing is fetched.
    """
    for folder in (source, *([SparkFiles.get(source)] if not os.path.isabs(source) else [])):
        if os.path.isdir(folder):
            inner = os.path.join(folder, part or "")
            return inner if part and os.path.isdir(inner) else folder
    raise FileNotFoundError(f"no folder {source}, and nothing of that name was shipped with the job")


def token_labels(docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[list[tuple]]]]) -> DataFrame:
    """The tokens table that a model gives for docs (doc_id, text).

    make() builds the model; it takes a list of texts and gives, for each, tuples (chunk_idx, tok_idx, char_start,
    char_end, label, score). Blank and null texts never reach it. Base filters belong before this call: it isn't
    deterministic for the optimiser and runs once for each row.
    """

    built = once_a_worker(make)

    def run(frames):
        model = built()
        for pdf in frames:
            rows = [(doc, *t) for doc, found in zip(pdf["doc_id"], model(pdf["text"].tolist())) for t in found]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "tok_idx", "char_start", "char_end", "label", "score"])

    return docs.where(F.col("text").isNotNull() & ~is_blank(F.col("text"))).select("doc_id", "text").mapInPandas(run, TOKENS)


def visual_entities(pages: DataFrame, make: Callable[[], Callable[[bytes, float], Iterable[tuple]]], threshold: float = 0.25, categories: Iterable[str] | None = None) -> DataFrame:
    """Visual entities of pages (page_id, content): make() gives a function of bytes and threshold to (category, box, score)."""
    asked, built = checked(categories), once_a_worker(make)

    def run(frames):
        find = built()
        for pdf in frames:
            rows = []
            for page, data in zip(pdf["page_id"], pdf["content"]):
                for category, b, score in find(bytes(data), threshold):
                    if score >= threshold:
                        rows.append((page, len(rows), category, "visual", dict(zip(("x0", "y0", "x1", "y1"), map(int, b))), None, round(float(score), 4)))
            yield pd.DataFrame(rows, columns=["page_id", "ent_idx", "category", "kind", "bbox", "text", "score"])

    kind = "page_id bigint, ent_idx int, category string, kind string, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string, score double"
    found = pages.select("page_id", "content").mapInPandas(run, kind)
    return only(found, asked).withColumn("l1", group_of(F.col("category")))


def both_kinds(text: DataFrame, visual: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
    """Text entities and visual ones of the pages, in that order by (page_id, kind, ent_idx), of the categories asked for."""
    return only(text.unionByName(visual, allowMissingColumns=True), categories)
