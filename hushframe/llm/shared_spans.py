"""Runs of words that repeat across documents, wherever they stand in a line: paragraphs of 51 words, met by a MinHash band and compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm import textops
from hushframe.llm.common import cut, free_name, partitions, slices
from hushframe.llm.set_links import _texts, text_key

#: Words of a paragraph, and of its shingles, of which the least hash is its band.
WINDOW, GRAM = 51, 26
U = np.uint64


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out += hashes[j : n + j] * textops.TERM[j]
    return textops.mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def _windows(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, band) of each window that lies in one row."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(len(hashes) - WINDOW + 1)
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + WINDOW <= bounds[row + 1]
    return at[inside], row[inside], _least(_grams(hashes, GRAM), WINDOW - GRAM + 1)[inside]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, starts = textops.payload(column)
    begin, end, bounds = textops.words(buf, starts)
    return textops.word_hashes(buf, begin, end), bounds, begin - starts[np.searchsorted(starts, begin, side="right") - 1], end - begin


def _news(*columns: np.ndarray) -> np.ndarray:
    """Where a value of sorted columns differs from the one before."""
    if not len(columns[0]):
        return np.empty(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _packed(ranges: int, key: np.ndarray, names: str, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows by range of the key's hash; columns as bytes under the letters of names, of a, b, c, d."""
    home = ((key >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(cuts))
    by = {n: pa.array([y[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary()) for n, y in zip(names, (x[order] for x in columns))}
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[by.get(n, pa.nulls(len(full), pa.binary())) for n in "abcd"]], names=["range", *"abcd"])


PACKED = "range int, a binary, b binary, c binary, d binary"


def _unpacked(rows: pa.Table, *types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x for x in rows.column(c).to_pylist() if x), t) for c, t in zip("abcd", types)]


def _by_row(ids: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each id and row, the other columns as bytes; ids and rows are sorted."""
    first = np.flatnonzero(_news(ids, rows))
    ends = [*first[1:].tolist(), len(ids)]
    packed = [pa.array([x[b:e].tobytes() for b, e in zip(first.tolist(), ends)], pa.binary()) for x in columns]
    return pa.table([pa.array(ids[first], pa.int64()), pa.array(rows[first], pa.int64()), *packed], names=["id", "row", *"abc"[: len(columns)]])


def shared_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, first_word, n_words, kept_doc_id, kept_word): runs of words of docs (doc_id, text) that an earlier document has too.

    Every window of 51 words is a paragraph (A-Z read as a-z, white space of any kind between), so passages are found
    wherever they begin. A paragraph signs with the least hash of its shingles of 26 words: a MinHash band of one row,
    so that equal paragraphs always meet. Those that meet are compared exactly, all 51 words of them. What two
    documents share stays in the one of the smallest (doc_id, text_key, word); the paragraphs of the others, those
    that overlap or touch as one run, are named here. kept_doc_id and kept_word are where the run's first one stays.

    Repeats within one document stay, and rows of one doc_id count as one document (text_key tells their texts apart);
    rows with a null doc_id are left alone; null, empty and short texts have no runs; an empty table gives none; other
    columns, whatever their names, are not read.
    """
    ranges = 4 * partitions(docs.sparkSession)
    texts = _texts(docs.where("doc_id is not null"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            hashes, bounds, *_ = _words(batch.column("t"))
            _, row, sig = _windows(hashes, bounds)
            ids = batch.column("id").to_numpy()[row]
            some = np.flatnonzero(_news(row, sig))
            order = some[np.lexsort((ids[some], sig[some]))]
            sig, ids = sig[order], ids[order]
            new = _news(sig, ids)
            sig, ids = sig[new], ids[new]
            if not len(sig):
                continue
            # of a band that documents of this slice share, one entry goes on; that the documents share it is known here
            first = _news(sig)
            shared = ~first | np.concatenate([~first[1:], [False]])
            yield _packed(ranges, sig[first], "ab", sig[first], ids[first])
            if shared.any():
                yield _packed(ranges, textops.mix(ids[shared].view(U)), "cd", sig[shared], ids[shared])

    def met(rows: pa.Table) -> pa.Table:
        sig, ids, known, whose = _unpacked(rows, U, np.int64, U, np.int64)
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        new = _news(sig, ids)
        sig, ids = sig[new], ids[new]
        first = _news(sig)
        hot = ~first | np.concatenate([~first[1:], [False]]) if len(sig) else first
        sig, ids = np.concatenate([sig[hot], known]), np.concatenate([ids[hot], whose])
        order = np.argsort(ids, kind="stable")
        return _by_row(ids[order], np.zeros(len(ids), np.int64), sig[order]).select(["id", "a"])

    signed = texts.mapInArrow(sign, PACKED).groupBy("range").applyInArrow(met, "id bigint, a binary")
    hot = cut(signed.groupBy("id").agg(F.collect_list("a").alias("hot")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            hashes, bounds, *_ = _words(batch.column("t"))
            at, row, sig = _windows(hashes, bounds)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            keep = [b + np.flatnonzero(np.isin(sig[b:e], np.frombuffer(b"".join(h), U))) for b, e, h in zip(cuts[:-1], cuts[1:], batch.column("hot").to_pylist())]
            keep = np.concatenate(keep).astype(np.int64)
            if len(keep):
                at, row = at[keep], row[keep]
                ids, texts = (batch.column(c).to_numpy()[row] for c in ("id", "row"))
                key = _grams(hashes, WINDOW)[at]
                yield _packed(ranges, key, "abcd", key, ids, texts, (at - bounds[row]).astype(np.int32))

    def later(rows: pa.Table) -> pa.Table:
        key, ids, texts, at = _unpacked(rows, U, np.int64, np.int64, np.int32)
        order = np.lexsort((at, texts, ids, key))
        key, ids, texts, at = key[order], ids[order], texts[order], at[order]
        head = np.maximum.accumulate(np.where(_news(key), np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)
        gone = np.flatnonzero(ids != ids[head])
        gone = gone[np.lexsort((texts[gone], ids[gone]))]
        return _by_row(ids[gone], texts[gone], at[gone], ids[head[gone]], at[head[gone]])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, row, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "parts"))):
                at, kept, place = (np.frombuffer(b"".join(p[c] for p in parts), t) for c, t in (("a", np.int32), ("b", np.int64), ("c", np.int32)))
                order = np.argsort(at, kind="stable")
                at, kept, place = at[order], kept[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(at) > WINDOW]))
                last = np.concatenate([first[1:], [len(at)]]) - 1
                n = len(first)
                for o, v in zip(out, ([i] * n, [row] * n, at[first], at[last] + WINDOW - at[first], kept[first], place[first])):
                    o.extend(v if isinstance(v, list) else v.tolist())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["doc_id", "text_key", "first_word", "n_words", "kept_doc_id", "kept_word"])

    with_hot = texts.join(hot.hint("shuffle_hash"), "id")
    found = with_hot.mapInArrow(windows, PACKED).groupBy("range").applyInArrow(later, "id bigint, row bigint, a binary, b binary, c binary")
    gathered = found.groupBy("id", "row").agg(F.collect_list(F.struct("a", "b", "c")).alias("parts"))
    return gathered.mapInArrow(runs, "doc_id bigint, text_key bigint, first_word int, n_words int, kept_doc_id bigint, kept_word int")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the runs of words that spans (doc_id, text_key, first_word, n_words) name; n_chars, if there, follows the text.

    Runs may overlap. White space around a run stays. Rows of which nothing is left are dropped; all others stay, with
    all columns, whatever their names: rows that repeat an id lose only what their own text's runs name, and rows with a
    null doc_id or text are left alone. Without spans nothing changes.
    """
    mine, key, there = (free_name(docs, n) for n in ("gone", "key", "id"))
    gone = cut(spans.groupBy(F.col("doc_id").alias(there), F.col("text_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias(mine)))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column(mine).to_pylist()):
                if text is not None and runs:
                    data = text.encode()
                    _, _, begin, size = _words(pa.array([data], pa.binary()))
                    parts, at = [], 0
                    for r in runs:
                        parts.append(data[at : max(at, begin[r["first_word"]])])
                        last = r["first_word"] + r["n_words"] - 1
                        at = max(at, begin[last] + size[last])
                    text = b"".join([*parts, data[at:]]).decode()
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(there, F.col("doc_id").cast("bigint"))
    both = keyed.join(gone.hint("shuffle_hash"), [there, key], "left").select(*docs.columns, mine)
    both = both.mapInArrow(left, both.schema).where(F.col(mine).isNull() | (F.trim("text") != "")).drop(mine)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return both
