"""The rules of `spans` in numpy and Arrow, for texts with very many spans: union, merge and texts with spans replaced.

Array expressions on a row take microseconds for each span. Here the spans of many texts are worked on at once, and what
they cut out of the texts is copied in one step. Spans come as an expression over docs, the array of a text's spans as
`spans.placed` has them, so nothing is shuffled. Places outside a text count as its nearest end where it is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.generalize import general_of
from hushframe.operators.spans import REDACTED, SPAN_COLUMNS, mask_of, unused

#: Spans, and bytes of text, that are worked on at once, if a single text has no more.
SPANS, BYTES = 1 << 15, 1 << 19
#: White space of more than one byte, as Unicode and Python have it.
WIDE_SPACE = np.array(sorted(c for c in range(128, 0x3001) if chr(c).isspace()))
ASCII_SPACE = np.array([c < 128 and chr(c).isspace() for c in range(256)])

#: Matches every text with a decimal digit, of whatever script.
DIGITS = r"[0-9]|[^\x00-\x7F]"

#: What takes the place of a span by category and l1: a text, None for the span's own text, or what a text without a
#: digit becomes and the function that makes it of any text.
Substitute = Callable[[str, str], "str | tuple[str, Callable[[str], str]] | None"]


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where in them each begins and the last ends. Null is empty."""
    strings = pc.fill_null(strings, "").cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _copied(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[begin:end] of each pair, one after the other, and where each begins and the last ends."""
    size = end - begin
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])], at


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    if at[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of text in one piece")
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


class Texts:
    """Texts with their characters' places in the bytes."""

    def __init__(self, texts: pa.Array):
        self.known = ~np.asarray(texts.is_null())
        self.data, self.at = _bytes(texts)
        first = (self.data & 0xC0) != 0x80
        self.head = np.concatenate([np.flatnonzero(first), [len(self.data)]])
        self.begin = np.searchsorted(self.head, self.at)
        self.chars = np.diff(self.begin)

    def character(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number among all characters of the one at a place of a text."""
        return self.begin[row] + np.clip(place, 0, self.chars[row])

    def byte(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.head[self.character(row, place)]

    def blanks(self) -> np.ndarray:
        """How many characters before each are white space."""
        lead = self.data[self.head[:-1]]
        blank = ASCII_SPACE[lead]
        for size, low, bits in ((2, 0xC2, 0x1F), (3, 0xE1, 0x0F)):
            found = np.flatnonzero((lead >= low) & (lead <= (0xC2 if size == 2 else 0xE3)))
            found = found[self.head[found] + size <= len(self.data)]
            code = self.data[self.head[found]].astype(np.int64) & bits
            for k in range(1, size):
                code = code << 6 | (self.data[self.head[found] + k] & 0x3F)
            blank[found] = np.isin(code, WIDE_SPACE)
        return np.concatenate([[0], np.cumsum(blank)])


class Spans:
    """Spans of many texts, in order: row, start and end, the given span that describes each, and whether its text is that one's."""

    def __init__(self, lists: pa.Array):
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        self.given = lists.flatten()
        row, field = np.repeat(np.arange(len(lists)), size), self.field
        start, end, idx = (np.asarray(field(k)).astype(np.int64) for k in ("start", "end", "span_idx"))
        like = np.flatnonzero(end > start)
        row, start, end, idx = row[like], start[like], end[like], idx[like]
        same, tie = row[1:] == row[:-1], start[1:] == start[:-1]
        if (same & ((start[1:] < start[:-1]) | tie & ((end[1:] > end[:-1]) | (end[1:] == end[:-1]) & (idx[1:] < idx[:-1])))).any():
            order = np.lexsort((idx, -end, start, row))
            row, start, end, like = row[order], start[order], end[order], like[order]
        self.row, self.start, self.end, self.like = row, start, end, like
        self.own = np.ones(len(row), bool)

    def field(self, name: str) -> pa.Array:
        return pc.struct_field(self.given, name)

    def unite(self) -> None:
        """Overlapping spans as one, described by the widest (of equals, the first); spans that only touch stay apart."""
        if not len(self.row):
            return
        row, start, end = self.row, self.start, self.end
        wide = int(end.max() - min(start.min(), 0)) + 1
        last = np.maximum.accumulate(end + row * wide)  # of all spans so far; texts lie one after the other
        heads = np.concatenate([[True], start[1:] + row[1:] * wide >= last[:-1]])
        at, group = np.flatnonzero(heads), np.cumsum(heads) - 1
        width = end - start
        widest = np.flatnonzero(width == np.maximum.reduceat(width, at)[group])
        widest = widest[np.concatenate([[True], group[widest][1:] != group[widest][:-1]])]
        self.row, self.start = row[at], start[at]
        self.end = last[np.append(at[1:], len(row)) - 1] - self.row * wide
        self.like = self.like[widest]
        self.own = (start[widest] == self.start) & (end[widest] == self.end)

    def merge(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Unions of one category with nothing but white space between as one. Where each begins among the unions, and how many it has."""
        if not len(self.row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = np.asarray(self.field("category").dictionary_encode().indices.fill_null(-1))[self.like]
        before, after = texts.character(self.row[:-1], self.end[:-1]), texts.character(self.row[1:], self.start[1:])
        blanks = texts.blanks()
        joins = (self.row[1:] == self.row[:-1]) & (kind[1:] == kind[:-1]) & (kind[1:] >= 0) & texts.known[self.row[1:]] & (blanks[after] - blanks[before] == after - before)
        at = np.flatnonzero(np.concatenate([[True], ~joins]))
        n = np.diff(np.append(at, len(self.row)))
        self.end = self.end[at + n - 1]
        self.row, self.start, self.like, self.own = self.row[at], self.start[at], self.like[at], self.own[at] & (n == 1)
        return at, n

    def texts(self, texts: Texts) -> pa.Array:
        """The text of each: as given, or cut out, which is null where the text is."""
        cut = _strings(*_copied(texts.data, texts.byte(self.row, self.start), texts.byte(self.row, self.end)))
        cut = pc.if_else(pa.array(texts.known[self.row]), cut, pa.scalar(None, pa.string()))
        return pc.if_else(pa.array(self.own), self.field("text").take(pa.array(self.like)).cast(pa.string()), cut)


def _slices(batches: Iterator[pa.RecordBatch], spans: str, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into ones with about SPANS spans or BYTES of text at most."""
    for batch in batches:
        n = np.asarray(pc.fill_null(pc.list_value_length(batch[spans]), 0)) / SPANS
        size = n + np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0)) / BYTES
        part = np.floor(np.cumsum(size)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def union_overlapping(docs: DataFrame, spans: Column) -> DataFrame:
    """The spans table with overlapping spans united."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "spans"):
            found, texts = Spans(b["spans"]), Texts(b["text"])
            found.unite()
            first = np.concatenate([[True], found.row[1:] != found.row[:-1]])[: len(found.row)]
            number = np.arange(len(found.row))
            number = number - np.maximum.accumulate(np.where(first, number, 0))
            like = pa.array(found.like)
            columns = {
                "doc_id": b["doc_id"].take(pa.array(found.row)), "span_idx": pa.array(number.astype(np.int32)), "category": found.field("category").take(like),
                "start": pa.array(found.start.astype(np.int32)), "end": pa.array(found.end.astype(np.int32)), "l1": found.field("l1").take(like),
                "text": found.texts(texts), "score": found.field("score").take(like),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", spans.alias("spans")).mapInArrow(rows, SPAN_COLUMNS)


def _substitutes(found: Spans, texts: Texts, substitute: Substitute) -> tuple[pa.Array, np.ndarray]:
    """Substitutes, and which of them each span gets."""
    like = pa.array(found.like)
    kinds, groups = (found.field(k).fill_null("").dictionary_encode() for k in ("category", "l1"))
    kind, group = (np.asarray(x.indices.take(like)) for x in (kinds, groups))
    pair = kind * max(1, len(groups.dictionary)) + group
    own: pa.Array | None = None
    values: list[pa.Array] = []
    which, many = np.zeros(len(pair), np.int64), 0
    for p in np.unique(pair):
        here = np.flatnonzero(pair == p)
        by = substitute(kinds.dictionary[p // len(groups.dictionary)].as_py(), groups.dictionary[p % len(groups.dictionary)].as_py())
        if isinstance(by, str):
            made, place = pa.array([by]), np.zeros(len(here), np.int64)
        else:
            own = found.texts(texts) if own is None else own
            made, place = own.take(pa.array(here)), np.arange(len(here))
        if isinstance(by, tuple):
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(made, DIGITS), False))
            made, place = pa.array([by[0], *map(by[1], made.take(pa.array(some)).to_pylist())], pa.string()), np.zeros(len(here), np.int64)
            place[some] = np.arange(1, len(some) + 1)
        which[here] = many + place
        values, many = [*values, made], many + len(made)
    return pa.concat_arrays(values) if values else pa.array([], pa.string()), which


def replaced(docs: DataFrame, spans: Column, substitute: Substitute, merge: bool = True) -> DataFrame:
    """docs with their texts' spans replaced, after uniting and (if merge) merging; texts without spans as they are."""
    name, columns = unused(docs, "spans"), docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, name):
            found, texts = Spans(b[name]), Texts(b["text"])
            found.unite()
            if merge:
                found.merge(texts)
            values, which = _substitutes(found, texts, substitute)
            data, at = _bytes(values)
            # a text's pieces: before each span what is left since the one before it, and its substitute; at last the rest
            n, row, j = len(found.row), found.row, np.arange(len(found.row))
            rest = 2 * np.searchsorted(row, np.arange(b.num_rows), "right") + np.arange(b.num_rows)
            begin, end = np.zeros(2 * n + b.num_rows, np.int64), np.zeros(2 * n + b.num_rows, np.int64)
            start, stop = texts.byte(row, found.start), texts.byte(row, found.end)
            fresh = np.concatenate([[True], row[1:] != row[:-1]])[:n]
            begin[2 * j + row] = np.where(fresh, texts.at[row], np.concatenate([[0], stop])[:n])
            end[2 * j + row] = start
            begin[2 * j + row + 1], end[2 * j + row + 1] = len(texts.data) + at[which], len(texts.data) + at[which + 1]
            begin[rest], end[rest] = texts.at[:-1], texts.at[1:]
            some = np.flatnonzero(np.append(row[1:] != row[:-1], True)[:n])
            begin[rest[row[some]]] = stop[some]
            out, places = _copied(np.concatenate([texts.data, data]), begin, end)
            text = _strings(out, places[np.concatenate([[0], rest + 1])])
            text = pc.if_else(pa.array(texts.known), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([text if c == "text" else b[c] for c in columns], columns)

    return docs.withColumn(name, spans).mapInArrow(rows, docs.schema)


def redact(docs: DataFrame, spans: Column, template: str = REDACTED) -> DataFrame:
    return replaced(docs, spans, mask_of(template))


def apply_mask(docs: DataFrame, spans: Column, template: str = REDACTED) -> DataFrame:
    """As `redact`, but neighbours of one category keep a mask each."""
    return replaced(docs, spans, mask_of(template), merge=False)


def anonymize(docs: DataFrame, spans: Column) -> DataFrame:
    """docs with their texts' spans generalised; nothing is kept."""
    return replaced(docs, spans, general_of)
