"""SentencePiece encoding and decoding: a Viterbi pass over distinct marked words in sorted order, sharing prefixes."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import slices, table

MARK = "▁"
#: Words that a worker remembers between slices, and pairs of pieces; beyond, it starts anew.
WORDS, PAIRS = 100_000, 400_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LOADED: dict[str, "Pieces"] = {}


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {5: 4, 1: 8}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces and the forward pass over its words.

    Forward states are kept for each prefix of the word at hand. In a unigram model a state is the best score of the
    prefix and its last piece. In a BPE model scores are ranks of merges, and their sums mean nothing: there an arc
    counts only if merging the last piece and the next one together gives just these two, and exactly one path of
    such arcs exists, which is the one that merging gives. So a state is the last piece alone. Either way states
    depend on the prefix only, and the next word in sorted order goes on from what it shares with the one before.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, self.unigram, norm = [], True, {}
        for key, value in _fields(data):
            if key == 1:
                pieces.append(dict(_fields(value)))
            elif key == 2:
                trainer = dict(_fields(value))
                self.unigram = trainer.get(3, 1) == 1
                if trainer.get(3, 1) not in (1, 2) or trainer.get(24, 0):
                    raise ValueError("unigram and BPE models with marks before words only")
            elif key == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("models that keep texts as they are only: no character map, no removal of spaces")
        self.prefix = bool(norm.get(3, 1))
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.names, self.unknown = names, kinds.index(2)
        if any(k in (4, 5) for k in kinds) or any(MARK in n.lstrip(MARK) for n, k in zip(names, kinds) if k == 1):
            raise ValueError("user-defined or unused pieces, or marks within pieces")
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 1}
        self.byte = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == 6}
        low = min(self.score[i] for i in self.ids.values())
        self.unknown_score = low - 10.0
        #: What each id decodes to.
        self.bytes = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else n.replace(MARK, " ").encode() for n, k in zip(names, kinds)]
        self.ends: dict = {}  # pieces by their characters from the last to the first
        for n, i in self.ids.items():
            node = self.ends
            for c in reversed(n):
                node = node.setdefault(c, {})
            node[""] = i
        #: For each last piece, -1 first, what is known of the pieces after it.
        self.pairs: list[dict[int, bool] | None] = [None] * (len(names) + 1)
        self.known_pairs = 0
        self.words: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[str]:
        """The word by repeated merging of the two neighbours whose union has the highest score, leftmost first."""
        parts, ids, score = list(word), self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or score[piece] > best):
                    best, at = score[piece], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether merging gives these two pieces for their characters; before is -1 at the word's start or after an unknown character.

        As soon as a merge reaches across the border, the answer is no.
        """
        ids, score = self.ids, self.score
        left = self.names[before] if before >= 0 else ""
        parts = list(left + self.names[piece])
        border = len(left)  # parts before it make up the first piece
        ranks = [score[p] if (p := ids.get(x + y)) is not None else None for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    p = ids.get(parts[i] + parts[i + 1])
                    ranks[i] = None if p is None else score[p]
        return len(parts) == 1 + (before >= 0)

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words: depth-first through the trie of their prefixes, which is their sorted order."""
        ends, unigram, score, pairs = self.ends, self.unigram, self.score, self.pairs
        if self.known_pairs > PAIRS:
            pairs[:] = [None] * len(pairs)
            self.known_pairs = 0
        last, start, best = [-1], [0], [0.0]  # of each prefix: last piece (-1: none or unknown), its begin, the score
        out, before = {}, ""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], best[shared + 1 :]
            for i in range(shared, n):
                node, at = ends, i
                if unigram:
                    top, piece_at, piece = best[i] + self.unknown_score, i, -1
                    while at >= 0:
                        node = node.get(word[at])
                        if node is None:
                            break
                        p = node.get("")
                        if p is not None and (best[at] + score[p] > top or piece < 0 and at == i):
                            top, piece_at, piece = best[at] + score[p], at, p
                        at -= 1
                    best.append(top)
                else:
                    piece_at, piece = i, -1
                    while at >= 0:
                        node = node.get(word[at])
                        if node is None:
                            break
                        p = node.get("")
                        if p is not None:
                            row = pairs[last[at] + 1]
                            if row is None:
                                row = pairs[last[at] + 1] = {}
                            known = row.get(p)
                            if known is None:
                                known = row[p] = self._fits(last[at], p)
                                self.known_pairs += 1
                            if known:
                                piece_at, piece = at, p
                                break
                        at -= 1
                    best.append(0.0)
                last.append(piece)
                start.append(piece_at)
            ids, at = [], n
            while at:
                if last[at] >= 0:
                    ids.append(last[at])
                else:
                    ids += [self.byte[b] for b in reversed(word[at - 1].encode())] if self.byte else [self.unknown]
                at = start[at]
            ids.reverse()
            if not self.byte:
                # neighbouring unknown characters are one unknown piece
                ids = [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != self.unknown]
            out[word] = ids
            before = word
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        units = [_UNIT.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        new = {u for us in units for u in us if u not in known}
        known.update(self.encode_words(list(new)))
        place: dict[str, int] = {}
        spot = [place.setdefault(u, len(place)) for us in units for u in us]
        own = [known[u] for u in place]
        sizes = np.array([len(x) for x in own], np.int64)
        flat = np.array([i for x in own for i in x], np.int32)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        spot_a = np.array(spot, np.int64)
        del spot, own
        n = sizes[spot_a]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[spot_a] - ends[:-1], n) + np.arange(ends[-1])] if len(spot_a) else np.empty(0, np.int32)
        return ids, ends[np.concatenate([[0], np.cumsum([len(us) for us in units])])]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, text, ids array<int>) of every row: the pieces that the sentencepiece library gives for the model.

    back adds a column decoded, the text of the ids just made, without sending them to another worker.

    Spaces become marks and one mark goes before the text; words are a run of marks and what follows it. Within a
    slice of the input each distinct word is encoded once. Null and empty texts have no ids; characters that the
    model lacks become byte pieces, or the unknown piece; a text's own marks count as spaces, as in the library; a
    word of any length is one word. Rows are independent, ids may be null or repeat; an empty table gives none; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, "t"):
            ids, cuts = model.encode([x or "" for x in batch.column("t").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
            out = [batch.column("id"), batch.column("t"), lists]
            if back:
                out.append(pa.array([model.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "text", "ids", "decoded"][: len(out)])

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return plain.mapInArrow(run, f"id {kind}, text string, ids array<int>" + ", decoded string" * back).withColumnsRenamed({"id": id_col, "text": text_col})


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of its ids; null ids give null, no ids the empty text."""

    @F.pandas_udf("string")
    def run(ids):
        import pandas as pd

        model = pieces(path)
        return pd.Series([None if x is None else model.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn("decoded", run(ids_col))


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: the number of ids, a hash of them, and whether the text came back."""
    path = model_file()
    both = encode(table(spark, sf_dir, "documents"), path, back=True)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("round_trip"),
    )
