"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import textops
from hushframe.llm.common import free_name, slices, table

#: Labelled rows that the model is fitted on at most, those of least hash; bytes of text that they hold at most.
TRAIN_ROWS, TRAIN_BYTES = 5000, 20 << 20
#: Words fall into this many buckets; a vector's length; nonzero entries of an index vector; neighbours to a side.
BUCKETS, DIM, NONZERO, REACH = 1 << 15, 48, 6, 2
#: Shapes of words: kinds of the first and the last two bytes, and whether the word repeats the one before.
KINDS = 8
SHAPES = KINDS**3 * 2
HIDDEN, EPOCHS, STEP, DECAY = 32, 60, 3e-3, 1e-4
THRESHOLD = 0.7
#: Words whose neighbours are added up at once.
WORDS = 1 << 14
U = np.uint64


def _kinds() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # other signs
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
    kind[[ord(c) for c in ".,;:"]] = 4
    kind[[ord(c) for c in "!?"]] = 6
    kind[[ord(c) for c in "|/\\<>{}[]=_"]] = 7
    return kind


KIND = _kinds()


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors, of as many 1 as -1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, DIM), np.float32)
    spots = rng.permuted(np.tile(np.arange(DIM), (n, 1)), axis=1)[:, :NONZERO]
    out[np.arange(n)[:, None], spots] = np.where(np.arange(NONZERO) % 2, -1.0, 1.0)
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, its shape, words before each row)."""
    buf, starts = textops.payload(column)
    begin, end, bounds = textops.words(buf, starts)
    h = textops.word_hashes(buf, begin, end, lower=False)
    first, last, before = KIND[buf[begin]], KIND[buf[end - 1]], KIND[buf[np.maximum(end - 2, begin)]]
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[bounds[:-1][bounds[:-1] < len(h)]] = 0
    shape = ((first.astype(np.int64) * KINDS + last) * KINDS + before) * 2 + again
    return (h >> U(49)).astype(np.int32), shape.astype(np.int16), bounds


def context_sums(bucket: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each bucket's sum of its neighbours' index vectors: whole numbers, so that sums of parts add up in any order."""
    out = np.zeros((BUCKETS + 1, DIM), np.float64)
    # rows lie REACH places without a word apart, so that no word is the neighbour of another row's
    vectors = np.concatenate([index, np.zeros((1, DIM))]).astype(np.int8)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places = np.full(len(bucket) + REACH * len(bounds), BUCKETS, np.uint16)
    places[np.arange(len(bucket)) + REACH * (row + 1)] = bucket
    for lo in range(REACH, len(places) - REACH, WORDS):
        n = min(WORDS, len(places) - REACH - lo)
        near = vectors[places[lo - REACH : lo + n + REACH]]
        total = sum(near[REACH + gap : REACH + gap + n] + near[REACH - gap : REACH - gap + n] for gap in range(1, REACH + 1))
        own = places[lo : lo + n]
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(total[order], first, axis=0, dtype=np.int32)
    return out[:-1]


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The buckets' context vectors, scaled to unit length, over all words of all rows of docs (text).

    A task adds up its rows and sends each bucket it met once; the driver gets one row a bucket, whatever the corpus.
    Null and empty texts have no words; buckets without words, and all of them for an empty table, are zero.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(BUCKETS, 7), np.zeros((BUCKETS, DIM), np.float64)
        for batch in slices(batches, "t"):
            bucket, _, bounds = tokens(batch.column("t"))
            total += context_sums(bucket, bounds, index)
        met = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *[pa.array(total[met, i].astype(np.int64)) for i in range(DIM)]], names=["bucket", *names])

    names = [f"s{i}" for i in range(DIM)]
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    parts = text.mapInArrow(add, "bucket int, " + ", ".join(f"{n} bigint" for n in names))
    sums = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[sums.column("bucket").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)


def pool(bucket: np.ndarray, shape: np.ndarray, bounds: np.ndarray, context: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Means over each row of its words' context vectors and its shapes' index vectors, with both lengths; zeros without words."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 2 * DIM + 3), np.float64)
    full = np.flatnonzero(n)
    block = 1 << 15
    for vectors, of, at in ((context, bucket, 0), (shapes, shape, DIM)):
        sums = np.zeros((len(n), DIM))
        for lo in range(0, len(of), block):
            hi = min(lo + block, len(of))
            rows = np.arange(np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi, side="left"))
            rows = rows[n[rows] > 0]
            cuts = np.maximum(bounds[rows], lo) - lo
            sums[rows] += np.add.reduceat(vectors[of[lo:hi]].astype(np.float64), cuts, axis=0)
        out[full, at : at + DIM] = sums[full] / n[full, None]
        out[:, 2 * DIM + (at > 0)] = np.sqrt((out[:, at : at + DIM] ** 2).sum(axis=1))
    out[:, 2 * DIM + 2] = np.log1p(n) / 10
    return out


class Network:
    """Two layers on standardised features; probabilities from the last one's output over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 3):
        """Fitted on the rows that aren't held, the temperature on those that are."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        own, n = np.flatnonzero(~held), x.shape[1]
        self.w = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        ups = y[own].mean()
        weight = np.where(y[own] > 0, 0.5 / max(ups, 1e-6), 0.5 / max(1 - ups, 1e-6)) if 0 < ups < 1 else np.ones(len(own))
        # the classes weigh alike up to a factor of 2, so that the rare one is learned and odds stay near
        weight = np.sqrt(weight)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        t = 0
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(own)), max(1, len(own) // 64)):
                a, b, k = z[own[batch]], y[own[batch]], weight[batch]
                h = np.tanh(a @ self.w[0] + self.w[1])
                err = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - b) * k / len(batch)
                back = err[:, None] * self.w[2][None, :] * (1 - h * h)
                grads = [a.T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ err + DECAY * self.w[2], np.array([err.sum()])]
                t += 1
                for w, g, m, v in zip(self.w, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if held.any():
            logits, b = self.logits(x[held]), y[held]
            loss = lambda s: np.mean(np.logaddexp(0, logits / s) - b * logits / s)
            self.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


class QualityModel:
    def __init__(self, context: np.ndarray, shapes: np.ndarray, network: Network | None, base: float):
        self.context, self.shapes, self.network, self.base = context, shapes, network, base

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.base)
        return self.network.probability(pool(*tokens(column), self.context, self.shapes))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> QualityModel:
    """A model of labels (doc_id, quality 0 or 1) for docs (doc_id, text).

    Only labelled rows whose crc32(doc_id) mod 4 isn't 2 are seen: of these the `rows` with the least hash of the id,
    stopping at `most` bytes of text, whole texts only, and passing over texts of more than an eighth of these. A fifth
    of them sets the temperature. Word vectors come from all rows of docs, whose texts alone are read for them. Without
    labels every score is 0.5; with labels of one kind, their share.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.withColumn("__at", F.xxhash64("doc_id")).orderBy("__at", "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    joined = docs.select("doc_id", text.alias("t")).join(F.broadcast(chosen), "doc_id")  # bounded by rows
    sizes = joined.select("doc_id", "__at", F.octet_length("t").alias("n")).where(F.col("n") <= most / 8).orderBy("__at", "doc_id").limit(rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        last = r["__at"]
    seen = joined.where((F.col("__at") <= F.lit(last)) & (F.octet_length("t") <= most / 8)).orderBy("__at", "doc_id", "t").limit(rows).select("doc_id", "quality", "t").collect() if last is not None else []
    y = np.array([float(r["quality"]) for r in seen])
    shapes = index_vectors(SHAPES, 11)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros((BUCKETS, DIM), np.float32), shapes, None, float(y.mean()) if len(y) else 0.5)
    parts = [tokens(pa.array([bytes(r["t"])], pa.binary())) for r in seen]
    seen.clear()
    bucket, shape = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    context = context_vectors(docs)
    x = pool(bucket, shape, bounds, context, shapes)
    return QualityModel(context, shapes, Network(x, y, np.arange(len(y)) % 5 == 4), 0.5)


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """docs with a column `name` (0 to 1; higher: label 1 likelier), from the whole text alone.

    Null and empty texts get the score of no words. Rows are independent; all other columns pass through, a column
    of that name is replaced; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some MB whatever the corpus

    @F.pandas_udf("double")
    def run(texts):  # the column arrives as pandas, of binary
        out = [sent.value.scores(b.column("t")) for b in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])]), "t")]
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(name, run(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that a model of labels scores threshold or more; all rows if labels have no two kinds.

    All columns pass, whatever their names. Null and empty texts are scored as texts without words, rows that repeat
    each by their own text, and an empty table gives none.
    """
    model = fit(docs, labels)
    if model.network is None:
        return docs
    mine = free_name(docs, "score")
    return score(docs, model, mine).where(F.col(mine) >= threshold).drop(mine)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of labels.quality."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
