"""Exact links between sets of word shingles: candidates by signatures, verdicts by blocked sparse products.

Sets are those of units of text: whole documents, or paragraphs. Equal units are one item, named by a 64-bit hash of
its content, so that copies cost nothing past the first pass. The steps:

1. `members`: every unit's item and size. One pass over the texts; a small table.
2. `candidates`: signatures of every unit, packed by hash range into byte columns and combined within each slice of
   input, then sorted by range in numpy. Items that share a signature are joined to groups (connected components).
3. `verified`: the items of each group meet in blocks: the incidence matrices of two blocks of rows are multiplied,
   a block of columns at a time, and pairs are dropped as soon as their sizes and the columns to come rule them out.
   A group of n short items is cut into n / BLOCK blocks, at most 8 until blocks are 16 times as large; a task takes two
   blocks, multiplies them part by part, and returns at most a spanning forest, and each item's number of links.
4. `classes`: components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import textops
from hushframe.llm.common import connected_components, cut, forest, partitions, slices

#: Rows and shingles that are multiplied at once, about, and their n-gram columns.
BLOCK, WEIGHT, COLUMNS = 512, 1 << 16, 4096
#: Blocks of that size that a group is cut into; the blocks of larger groups grow, up to so many times.
FEW_BLOCKS, GROWN = 8, 16
#: Signatures that are packed at once.
PACKED = 1 << 20
U = np.uint64

#: units(buf, starts) -> (begin, end, bounds of units in words, row of each unit, number of the unit in its row)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def whole_texts(buf: np.ndarray, starts: np.ndarray):
    """Every row is one unit."""
    begin, end, bounds = textops.words(buf, starts)
    n = len(starts) - 1
    return begin, end, bounds, np.arange(n), np.zeros(n, np.int64)


def paragraphs(buf: np.ndarray, starts: np.ndarray):
    """The lines of every row, numbered from 0."""
    begin, end, _ = textops.words(buf, starts)
    cuts = np.flatnonzero(buf == 10) + 1  # the byte between rows is a line feed too
    first = np.concatenate([[0], cuts])
    bounds = np.searchsorted(begin, first)
    row = np.searchsorted(starts, first[:-1], side="right") - 1
    number = np.arange(len(row)) - np.searchsorted(first[:-1], starts[:-1])[row]
    return begin, end, bounds, row, number


def _sets(batch: pa.RecordBatch, units: Units, k: int, least: int):
    """(shingle sets, rows, numbers, first words in the row, words) of a slice's units with `least` words or more (at least one)."""
    buf, starts = textops.payload(batch.column("t"))
    begin, end, bounds, row, number = units(buf, starts)
    hashes = textops.word_hashes(buf, begin, end)
    sets = textops.shingle_sets(hashes, bounds, k)
    n_words = np.diff(bounds)
    keep = np.flatnonzero(n_words >= max(1, least))
    first = bounds[keep] - np.searchsorted(begin, starts)[row[keep]]
    return [sets[i] for i in keep], row[keep], number[keep], first, n_words[keep]


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), text_key(F.col("text")).alias("row"), text.cast("binary").alias("t"))


def members(docs: DataFrame, units: Units, k: int, least: int = 1) -> DataFrame:
    """(id, row, number, first, words, item, n): every unit of docs (doc_id, text) with its place, its item and the size of its set.

    row is the text's key, first the unit's first word in its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets, row, number, first, words = _sets(batch, units, k, least)
            ids, keys = (batch.column(c).take(pa.array(row)) for c in ("id", "row"))
            small = [pa.array(x, pa.int32()) for x in (number, first, words)]
            yield pa.RecordBatch.from_arrays(
                [ids, keys, *small, pa.array(textops.set_id(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int64())],
                names=["id", "row", "number", "first", "words", "item", "n"],
            )

    return _texts(docs).mapInArrow(run, "id bigint, row bigint, number int, first int, words int, item bigint, n bigint")


def partition_signatures(percent: int) -> Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Signatures that any two sets with 100 * intersection >= percent * union share at least one of: nothing is lost.

    The hash range is divided into as many columns blocks as two such sets can differ in elements, and some more; so
    they agree on at least one whole block more than the spare number, and the content of a block is a signature.
    Sizes fall into classes a little wider than similar sets can differ; a set near its class's lower end signs for
    the class below too. A block with few elements says little: a set with no more such blocks than there are spare
    ones leaves them out, which the spare ones make up for.
    """
    j = percent / 100
    ratio, spare_share, weak = 1.25, 0.06, 3
    tops = [9.0]
    while tops[-1] < 1e12:
        tops.append(tops[-1] * ratio)
    tops_a = np.array(tops)

    def scheme(c: int) -> tuple[int, int]:
        """(blocks, spare ones) of class c, whose larger set has less than tops[c] / j elements."""
        small = math.ceil(tops[c]) - 1
        most = int((small + small / j) * (1 - j) / (1 + j) + 1e-9)
        spare = math.ceil(spare_share * most) if most >= 8 else 0
        return most + 1 + spare, spare

    def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the set, signature)."""
        who, sigs = [], []
        for i, s in enumerate(sets):
            n = len(s)
            if not n:
                continue
            own = int(np.searchsorted(tops_a, n, side="right"))  # tops[own-1] <= n < tops[own]
            # a pair belongs to the class of its smaller set; the larger may be as large as n / j
            classes = [own]
            if own and n * j <= math.ceil(tops[own - 1]) - 1 + 1e-9:
                classes.append(own - 1)
            for c in classes:
                m, spare = scheme(c)
                at = ((s >> U(32)) * U(m) >> U(32)).astype(np.int64)
                cuts = np.searchsorted(at, np.arange(m + 1))
                size = np.diff(cuts)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[U(0)], np.cumsum(textops.mix(s ^ textops.TERM[50]))])
                    body = sums[cuts[1:]] - sums[cuts[:-1]]
                    sig = textops.mix(body + textops.TERM[51] * (np.arange(m, dtype=np.uint64) + U(1)) + textops.TERM[52] * U(c + 1))
                few = size <= weak
                if spare and few.sum() <= spare:
                    sig = sig[~few]
                who.append(np.full(len(sig), i))
                sigs.append(sig)
        if not who:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(who), np.concatenate(sigs)

    return sign


def minhash_signatures(bands: int, rows: int, seed: int = 5) -> Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Banded MinHash: a set signs once a band, with `rows` least values. Two sets of similarity s share one with odds 1 - (1 - s**rows)**bands."""
    rng = np.random.Generator(np.random.PCG64(seed))
    salt = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)

    def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        flat = np.concatenate([sets[i] for i in full])
        cuts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        out = np.empty((len(full), bands), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(bands):
                sig = np.full(len(full), textops.TERM[53] * U(b + 1), np.uint64)
                for r in range(rows):
                    # an odd multiple of a mixed value, folded, is enough of a permutation for each minimum
                    x = (flat ^ salt[b * rows + r]) * textops.TERM[r]
                    x ^= x >> U(29)
                    x *= textops.TERM[54]
                    sig = textops.mix(sig + np.minimum.reduceat(x, cuts) * textops.TERM[8 + r])
                out[:, b] = sig
        return np.repeat(np.array(full), bands), out.ravel()

    return sign


def sliced_signatures(percent: int, rows: int = 5, miss: float = 1e-7, slices: int = 8, large: int = 160) -> Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Banded MinHash for similarities at which blocks of the hash range would hold too little to tell sets apart.

    A pair at the threshold is missed with odds of about `miss`. Bands of sets with `large` elements or more read one
    eighth of the hash range each, which costs an eighth; those of smaller sets read all; sets just over `large` sign
    in both ways, so that two similar sets always share a way.
    """
    j = percent / 100
    bands = math.ceil(math.log(miss) / math.log(1 - j**rows))
    bands = -(-bands // slices) * slices
    whole, per = minhash_signatures(bands, rows), bands // slices
    by_slice = [minhash_signatures(per, rows, seed=100 + i) for i in range(slices)]

    def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in sets], np.int64)
        small, big = np.flatnonzero(n < large / j), np.flatnonzero(n >= large)
        who, sig = whole([sets[i] for i in small])
        found = [(small[who], sig)]
        parts = [((sets[i] >> U(13)) % U(slices)).astype(np.int64) for i in big]
        for i in range(slices):
            who, sig = by_slice[i]([sets[b][p == i] for b, p in zip(big, parts)])
            found.append((big[who], textops.mix(sig + textops.TERM[55] * U(i + 1))))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    return sign


def candidates(docs: DataFrame, units: Units, k: int, sign, least: int = 1) -> DataFrame:
    """(node, root): items that share signatures, by connected groups.

    A signature that many units share is combined within each slice of the input, so that at most one entry of it
    leaves a slice. Entries go to hash ranges as packed bytes: four ranges a shuffle partition.
    """
    spark = docs.sparkSession
    ranges = 4 * partitions(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig_parts: list[np.ndarray] = []
        item_parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch | None:
            sig, item = np.concatenate(sig_parts), np.concatenate(item_parts)
            sig_parts.clear()
            item_parts.clear()
            order = np.lexsort((item, sig))
            sig, item = sig[order], item[order]
            same = sig[1:] == sig[:-1]
            pair = np.flatnonzero(same & (item[1:] != item[:-1]))
            a, b = forest(item[pair], item[pair + 1]) if len(pair) else (np.empty(0, np.int64),) * 2
            first = np.concatenate([[True], ~same])
            sig, item = sig[first], item[first]
            cuts = np.searchsorted((sig >> U(32)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=np.uint64))
            home = (textops.mix(b.view(np.uint64)) >> U(32)) * U(ranges) >> U(32) if len(b) else np.empty(0, np.uint64)
            order = np.argsort(home, kind="stable")
            a, b = a[order], b[order]
            links = np.searchsorted(home[order], np.arange(ranges + 1, dtype=np.uint64))
            rows = [r for r in range(ranges) if cuts[r + 1] > cuts[r] or links[r + 1] > links[r]]
            cols = [(sig, cuts), (item, cuts), (a, links), (b, links)]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *[pa.array([x[c[r] : c[r + 1]].tobytes() for r in rows], pa.binary()) for x, c in cols]],
                names=["range", "sig", "item", "a", "b"],
            )

        held = 0
        for batch in slices(batches, "t"):
            sets, *_ = _sets(batch, units, k, least)
            if not sets:
                continue
            ids = textops.set_id(sets).view(np.int64)
            _, one = np.unique(ids, return_index=True)
            who, sig = sign([sets[i] for i in one])
            sig_parts.append(sig)
            item_parts.append(ids[one][who])
            held += len(sig)
            if held >= PACKED:
                yield flush()
                held = 0
        if held:
            yield flush()

    def link(rows: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
        sig, item, a, b = get("sig", np.uint64), get("item", np.int64), get("a", np.int64), get("b", np.int64)
        order = np.argsort(sig, kind="stable")
        sig, item = sig[order], item[order]
        pair = np.flatnonzero((sig[1:] == sig[:-1]) & (item[1:] != item[:-1]))
        a, b = np.concatenate([a, item[pair]]), np.concatenate([b, item[pair + 1]])
        a, b = forest(a, b) if len(a) else (a, b)
        return pa.table({"a": a, "b": b})

    packed = _texts(docs.where("doc_id is not null")).mapInArrow(pack, "range int, sig binary, item binary, a binary, b binary")
    return connected_components(packed.groupBy("range").applyInArrow(link, "a bigint, b bigint"))


def _product(x: list[np.ndarray], y: list[np.ndarray], same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the rows of x and y (i < j if they are the same block) with 100 * overlap >= percent * union.

    The incidence matrices are multiplied by blocks of columns, in order of the n-grams' hashes. A pair stays while
    what it shares so far and the most it can still share reach the overlap that its sizes call for.
    """
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    need = -(-percent * (nx[:, None] + ny[None, :]) // (100 + percent))
    alive = np.minimum(nx[:, None], ny[None, :]) >= need
    if same:
        alive &= np.triu(np.ones_like(alive), 1).astype(bool)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    vx, vy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(vx, vy)
    kx, ky = np.isin(vx, shared), np.isin(vy, shared)
    cx, cy = np.searchsorted(shared, vx[kx]), np.searchsorted(shared, vy[ky])
    rx, ry = rx[kx], ry[ky]
    # columns of one block of rows only are never multiplied; they count in the sizes
    left_x, left_y = np.bincount(rx, minlength=len(x)), np.bincount(ry, minlength=len(y))
    got = np.zeros((len(x), len(y)), np.int64)
    alive &= np.minimum(left_x[:, None], left_y[None, :]) >= need
    for at in range(0, len(shared), COLUMNS):
        if not alive.any():
            break
        ix, iy = (cx >= at) & (cx < at + COLUMNS), (cy >= at) & (cy < at + COLUMNS)
        width = min(COLUMNS, len(shared) - at)
        mx, my = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        mx[rx[ix], cx[ix] - at] = 1
        my[ry[iy], cy[iy] - at] = 1
        got += (mx @ my.T).astype(np.int64)
        left_x = left_x - np.bincount(rx[ix], minlength=len(x))
        left_y = left_y - np.bincount(ry[iy], minlength=len(y))
        alive &= got + np.minimum(left_x[:, None], left_y[None, :]) >= need
    return np.nonzero(alive & (got >= need))


def blocks_of(items: Column, shingles: Column) -> Column:
    """How many blocks a group is cut into: each of its texts goes to so many tasks, so large groups get larger blocks."""
    least = F.greatest(items / BLOCK, shingles / WEIGHT)
    return F.ceil(F.greatest(F.least(least, F.lit(float(FEW_BLOCKS))), least / GROWN)).cast("int")


def _parts(which: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """A block's items in runs that are multiplied at once."""
    upto = np.cumsum([len(sets[n]) for n in which])
    number = np.maximum(np.arange(len(which)) // BLOCK, upto // WEIGHT)
    return np.split(which, np.flatnonzero(np.diff(number)) + 1)


def verified(docs: DataFrame, units: Units, k: int, percent: int, found: DataFrame, owned: DataFrame) -> DataFrame:
    """(a, b, links): links a-b between different items of `found` (node, root), enough of them to connect whatever is
    linked; and, where b is null, a number of units that item a's units link with, of other items: its sum counts all.

    owned: `members` of docs. One unit stands for each item; its text comes along, and its set is made in the task
    that multiplies it.
    """
    stands = owned.where("id is not null").groupBy("item").agg(F.min(F.struct("id", "row", "number")).alias("at"), F.max("n").alias("n"), F.count("*").alias("times"))
    placed = cut(found.withColumnRenamed("node", "item").hint("merge").join(stands.hint("merge"), "item"))
    size = cut(placed.groupBy("root").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")))
    items = placed.hint("merge").join(size.hint("merge"), "root").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # of one text: as many entries as it has units
    by_text = items.groupBy(F.col("at.id").alias("id"), F.col("at.row").alias("row")).agg(F.collect_list(F.struct("at.number", "item", "root", "block", "blocks", "times")).alias("want"))
    with_text = _texts(docs).join(cut(by_text).hint("shuffle_hash"), ["id", "row"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            buf, starts = textops.payload(batch.column("t"))
            begin, end, bounds, row, number = units(buf, starts)
            where = {key: u for u, key in enumerate(zip(row.tolist(), number.tolist()))}
            out: list[list] = [[], [], [], [], [], []]
            for r, want in enumerate(batch.column("want").to_pylist()):
                for w in want:
                    u = where.get((r, w["number"]))
                    if u is None or bounds[u] == bounds[u + 1]:
                        continue
                    lo, hi = bounds[u], bounds[u + 1]
                    piece = buf[begin[lo] : end[hi - 1]].tobytes()
                    for o, v in zip(out, (w["root"], w["item"], w["block"], w["blocks"], w["times"], piece)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                names=["root", "item", "block", "blocks", "times", "t"],
            )

    texts = with_text.mapInArrow(fetch, "root bigint, item bigint, block int, blocks int, times bigint, t binary")
    other = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = other.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "item", "times", "t")

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        buf, starts = textops.payload(rows.column("t").combine_chunks())
        begin, end, bounds = textops.words(buf, starts)
        sets = textops.shingle_sets(textops.word_hashes(buf, begin, end), bounds, k)
        x, y = key[1].as_py(), key[2].as_py()
        ids, block, times = (rows.column(c).to_numpy() for c in ("item", "block", "times"))
        # a repeated row stands for its item twice, and another text of the same id for none
        own = np.flatnonzero(textops.set_id(sets).view(np.int64) == ids)
        own = own[np.unique(ids[own], return_index=True)[1]]
        sets, ids, block, times = [sets[i] for i in own], ids[own], block[own], times[own]
        ix, iy = np.flatnonzero(block == x), np.flatnonzero(block == y)
        none = np.empty(0, np.int64)
        tied = [(none, none)]
        links = np.zeros(len(ids), np.int64)
        if len(ix) and len(iy):
            xs, ys = _parts(ix, sets), _parts(iy, sets)
            for p, q in ((p, q) for p in range(len(xs)) for q in range(p if x == y else 0, len(ys))):
                same = x == y and p == q
                i, j = _product([sets[n] for n in xs[p]], [sets[n] for n in ys[q]], same, percent)
                i, j = xs[p][i], ys[q][j]
                if len(i):
                    tied.append(forest(ids[i], ids[j]))
                    for one, other in ((i, j), (j, i)):
                        links += np.bincount(one, weights=times[other], minlength=len(ids)).astype(np.int64)
        a, b = (np.concatenate(t) for t in zip(*tied))
        a, b = forest(a, b) if len(a) else (a, b)
        some = np.flatnonzero(links)
        no_a, no_b = pa.nulls(len(a), pa.int64()), pa.nulls(len(some), pa.int64())
        return pa.table({
            "a": np.concatenate([a, ids[some]]), "b": pa.chunked_array([pa.array(b, pa.int64()), no_b]), "links": pa.chunked_array([no_a, pa.array(links[some], pa.int64())]),
        })

    return tasks.groupBy("root", "x", "y").applyInArrow(multiply, "a bigint, b bigint, links bigint")


def classes(docs: DataFrame, units: Units, k: int, percent: int, sign, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, (node, root), (item, links)): the units of docs, the items that are linked, directly or through others, by
    class, and how many units of other items each one's units link with directly, if any.
    """
    owned = cut(members(docs, units, k, least))
    found = candidates(docs, units, k, sign, least)
    links = cut(verified(docs, units, k, percent, found, owned))
    counted = links.where("b is null").groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("links"))
    return owned, cut(connected_components(links)), counted
