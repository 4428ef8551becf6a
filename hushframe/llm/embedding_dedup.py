"""Near-duplicate embeddings: every pair over a cosine threshold, by dual traversal of cover trees."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import connected_components, cut, forest, partitions, table

#: Vectors of one tree, about; cells at the top at most; vectors that the cells' centres are chosen from at most.
NODE, CELLS, SAMPLE = 4096, 64, 4096
#: Nodes that travel as one block at most, and bytes of their unit vectors.
SPAN, SPAN_BYTES = 16, 32 << 20
#: Covering radii of a tree's levels: each half of the one above.
RADII = (1.0, 0.5, 0.25, 0.125)
#: What single precision may be off by in a distance.
SLACK = 1e-3


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, in their precision."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """Nested levels of centres over unit vectors: level i's balls of radius RADII[i] hold all, and each centre stays one below.

    Each point belongs to the ball of one centre a level, and a centre to one ball of the level above. Levels that
    have the same centres as the one above are left out.
    """

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float32)
        n = len(x)
        d = _distance(self.x, self.x)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres; parent's place above; radius
        home = np.zeros(n, np.int64)  # place of each point's ball in the level above
        centres_above: list[int] = []
        for r in RADII:
            centres, where = list(centres_above), np.full(n, -1)
            parents = list(range(len(centres)))
            for place, c in enumerate(centres):
                own = (d[c] <= r) & (where < 0) & (home == place)
                where[own] = place
            for p in np.flatnonzero(where < 0).tolist():
                if where[p] >= 0:
                    continue
                own = (d[p] <= r) & (where < 0) & (home == home[p])
                own[p] = True
                where[own] = len(centres)
                centres.append(p)
                parents.append(int(home[p]))
            if len(centres) > len(centres_above):
                radius = np.zeros(len(centres), np.float32)
                np.maximum.at(radius, where, d[np.array(centres)[where], np.arange(n)])
                self.levels.append((np.array(centres), np.array(parents), radius + np.float32(SLACK)))
            home, centres_above = where, centres
        self._leaves(home)

    def _leaves(self, leaf: np.ndarray) -> None:
        self.leaf = leaf
        order = np.argsort(leaf, kind="stable")
        cuts = np.searchsorted(leaf[order], np.arange(int(leaf.max()) + 2))
        self.members = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def packed(self) -> bytes:
        """The tree without its vectors: made once a node, read in each of its tasks."""
        levels = [(centres.astype(np.int32), parents.astype(np.int32), radius) for centres, parents, radius in self.levels]
        return pickle.dumps((levels, self.leaf.astype(np.int32)))

    @classmethod
    def unpacked(cls, data: bytes, x: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        tree.x = x.astype(np.float32)
        tree.levels, leaf = pickle.loads(data)
        tree._leaves(leaf)
        return tree


#: Share of all pairs of balls over which a level is multiplied whole instead of pair by pair; rows multiplied at once.
DENSE, ROWS = 0.05, 512


def _augmented(tree: Tree, level: int, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres with three more columns on either side, so that one product compares distance and radii.

    |a - b| <= ra + rb + tau is a.b + ra rb + (ra^2 / 2 + tau ra) + (rb^2 / 2 + tau rb) >= 1 - tau^2 / 2.
    """
    centres, _, r = tree.levels[level]
    own, one = r * r / 2 + np.float32(tau) * r, np.ones_like(r)
    x = tree.x[centres]
    return np.column_stack([x, r, own, one]), np.column_stack([x, r, one, own])


def _children(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in this level in order of their parents, and where each parent's begin; a level past the last repeats it."""
    if level >= len(tree.levels):
        n = len(tree.levels[-1][0])
        return np.arange(n), np.arange(n + 1)
    parents = tree.levels[level][1]
    above = len(tree.levels[level - 1][0])
    order = np.argsort(parents, kind="stable")
    return order, np.searchsorted(parents[order], np.arange(above + 1))


def _active(a: Tree, b: Tree, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a link: level by level, only the children of pairs of balls that their radii let near."""
    least = np.float32(1 - tau * tau / 2 - SLACK)
    p = q = np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels))):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        left, right = _augmented(a, la, tau)[0], _augmented(b, lb, tau)[1]
        if level:
            (ca, sa), (cb, sb) = _children(a, level), _children(b, level)
            na, nb = (sa[p + 1] - sa[p]), (sb[q + 1] - sb[q])
        if not level or (na * nb).sum() > DENSE * len(left) * len(right):
            if level:
                above = np.zeros((len(sa) - 1, len(sb) - 1), bool)
                above[p, q] = True
                up_a, up_b = np.empty(len(left), np.int64), np.empty(len(right), np.int64)
                up_a[ca], up_b[cb] = np.repeat(np.arange(len(sa) - 1), np.diff(sa)), np.repeat(np.arange(len(sb) - 1), np.diff(sb))
            found = []
            for at in range(0, len(left), ROWS):
                near = left[at : at + ROWS] @ right.T >= least
                if level:
                    near &= above[up_a[at : at + ROWS]][:, up_b]
                hit = np.flatnonzero(near)
                found.append(hit + at * len(right))
            flat = np.concatenate(found)
            p, q = flat // len(right), flat % len(right)
        else:
            n = na * nb
            pair = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = ca[sa[p[pair]] + k // nb[pair]], cb[sb[q[pair]] + k % nb[pair]]
            keep = [np.einsum("ij,ij->i", left[i[s : s + 65536]], right[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)]
            keep = np.concatenate(keep) if keep else np.empty(0, bool)
            p, q = i[keep], j[keep]
        if not len(p):
            break
    return p, q


def dual_pairs(a: Tree, b: Tree, xa: np.ndarray, xb: np.ndarray, tau: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of xa and xb (unit vectors in double precision) of that cosine or more; i < j if they are the same."""
    p, q = _active(a, b, tau)
    if same:
        p, q = p[p <= q], q[p <= q]
    sizes_a, sizes_b = np.array([len(m) for m in a.members]), np.array([len(m) for m in b.members])
    single = (sizes_a[p] == 1) & (sizes_b[q] == 1)
    one_a, one_b = np.array([m[0] for m in a.members]), np.array([m[0] for m in b.members])
    i, j = one_a[p[single]], one_b[q[single]]
    if same:
        i, j = i[i != j], j[i != j]
    keep = np.concatenate([np.einsum("ij,ij->i", xa[i[s : s + 65536]], xb[j[s : s + 65536]]) >= cosine for s in range(0, len(i), 65536)] or [np.empty(0, bool)])
    out_i, out_j = [i[keep]], [j[keep]]
    for s, t in zip(p[~single].tolist(), q[~single].tolist()):
        i, j = a.members[s], b.members[t]
        hit = xa[i] @ xb[j].T >= cosine
        if same and s == t:
            hit = np.triu(hit, 1)
        u, v = np.nonzero(hit)
        out_i.append(i[u])
        out_j.append(j[v])
    return np.concatenate(out_i), np.concatenate(out_j)


def _farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of x, each the farthest from those before."""
    chosen = [0]
    d = _distance(x, x[:1])[:, 0]
    while len(chosen) < count and d.max() > 1e-6:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distance(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _span(nodes: int, dim: int, tasks: int) -> int:
    """Nodes to a block, so that pairs of blocks are about as many as tasks, and a block stays within its bytes."""
    return max(1, min(SPAN, SPAN_BYTES // (NODE * 8 * dim), -(-nodes // math.isqrt(2 * max(1, tasks)))))


def near_links(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for every row: its pairs of that cosine or more, and the smallest id that links lead to.

    Equal vectors are one item. Items fall into cells around centres; cells are cut into nodes of about 4096, each
    with a cover tree. Nodes travel in blocks: as many as leave each shuffle partition a pair of blocks, and at most
    SPAN of them or SPAN_BYTES of unit vectors. Two blocks meet in a task unless the covering radii of their cells rule
    a link out, and the trees of each pair of their nodes are traversed together. So n vectors are sent about
    sqrt(2 * partitions) times each, or n / (SPAN * NODE) times if that is more; a task reads two blocks, whatever group
    of vectors is large; no pair is kept as a row. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing and are components of their own; vectors of different lengths
    don't link; repeated rows count each; a null id has no component; an empty table gives none; other columns are
    not read.
    """
    spark = vectors.sparkSession
    tau = math.sqrt(2 - 2 * cosine)
    v = F.col(vec_col).cast("array<double>")
    usable = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(usable, F.lit(False)).alias("ok"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("item", F.when(F.col("ok"), F.xxhash64("v")))
    owned = cut(rows.select("id", "item"))
    items = cut(rows.where("ok").groupBy("item").agg(F.count("*").alias("times"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    dims = items.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if dims:
        dim, total = dims[0]["dim"], dims[0]["count"]
        sample = items.where(F.col("dim") == dim).orderBy(F.xxhash64("item"), "item").limit(SAMPLE).select("v").collect()
        span = _span(-(-total // NODE), dim, partitions(spark))
        centres = _farthest_first(_unit(np.array([r["v"] for r in sample])), min(CELLS, -(-total // (NODE * span))))
    else:
        dim, span, centres = 0, 1, np.empty((0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("dim").to_numpy()
            cell, far = -size.astype(np.int64), np.zeros(len(size))
            own = np.flatnonzero(size == dim)
            if len(own):
                x = _unit(batch.column("v").take(pa.array(own)).flatten().to_numpy().reshape(-1, dim))
                d = _distance(x, centres)
                cell[own], far[own] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("times"), batch.column("v"), pa.array(cell), pa.array(far)], names=["item", "times", "v", "cell", "far"]
            )

    placed = cut(items.mapInArrow(place, "item bigint, times bigint, v array<double>, cell bigint, far double"))
    # at most CELLS cells, and one for each other length of vectors
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    parts = {r["cell"]: -(-r["n"] // NODE) for r in cells}
    blocks = {c: -(-n // span) for c, n in parts.items()}
    meet = []
    for p in cells:
        for q in cells:
            c, e = p["cell"], q["cell"]
            if e < c or c != e and (c < 0 or e < 0):
                continue
            if c != e and float(_distance(centres[c : c + 1], centres[e : e + 1])[0, 0]) > p["r"] + q["r"] + tau + SLACK:
                continue
            meet.append((c, e, c, e))
            if c != e:
                meet.append((e, c, c, e))
    pairs = spark.createDataFrame([(own, x, y, blocks[other]) for own, other, x, y in meet], "cell bigint, x bigint, y bigint, others int")
    sizes = spark.createDataFrame(list(parts.items()), "cell bigint, parts int")
    kept = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64

    def gather(rows: pa.Table) -> pa.Table:
        vs = rows.column("v").combine_chunks()
        flat = vs.flatten().to_numpy()
        return pa.table({
            "cell": rows.column("cell").slice(0, 1), "node": rows.column("node").slice(0, 1).cast(pa.int32()), "dim": pa.array([len(flat) // len(vs)], pa.int32()),
            "items": pa.array([rows.column("item").to_numpy().tobytes()]), "times": pa.array([rows.column("times").to_numpy().tobytes()]),
            "vs": pa.array([flat.astype(kept).tobytes()]), "tree": pa.array([Tree(_unit(flat.reshape(len(vs), -1))).packed()], pa.binary()),
        })

    # both small tables are bounded by CELLS squared
    nodes = placed.join(F.broadcast(sizes), "cell").withColumn("node", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    nodes = cut(nodes.select("cell", "node", "item", "times", "v").groupBy("cell", "node").applyInArrow(gather, "cell bigint, node int, dim int, items binary, times binary, vs binary, tree binary"))
    tasks = (
        nodes.withColumn("block", F.floor(F.col("node") / span).cast("int")).join(F.broadcast(pairs), "cell")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("bx", F.when(F.col("x") == F.col("y"), F.least("block", "other")).otherwise(F.when(F.col("cell") == F.col("x"), F.col("block")).otherwise(F.col("other"))))
        .withColumn("by", F.when(F.col("x") == F.col("y"), F.greatest("block", "other")).otherwise(F.when(F.col("cell") == F.col("x"), F.col("other")).otherwise(F.col("block"))))
        .select("x", "bx", "y", "by", "cell", "block", "node", "dim", "items", "times", "vs", "tree")
    )

    def read(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree]:
        x = _unit(np.frombuffer(r["vs"], kept).astype(np.float64).reshape(-1, r["dim"]))
        return np.frombuffer(r["items"], np.int64), np.frombuffer(r["times"], np.int64), x, Tree.unpacked(r["tree"], x)

    def traverse(key: tuple, rows: pa.Table) -> pa.Table:
        sides: list[list] = [[], []]
        same = key[0].as_py() == key[2].as_py() and key[1].as_py() == key[3].as_py()
        for r in sorted(rows.to_pylist(), key=lambda r: r["node"]):
            sides[(r["cell"], r["block"]) != (key[0].as_py(), key[1].as_py())].append(read(r))
        left, right = sides[0], sides[0] if same else sides[1]
        links = [[np.zeros(len(ids), np.int64) for ids, *_ in side] for side in (left, right)]
        ends = [np.empty((2, 0), np.int64)]
        for m, (ia, ta, xa, tree_a) in enumerate(left):
            for n, (ib, tb, xb, tree_b) in enumerate(right):
                if same and n < m:
                    continue
                i, j = dual_pairs(tree_a, tree_b, xa, xb, tau, cosine, same and n == m)
                if len(i):
                    links[0][m] += np.bincount(i, weights=tb[j], minlength=len(ia)).astype(np.int64)
                    links[1][n] += np.bincount(j, weights=ta[i], minlength=len(ib)).astype(np.int64)
                    ends.append(np.stack(forest(ia[i], ib[j])))
        ids, counts = np.concatenate([ids for side in (left, right) for ids, *_ in side]), np.concatenate([c for side in links for c in side])
        some = counts > 0
        a, b = np.concatenate(ends, axis=1)
        a, b = forest(a, b) if len(a) else (a, b)
        root = dict(zip(b.tolist(), a.tolist()))
        ids, counts = ids[some], counts[some]
        return pa.table({"item": ids, "links": counts, "root": np.array([root.get(x, x) for x in ids.tolist()], np.int64)})

    found = cut(tasks.groupBy("x", "bx", "y", "by").applyInArrow(traverse, "item bigint, links bigint, root bigint"))
    linked = cut(connected_components(found.select(F.col("root").alias("a"), F.col("item").alias("b"))))
    counted = cut(found.groupBy("item").agg(F.sum("links").alias("links")))
    dims_of = cut(
        items.select("item", "times").hint("merge").join(counted.hint("merge"), "item", "left")
        .join(linked.withColumnRenamed("node", "item").hint("merge"), "item", "left")
        .select("item", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "item").alias("root"))
    )
    full = cut(owned.hint("merge").join(dims_of.hint("merge"), "item", "left"))
    heads = cut(full.where("root is not null").groupBy("root").agg(F.min("id").alias("head")))
    return full.hint("merge").join(heads.hint("merge"), "root", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("head", "id")).cast("bigint").alias("component_id"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95; one vector of each component is kept."""
    return near_links(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
