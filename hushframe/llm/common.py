"""Pieces shared by the operators of this folder: tables, checkpoints, Arrow slices, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 2 << 20
#: Links to a task where components are sought, about.
LINKS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one of this machine, with a local master only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="hushframe-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the shared one; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that a lost executor takes no result with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, in slices whose texts hold about `most` bytes (or one row, if that alone is larger)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node of its component, for the edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    move = roots != np.arange(len(nodes))
    return nodes[roots[move]], nodes[move]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that links lead to.

    Large-star and small-star rounds: each moves a node's links to the smallest neighbour that it sees, so the
    longest path shrinks geometrically. A hub's links are never in one place: minima are combined before the
    shuffle, and the joins read two written tables, so that adaptive execution splits a key with many rows.
    Edges with a null end and loops give nothing.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    was = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            break
        was, n = now, -(-now[0] // LINKS)
        # as many files as the links need: rounds are many, and each would leave a few for every partition
        both = e.union(e.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")).coalesce(n))
        large = (
            both.where("v > u").hint("merge").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = cut(large.coalesce(n))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(n))
        e = cut(
            large.hint("merge").join(least.hint("merge"), "u")
            .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least).distinct().coalesce(n)
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", F.col("v")).distinct()
    )
