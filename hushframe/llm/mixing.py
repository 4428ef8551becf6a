"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree."""

from __future__ import annotations

import random
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushframe.llm.common import cut, free_name, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST = 3
#: Rows of a cell of the first level, about; cells that meet in one cell of the next level.
CELL, FAN = 256, 64
#: Sources are a dimension of the corpus: their totals go to the driver, up to this many.
MOST_SOURCES = 100_000
SEED = 17


def water_fill(sizes: Sequence[int], weights: Sequence[int], most: int = MOST) -> list[Fraction]:
    """Shares of the sum of sizes by weight; none above most times its size, what is over going to the others by weight."""
    total, target, free = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while free and total > 0:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if total * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = total * weights[i] / whole
            break
        for i in full:
            target[i] = Fraction(most * sizes[i])
            total -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def pivot(units: list[tuple[int, int, float]], draw: random.Random) -> tuple[list[tuple[int, float]], tuple[int, int, float] | None]:
    """Rounds the fractions p of (key, size, p), sizes positive: ([(key, 0 or 1)], the one that stays fractional or None).

    Two units at a time: words move from one to the other until either is at 0 or 1, in the direction that a draw
    picks with the odds that keep both expectations. The sum of size * p never changes.
    """
    done, held = [], None
    for key, size, p in units:
        if p <= 1e-12 or p >= 1 - 1e-12:
            done.append((key, float(round(p))))
            continue
        if held is None:
            held = (key, size, p)
            continue
        k2, s2, p2 = held
        up, down = min((1 - p) * size, p2 * s2), min(p * size, (1 - p2) * s2)  # words to this unit; words from it
        move = up if draw.random() * (up + down) < down else -down
        p, p2 = p + move / size, p2 - move / s2
        left = [(k, s, q) for k, s, q in ((key, size, p), (k2, s2, p2)) if 1e-12 < q < 1 - 1e-12]
        done += [(k, float(round(q))) for k, s, q in ((key, size, p), (k2, s2, p2)) if not 1e-12 < q < 1 - 1e-12]
        held = left[0] if left else None
    return done, held


def _rounds(level: int, last: bool, seed: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, by = int(pdf["cell"].iloc[0]), {}
        for src, *unit in zip(*(pdf[c].tolist() for c in ("src", "key", "size", "p"))):
            by.setdefault(src, []).append(tuple(unit))
        out = []
        for src, units in sorted(by.items()):
            draw = random.Random(f"{seed}|{level}|{at}|{src}")
            done, held = pivot(sorted(units), draw)
            if held and last:
                done.append((held[0], 1.0 if draw.random() < held[2] else 0.0))
                held = None
            out += [(src, at, k, 0, p, True) for k, p in done]
            if held:
                out.append((src, at, *held, False))
        return pd.DataFrame(out, columns=["src", "cell", "key", "size", "p", "done"])

    return run


def _bars(units: DataFrame) -> dict[int, tuple[int, int]]:
    """For each source, the power of two under which sizes hold a third of its words or just over, and their words."""
    by: dict[int, list[tuple[int, int]]] = {}
    for r in units.groupBy("src", F.floor(F.log2("size")).cast("int").alias("power")).agg(F.sum("size").alias("size")).collect():
        by.setdefault(r["src"], []).append((r["power"], int(r["size"])))
    out = {}
    for src, parts in by.items():
        whole, under = sum(n for _, n in parts), 0
        for power, n in sorted(parts):
            under += n
            if 3 * under >= whole:
                out[src] = (2 << power, under)
                break
    return out


def _tree(units: DataFrame, count: int, seed: str) -> DataFrame:
    """(key, more): the units (src, key, size, p) rounded, level by level, until one cell is left."""
    cells, step, done = max(1, -(-count // CELL)), 0, []
    level = units.select("src", F.pmod(F.shiftrightunsigned("key", 8), F.lit(cells)).alias("cell"), "key", "size", "p")
    while True:
        last = cells == 1
        made = cut(level.groupBy("cell").applyInPandas(_rounds(step, last, seed), LEVEL))
        done.append(made.where("done").select("key", F.col("p").alias("more")))
        if last:
            break
        cells, step = -(-cells // FAN), step + 1
        level = made.where("not done").select("src", F.floor(F.col("cell") / FAN).cast("bigint").alias("cell"), "key", "size", "p")
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.union(d)
    return rounded


LEVEL = "src int, cell bigint, key bigint, size bigint, p double, done boolean"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> list[tuple[str | None, int, float, Fraction]]:
    """(source, its size, target, copies of each of its words) in order of code points, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    fill = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    return [(r["source"], n, float(t), t / n if n else Fraction(0)) for r, n, t in zip(rows, sizes, fill)]


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies): how often each row enters the mix.

    A row's size is its number of words. A source is wanted target / source_size times: each of its rows enters the
    whole part of that, and once more where rounding its fraction gives 1. Rounding goes through a tree: rows meet
    in cells of about 256 by a hash of the row, whatever their source, so a source with most rows is spread like
    the others; each cell leaves at most one unrounded row for a source, which meet those of 64 cells, and so on to
    one. Large rows go through the tree first; what their last one adds or lacks moves to the odds of the small
    ones (a third of the source's words), so a source misses its target by about the size of a small row. Draws are seeded by cell and source:
    reruns agree, whatever the partitions. Null text has size 0; rows of size 0 have no copies beyond the whole
    part; a null source is a source; rows that are equal in id, source and size are told apart by their number of
    repeats; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("bigint").alias("size"),
    )
    sized = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("times")))
    targets = source_targets(sized.select("source", (F.col("size") * F.col("times")).alias("size")), weights, most)
    dims = spark.createDataFrame(
        [(s, i, n, t, int(c), float(c - int(c))) for i, (s, n, t, c) in enumerate(targets)],
        "source string, src int, source_size bigint, target double, whole int, part double",
    )
    # the sources' number is bounded above, so their table is
    rows = sized.join(F.broadcast(dims), sized["source"].eqNullSafe(dims["source"])).drop(dims["source"])
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).withColumn("key", F.xxhash64("id", "source", "size", "time"))
    rows = rows.select("id", "source", "size", "src", "source_size", "target", "whole", "part", "key")
    count = sized.agg(F.sum("times")).first()[0] or 0
    units = rows.where("part > 0 and size > 0").select("src", "key", "size", F.col("part").alias("p"))
    bars = _bars(units)
    known = spark.createDataFrame([(k, v[0]) for k, v in bars.items()], "src int, bar bigint")
    units = units.join(F.broadcast(known), "src")
    large = _tree(units.where("size >= bar").drop("bar"), count, f"{seed}|large")
    missed = units.where("size >= bar").join(large, "key").groupBy("src").agg(F.sum(F.col("size") * (F.col("more") - F.col("p"))).alias("over"))
    shift = {r["src"]: -r["over"] / bars[r["src"]][1] for r in missed.collect() if bars[r["src"]][1]}
    known = spark.createDataFrame([(k, float(shift.get(k, 0.0))) for k in bars], "src int, shift double")
    small = units.where("size < bar").join(F.broadcast(known), "src")
    small = small.select("src", "key", "size", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("shift"))).alias("p"))
    rounded = large.union(_tree(small, count, f"{seed}|small"))
    return rows.join(rounded, "key", "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies")
    )


def resample(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source and more) as mixed: each row as many times as its copies, none with 0.

    All columns pass, whatever their names; null ids, texts and sources and rows that repeat are as in `mix`; an empty
    table gives none.
    """
    id_, source, size, copies, n = (free_name(docs, x) for x in ("mixed_id", "mixed_source", "mixed_size", "mixed_copies", "mixed_n"))
    key = [id_, source, size]
    sizes = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text"), F.lit(WORD))).cast("bigint")
    mixed = mix(docs, **options)
    times = cut(mixed.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size)).agg(F.collect_list("copies").alias(copies)))
    sized = docs.withColumns({id_: F.col("doc_id"), source: F.col("source").cast("string"), size: sizes})
    same = [sized[k].eqNullSafe(times[k]) for k in key]
    parts = [sized.join(times.where(F.size(copies) == 1).hint("shuffle_hash"), same).withColumn(n, F.col(copies)[0])]
    again = times.where(F.size(copies) > 1)
    if again.limit(1).count():  # rows that repeat in id, source and size: told apart by rank
        w = Window.partitionBy(*[times[k] for k in key]).orderBy("text")
        parts.append(sized.join(again.hint("shuffle_hash"), same).withColumn(n, F.get(copies, F.row_number().over(w) - 1)))
    out = [p.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns]) for p in parts]
    return out[0] if len(out) == 1 else out[0].union(out[1])


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
