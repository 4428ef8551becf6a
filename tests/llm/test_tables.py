"""Operators over whole tables: mixing, embeddings, and the pipeline."""

import importlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from hushframe.llm import embedding_dedup, mixing


def test_water_fill():
    assert mixing.water_fill([80, 10, 10], [5, 2, 1]) == [Fraction(125, 2), Fraction(25), Fraction(25, 2)]
    got = mixing.water_fill([98, 1, 1], [1, 5, 2])
    assert got == [94, 3, 3]
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5, 2]) == [0, 0] and mixing.water_fill([0, 4], [5, 2]) == [0, 4]


def test_pivot_keeps_words_and_odds():
    draw = random.Random(1)
    hits = Counter()
    for _ in range(4000):
        done, held = mixing.pivot([(0, 3, 0.3), (1, 5, 0.6), (2, 2, 0.5)], draw)
        size = {0: 3, 1: 5, 2: 2}
        total = sum(size[k] * p for k, p in done) + (held[1] * held[2] if held else 0)
        assert abs(total - (0.9 + 3 + 1)) < 1e-9 and all(p in (0.0, 1.0) for _, p in done) and len(done) >= 2
        for k, p in done:
            hits[k] += p
        if held:
            hits[held[0]] += held[2]
    assert all(abs(hits[k] / 4000 - p) < 0.04 for k, p in ((0, 0.3), (1, 0.6), (2, 0.5)))


def corpus(spark, n=3000):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 3, 20, 60, 300])), draw.choice(["big"] * 6 + ["b", "c", "é", None])) for i in range(n)]
    rows += [(n, None, "big"), (n + 1, "a b", None), (n + 1, "a b", None), (n + 1, "c d", None), (None, "x y z", "c")]
    return rows, spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")


def test_mix_meets_targets_and_repeats(spark):
    rows, docs = corpus(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    assert sizes == [sum(len((t or "").split()) for _, t, s in rows if s == o) for o in order]
    targets = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, n, t in zip(order, sizes, targets):
        assert all(r["source_size"] == n and r["target"] == pytest.approx(float(t)) for r in by[s])
        taken = sum(r["copies"] * r["size"] for r in by[s])
        assert abs(taken - float(t)) <= 300 and abs(taken - float(t)) < 0.03 * float(t)
        assert all(r["copies"] in (int(t / n), int(t / n) + 1) and r["copies"] <= 3 for r in by[s])
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_resample(spark):
    rows, docs = corpus(spark, 400)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter()
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"], r["source"], len((r["text"] or "").split())] += 1
    assert got == Counter({k: v for k, v in copies.items() if v})


def vectors(seed=1):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(30):
        base = draw.normal(size=16)
        out += [base * draw.uniform(0.5, 2) + draw.normal(size=16) * s for s in (0, 0.02, 0.1, 0.25, 0.3)[: draw.integers(1, 6)]]
    out += [out[0], out[0], np.tile(out[3], 1) * 3]
    return [v.astype(np.float32).tolist() for v in out] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] + [0.0] * 15, [3e38] * 16]


def expected(rows):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links, root = Counter(), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a < b and len(x) == len(y) and (x / abs(x).max()) @ (y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= 0.95 - 1e-12:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("node, span, kind", [(4096, 16, "float"), (16, 16, "float"), (16, 1, "float"), (8, 2, "double")])
def test_embeddings_against_all_pairs(spark, monkeypatch, node, span, kind):
    monkeypatch.setattr(embedding_dedup, "NODE", node)
    monkeypatch.setattr(embedding_dedup, "SPAN", span)
    vs = vectors()
    order = list(range(len(vs)))
    random.Random(3).shuffle(order)
    rows = [(i, vs[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, item int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_links(df).collect()}
    assert got == expected(rows)
    assert embedding_dedup.near_links(df.limit(0)).count() == 0


def test_blocks_follow_tasks_and_bytes():
    assert embedding_dedup._span(1, 64, 200) == 1 and embedding_dedup._span(13, 64, 8) == 4
    assert embedding_dedup._span(10**6, 64, 200) == 16 and embedding_dedup._span(10**6, 1024, 200) == 1


def test_tree_holds_all_and_traversal_loses_nothing():
    draw = np.random.default_rng(2)
    x = embedding_dedup._unit(np.concatenate([c + draw.normal(size=(60, 12)) * s for c, s in zip(draw.normal(size=(8, 12)) * 3, (0.05, 0.1, 0.2, 0.4, 0.8, 1, 1, 2))]))
    t = embedding_dedup.Tree(x)
    assert sorted(i for m in t.members for i in m) == list(range(len(x)))
    for level, (centres, parents, radius) in enumerate(t.levels[1:], 1):
        above, _, far = t.levels[level - 1]
        assert set(above) <= set(centres)
        assert (np.linalg.norm(x[centres] - x[above[parents]], axis=1) <= far[parents] + 1e-3).all()
    full = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    back = embedding_dedup.Tree.unpacked(t.packed(), x)
    i, j = embedding_dedup.dual_pairs(t, back, x, x, float(np.sqrt(0.1)), 0.95, True)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == {tuple(p) for p in full.tolist()} and len(i) == len(full)


def test_pipeline(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], folder).checkpoint())
    good, single, plain, mixed, pieces = seen[1:]
    assert all(d.columns == docs.columns for d in seen[:5]) and good.count() <= 200
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    from tests.llm.test_links import brute

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert ids(single) == {i for i, c in brute(rows, 5, 80).items() if i == c}
    assert ids(plain) <= ids(single) and ids(mixed) <= ids(plain) and pieces.count() == mixed.count()
    run = corpus_pipeline.run(spark, folder)
    key = lambda d: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in d.collect())
    assert key(run) == key(pieces)
