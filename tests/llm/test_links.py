"""Set similarity and passages against plain Python on small tables that hold every odd case."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hushframe.llm import ngram_join, set_links, substring_dedup, textops
from hushframe.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def alike(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def brute(rows, k, percent):
    """{key: smallest key of its component} of (key, text)."""
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(sets[a], sets[b], percent):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus(seed=1, bases=12, copies=9):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for n in range(bases):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([5, 8, 12, 20, 40, 90, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words.append("tail")
            texts.append(" ".join(words) if draw.random() < 0.5 else "\n\t".join(w.upper() for w in words))
    return [*texts, None, "", " \n", "one", "ONE", "two words", "two  WORDS", "é É", "x" * 5000, "a b c d"]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join_is_exact(spark, k, percent):
    rows = list(enumerate(corpus()))
    draw = random.Random(2)
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, item string, root int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, k, percent).collect()}
    expected = brute(rows, k, percent)
    assert got == {i: (len(shingles(t, k)), expected[i]) for i, t in rows}
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs, k, percent).collect()}
    assert kept == {i for i, c in expected.items() if i == c}


def test_join_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other text of the same id"), (None, "a b c d"), (7, "a b c d"), (5, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("1", 4, "1"), ("5", 0, "5"), ("7", 2, "1"), ("None", 2, "None")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty, 3, 90).count() == 0 and substring_dedup.repeated_passages(empty).count() == 0


def test_large_group_in_blocks(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 300


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_lose_nothing(percent):
    sign = set_links.partition_signatures(percent)
    draw = np.random.default_rng(4)
    for _ in range(1500):
        n = int(draw.integers(1, 260))
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        most = int((1 - percent / 100) / (1 + percent / 100) * 2 * n)
        gone = int(draw.integers(0, most + 1))
        b = np.concatenate([a[: n - min(gone // 2, n - 1)], draw.integers(0, 2**63, gone - gone // 2).astype(np.uint64)])
        x, y = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
            who, sig = sign([x, y])
            assert set(sig[who == 0]) & set(sig[who == 1])


def test_sliced_bands_find_pairs_at_the_threshold():
    sign = set_links.sliced_signatures(80)
    draw = np.random.default_rng(6)
    for n in (9, 36, 99, 153, 171, 198, 252, 603):  # sets of n with n / 9 changed: a similarity of 0.8
        for _ in range(12):
            a = draw.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: n - n // 9], draw.integers(0, 2**63, n // 9).astype(np.uint64)])
            who, sig = sign([np.unique(a), np.unique(b), np.empty(0, np.uint64)])
            assert set(sig[who == 0]) & set(sig[who == 1]) and not (who == 2).any()


def test_product_against_sets():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(draw.choice(pool[:60], int(draw.integers(30, 60)))) for _ in range(20)]
    i, j = set_links._product(sets[:9], sets[9:], False, 60)
    full = {(a, b) for a in range(9) for b in range(11) if 100 * len(np.intersect1d(sets[a], sets[9 + b])) >= 60 * len(np.union1d(sets[a], sets[9 + b]))}
    assert set(zip(i.tolist(), j.tolist())) == full
    i, j = set_links._product(sets, sets, True, 60)
    assert all(a < b for a, b in zip(i, j))


def test_words_are_the_patterns():
    draw = random.Random(6)
    texts = ["".join(draw.choice("aB \t\n\r\x0b\x1c é,") for _ in range(draw.randrange(40))) for _ in range(300)]
    buf, starts = textops.payload(pa.array([t.encode() for t in texts]))
    begin, end, bounds = textops.words(buf, starts)
    for i, t in enumerate(texts):
        assert [buf[b:e].tobytes().decode() for b, e in zip(begin[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])] == WORD.findall(t)
    h = textops.word_hashes(buf, begin, end)
    by = {}
    for b, e, x in zip(begin, end, h):
        by.setdefault(buf[b:e].tobytes().decode().translate(LOWER), set()).add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_passages(spark):
    draw = random.Random(7)
    passage = [f"p{draw.randrange(999)}" for _ in range(60)]
    near = [*passage[:55], "changed", *passage[56:]]
    own = lambda n: " ".join(f"{n}v{draw.randrange(10**6)}" for _ in range(70))
    texts = {1: own(1) + "\n" + " ".join(passage), 2: "short line\n" + " ".join(near) + "\n" + own(2), 3: own(3) + "\nshort line", 4: " ".join(passage).upper(), 5: None, 6: "", 8: own(8)}
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in texts.items()], "doc_id long, text string, head string, n_chars long")
    found = substring_dedup.repeated_passages(docs)
    assert sorted((r["doc_id"], r["paragraph"], r["kept_doc_id"], r["kept_paragraph"]) for r in found.collect()) == [(2, 1, 1, 1), (4, 0, 1, 1)]
    left = {r["doc_id"]: r for r in substring_dedup.without_passages(docs, found).collect()}
    assert set(left) == {1, 2, 3, 5, 6, 8} and left[2]["text"] == "short line\n" + texts[2].split("\n")[2] and left[2]["n_chars"] == len(left[2]["text"])
    assert all(left[i]["text"] == texts[i] for i in (1, 3, 5, 6, 8)) and left[5]["n_chars"] == 7


def test_passages_against_plain_python(spark):
    rows = list(enumerate(" ".join(t.split()) for t in corpus(8, 10, 6) if t))
    docs = spark.createDataFrame([(i, t + "\n" + t) for i, t in rows], "doc_id long, text string")
    parts = [((i, n), t) for i, t in rows for n in (0, 1) if len(t.split()) >= 20]
    expected = {key: root for key, root in brute(parts, 5, 80).items() if key != root}
    got = {(r["doc_id"], r["paragraph"]): (r["kept_doc_id"], r["kept_paragraph"]) for r in substring_dedup.repeated_passages(docs, least=20).collect()}
    assert got == expected


def test_bands_are_tuned():
    n = substring_dedup.tune_bands(80)
    assert 1 - (1 - 0.8**4) ** n >= 0.999 > 1 - (1 - 0.8**4) ** (n - 1)


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
