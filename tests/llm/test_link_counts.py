"""How many rows each row of a similarity join links with."""

import random
from collections import Counter

import pytest

from hushframe.llm import ngram_join, set_links
from tests.llm.test_links import alike, corpus, shingles


@pytest.mark.parametrize("k, percent, block", [(3, 90, 512), (5, 80, 4)])
def test_links_are_counted(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(set_links, "BLOCK", block)
    rows = list(enumerate(corpus(12) + corpus(12)[:20]))
    random.Random(13).shuffle(rows)
    sets = {i: shingles(t, k) for i, t in rows}
    expected = Counter(i for i in sets for j in sets if i != j and alike(sets[i], sets[j], percent))
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, times int, links int").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_components(docs, k, percent).collect()} == {i: expected[i] for i in sets}


def test_links_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other text of the same id"), (None, "a b c d"), (7, "A b c d"), (5, None), (None, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["n_links"])) for r in got) == [("1", 2, "2"), ("1", 2, "2"), ("1", 4, "0"), ("5", 0, "0"), ("7", 2, "2"), ("None", 0, "None"), ("None", 2, "None")]


def test_large_groups_are_cut_into_few_blocks(spark, monkeypatch):
    """A text of a large group goes to as many tasks as the group has blocks; a block is multiplied part by part."""
    sizes = spark.createDataFrame([(n * 512, n * 10) for n in (1, 3, 8, 100, 1000)], "items long, shingles long")
    assert [r[0] for r in sizes.select(set_links.blocks_of(sizes["items"], sizes["shingles"])).collect()] == [1, 3, 8, 8, 63]
    monkeypatch.setattr(set_links, "FEW_BLOCKS", 1)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(700):
        text = list(base)
        for _ in range(draw.randrange(1, 4)):
            text[draw.randrange(150)] = f"x{d}"
        rows.append((d, " ".join(text)))
    sets = [shingles(t, 3) for _, t in rows]
    expected = Counter()
    for i in range(700):
        for j in range(i):
            if alike(sets[i], sets[j], 90):
                expected.update((i, j))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: expected[i] for i in range(700)}
    assert 0 < min(expected.values()) < 699
