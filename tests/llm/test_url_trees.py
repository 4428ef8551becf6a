"""The trees of op6: scored by plain Python, judged on urls that they weren't fitted on, and telling urls of one suffix apart."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hushframe.llm import mixing, quality, url_filters


def labelled(spark):
    draw = random.Random(8)
    rows = []
    for i in range(1500):
        bad = draw.random() < 0.5
        rows.append((f"http://{draw.choice(['a', 'bb'])}.example.{draw.choice(['com', 'net'])}/" + "/".join(str(draw.randrange(10 ** (5 if bad else 1))) for _ in range(3)) + f"?{i}", bad))
    host, path = url_filters.parts(F.col("url"))
    return spark.createDataFrame(rows, "url string, blocked boolean").withColumns({"host": host, "path": path})


def test_trees(spark):
    df = labelled(spark)
    assert url_filters.held_out_auc(df) > 0.97 and url_filters.held_out_auc(df.where("blocked")) is None
    # labels that say nothing: rates that held a row's own label would give it away
    coin = df.withColumn("blocked", F.xxhash64("url") % 2 == 0).withColumn("host", F.concat(F.md5("url"), F.lit(".x.example.com")))
    assert 0.3 < url_filters.held_out_auc(coin) < 0.7
    model = url_filters.fit(df)
    seen = model.with_rates(url_filters.lexical(df)).withColumn("p", model.probability()).collect()

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, b, left, right = tree
            edges = model.edges[url_filters.FEATURES[f]]
            tree = left if b >= len(edges) or row[url_filters.FEATURES[f]] <= edges[b] else right
        return tree

    for row in seen[:200]:
        assert row["p"] == pytest.approx(1 / (1 + math.exp(-model.base - sum(walk(t, row) for t in model.trees))))
    for tld in ("com", "net"):
        assert {r["p"] >= 0.5 for r in seen if r["host"].endswith(tld)} == {True, False}


def test_clashing_names_of_filters(spark):
    rows = [(i, "the house is green and the river runs " * 3 if i % 2 else "BUY!! NOW!! " * 9, "s", 0.5, "m", 1, 2) for i in range(80)]
    docs = spark.createDataFrame([*rows, *rows[:2], (900, None, None, 0.5, "m", 1, 2)], "doc_id long, text string, source string, score double, mixed_id string, _score int, mixed_n int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {0.5} and 0 < kept.count() < 83
    out = mixing.resample(docs)
    assert out.columns == docs.columns and {(r["mixed_id"], r["_score"], r["mixed_n"]) for r in out.collect()} == {("m", 1, 2)}
    assert mixing.resample(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0), labels).count() == 0


def test_a_text_over_the_budget_is_passed_over(spark):
    rows = [(i, "the house is green " * 5 if i % 2 else "BUY!! NOW!! " * 9, i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t * (1000 if i < 30 and i % 3 == 0 else 1)) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    assert quality.fit(docs, labels, most=20_000).network is not None
