import random
import time

import pytest
from pyspark.sql import functions as F

from hushframe.operators import spans as S
from hushframe.operators.reports import highlighted
from hushframe.sources.files import spans_json
from hushframe.sources.rules import rule_spans, spans_in_row
from tests.helpers import covered, docs_of, spans_of, texts

NAME, CITY = "primary_subject_name", "city_district"


def rows(df):
    return [(r["doc_id"], r["category"], r["start"], r["end"], r["score"]) for r in df.orderBy("doc_id", "start").collect()]


def test_masks(spark):
    docs = docs_of(spark, "Name Asha here", "a@b.com and Asha", "Rajesh Kumar Sharma lives here.", None, "plain")
    spans = spans_of(spark, docs, [(1, NAME, 5, 9), (2, NAME, 12, 16), (2, "email", 0, 7), (3, NAME, 0, 6), (3, NAME, 0, 19)])
    assert texts(S.redact(docs, spans)) == {1: "Name [REDACTED] here", 2: "[REDACTED] and [REDACTED]", 3: "[REDACTED] lives here.", 4: None, 5: "plain"}
    assert texts(S.redact(docs, spans, "[{category}]"))[1] == f"Name [{NAME}] here"
    assert texts(S.apply_mask(docs, spans, "<{l1}> {{x}}"))[1] == "Name <person> {x} here"
    for bad in ("{text}", "{category.x}", "{", "{0}"):
        with pytest.raises(ValueError):
            S.mask(bad)


def test_union_and_merge(spark):
    docs = docs_of(spark, "abcdef", "UH00219834X", "Patient: Mr. John Doe here", "John, Asha", "Indiranagar Karnataka", "ab")
    spans = spans_of(spark, docs, [
        (1, "email", 0, 4), (1, "email", 2, 6), (2, "other_id", 0, 3), (2, "mrn_uhid", 0, 11), (3, NAME, 9, 17, 0.91239), (3, NAME, 18, 21, 0.8), (4, NAME, 0, 4), (4, NAME, 6, 10),
        (5, CITY, 0, 11), (5, "state_province", 12, 21), (6, NAME, 0, 1), (6, NAME, 1, 2, None),
    ])
    assert rows(S.union_overlapping(docs, spans))[:2] == [(1, "email", 0, 6, 0.9), (2, "mrn_uhid", 0, 11, 0.9)]
    got = rows(S.merge_adjacent(docs, spans))
    assert got[2:] == [(3, NAME, 9, 21, 0.8), (4, NAME, 0, 4, 0.9), (4, NAME, 6, 10, 0.9), (5, CITY, 0, 11, 0.9), (5, "state_province", 12, 21, 0.9), (6, NAME, 0, 2, None)]
    assert texts(S.apply_mask(docs, spans, "#"))[3] == "Patient: # # here" and texts(S.redact(docs, spans, "#"))[3] == "Patient: # here"


def reference_merge(text, spans):
    """Spans (start, end, category, score, place) joined by the two rules, one after the other."""
    groups = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[4])):
        if groups and s[0] < max(x[1] for x in groups[-1]):
            groups[-1].append(s)
        else:
            groups.append([s])
    united = []
    for g in groups:
        widest = max(g, key=lambda s: s[1] - s[0])
        united.append([g[0][0], max(s[1] for s in g), widest[2], widest[3]])
    out = []
    for u in united:
        if out and out[-1][2] == u[2] and not text[out[-1][1] : u[0]].strip():
            low = [x for x in (out[-1][3], u[3]) if x is not None]
            out[-1] = [out[-1][0], u[1], u[2], min(low) if len(low) == 2 else None]
        else:
            out.append(u)
    return [tuple(u) for u in out]


def test_random_spans_against_plain_python(spark):
    draw = random.Random(11)
    docs, given = [], []
    for d in range(300):
        docs.append((d, "".join(draw.choice("ab \t 🙂,") for _ in range(30))))
        for _ in range(draw.randrange(7)):
            start = draw.randrange(28)
            given.append((d, draw.choice(["email", "age"]), start, min(30, start + draw.randrange(1, 9)), draw.choice([None, 0.5, 0.25, 0.75])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans = spans_of(spark, frame, given)
    got = {}
    for r in S.merge_adjacent(frame, spans).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["category"], r["score"]))
    by = {}
    for i, (d, c, s, e, sc) in enumerate(given):
        by.setdefault(d, []).append((s, e, c, sc, i))
    text = dict(docs)
    assert got == {d: reference_merge(text[d], s) for d, s in by.items()}
    for d, found in got.items():
        assert covered((s[0], s[1]) for s in by[d]) <= covered((f[0], f[1]) for f in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    again = S.merge_adjacent(frame, S.merge_adjacent(frame, spans))
    assert rows(again) == rows(S.merge_adjacent(frame, spans))


def test_empty_and_inverted_spans_are_nothing(spark):
    docs = docs_of(spark, "hello")
    spans = spans_of(spark, docs, [(1, NAME, 2, 2), (1, NAME, 4, 3)])
    assert texts(S.redact(docs, spans)) == {1: "hello"} and S.merge_adjacent(docs, spans).count() == 0
    assert [r["body"] for r in spans_json(docs, spans.limit(0)).collect()] == ['{"spans":[]}']


def test_rules(spark):
    hexes = "0f" * 20
    docs = docs_of(spark, f'🙂 mail ann.b1@mail7.example.com, +1 (555) 123-4567; 10.0.0.1 TOKEN = "{hexes}" 1234567890123456', "", None, "nothing")
    got = rule_spans(docs).orderBy("start").collect()
    assert [r["category"] for r in got] == ["email", "phone_mobile", "ip_address", "api_key_token", "other_id"]
    text = docs.first()["text"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got) and [r["span_idx"] for r in got] == list(range(5))
    assert [r["category"] for r in rule_spans(docs, ["ip_address"]).collect()] == ["ip_address"] and rule_spans(docs, []).count() == 0
    in_row = docs.select("doc_id", F.explode(spans_in_row(F.col("text"))).alias("s")).select("s.category", "s.start", "s.end").orderBy("start").collect()
    assert [tuple(r) for r in in_row] == [(r["category"], r["start"], r["end"]) for r in got]


def test_highlight(spark):
    docs = docs_of(spark, "a <b> c", "none")
    spans = spans_of(spark, docs, [(1, "email", 2, 5, 0.5), (1, "age", 3, 6), (1, "age", 6, 7, None)])
    assert [r["html"] for r in highlighted(docs, spans).collect()] == ['a <mark class="contact" title="email · 0.500">&lt;b&gt;</mark> <mark class="person" title="age">c</mark>']


def test_plan_has_one_text_shuffle_and_no_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = S.redact(docs.select("doc_id", "text"), rule_spans(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan and "Arrow" not in plan


def test_one_long_text_with_very_many_spans(spark):
    """Time grows with the spans of a text, not with their square."""
    n = 100_000
    text = "ab 🙂cde " * n
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    i = F.col("id").cast("int")
    at = i * 8 + F.pmod(i * 7, F.lit(5))
    spans = spark.range(n).select(
        F.lit(1).cast("bigint").alias("doc_id"), i.alias("span_idx"), F.when(i % 3 == 0, "email").otherwise("age").alias("category"), at.alias("start"), (at + 1 + i % 11).alias("end"),
        F.lit("x").alias("l1"), F.lit("own").alias("text"), F.lit(0.5).alias("score"),
    )
    began = time.perf_counter()
    merged = S.merge_adjacent(docs, spans, rounded=False).orderBy("start").collect()
    masked = texts(S.redact(docs, spans, "#"))[1]
    assert time.perf_counter() - began < 60
    given = [(s := 8 * k + 7 * k % 5, s + 1 + k % 11, "age" if k % 3 else "email", 0.5, k) for k in range(n)]
    expected = reference_merge(text, given)
    assert [(r["start"], r["end"], r["category"], r["score"]) for r in merged] == expected
    alone = {(s[0], s[1]) for s in given}
    assert all(r["text"] == text[r["start"] : r["end"]] or (r["start"], r["end"]) in alone and r["text"] == "own" for r in merged)
    edges = [0, *(x for r in expected for x in r[:2]), len(text)]
    assert masked == "#".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
