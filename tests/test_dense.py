"""The rules of spans in numpy are those of the array expressions."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.functions.generalize import general_of, generalized
from hushframe.operators import dense, pseudonyms
from hushframe.operators import spans as S
from hushframe.plans import inputs
from hushframe.plans.queries import QUERIES
from hushframe.taxonomy import CATEGORIES
from tests.helpers import spans_of

ODD = "ab1 \t\n\x1c\x85\xa0    　é٣𝒳🙂,"


@pytest.fixture(scope="module")
def given(spark):
    """(docs, spans as a table, docs with them as arrays that are not in order)"""
    draw = random.Random(5)
    docs, found = [(200, "no spans"), (0, None), (1, ""), (2, "spans"), (3, "x" * 70)], [(0, "email", 0, 3), (2, "email", 0, 2), (1, "email", 0, 1), (3, "age", 4, 4), (3, "age", 9, 5), (3, "email", 60, 90)]
    for d in range(4, 200):
        docs.append((d, "".join(draw.choice(ODD) for _ in range(draw.randrange(1, 90)))))
        for _ in range(draw.randrange(12)):
            start = draw.randrange(len(docs[-1][1]))
            found.append((d, draw.choice(["email", "age", "country", "death_date"]), start, min(len(docs[-1][1]), start + draw.randrange(0, 9)), draw.choice([None, 0.5, 0.25])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans = spans_of(spark, frame, found).withColumn("text", F.when(F.col("doc_id") > 3, F.upper("text")).otherwise(F.col("text"))).cache()
    placed = S.placed(*[F.col(c) for c in ("start", "end", "span_idx", "category", "l1", "text", "score")])
    lists = spans.groupBy("doc_id").agg(F.shuffle(F.collect_list(placed)).alias("mine"))
    return frame, spans, frame.join(lists, "doc_id", "left").cache()


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b))
    assert a == b and a


def test_union(given):
    docs, spans, rows = given
    same(dense.union_overlapping(rows, F.col("mine")), S.union_overlapping(docs, spans))


def test_replaced(given):
    docs, spans, rows = given
    same(dense.apply_mask(rows, F.col("mine"), "#").select("doc_id", "text"), S.apply_mask(docs, spans, "#"))
    same(dense.redact(rows, F.col("mine"), "<{l1}|{category}>{{").select("doc_id", "text"), S.redact(docs, spans, "<{l1}|{category}>{{"))
    same(dense.anonymize(rows, F.col("mine")).select("doc_id", "text"), pseudonyms.anonymize(docs, spans))
    for template in ("{l1}", "{{", "", "}}", "a}}b"):
        same(dense.redact(rows, F.col("mine"), template).select("doc_id", "text"), S.redact(docs, spans, template))
    assert S.mask_of("{l1}")("email", "contact") == "contact" and S.mask_of("}}")("", "") == "}}" and dense.redact(rows, F.col("mine")).columns == rows.columns
    for bad in ("{text}", "{", "{0}"):
        with pytest.raises(ValueError):
            dense.redact(rows, F.col("mine"), bad)


def test_small_slices(given, monkeypatch):
    """Texts are worked on a few at a time, in whatever slices."""
    import pyarrow as pa

    docs, _, rows = given
    batches = rows.select("doc_id", "text", "mine").orderBy("doc_id").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(dense, "SPANS", 7)
    monkeypatch.setattr(dense, "BYTES", 50)
    parts = list(dense._slices(iter(batches), "mine"))
    assert len(parts) > 50 and pa.Table.from_batches(parts)["doc_id"].to_pylist() == list(range(201))
    for b in parts:
        found, texts = dense.Spans(b["mine"]), dense.Texts(b["text"])
        found.unite()
        for row, s, e, t, own in zip(found.row, found.start, found.end, found.texts(texts).to_pylist(), found.own):
            text = b["text"][int(row)].as_py()
            assert t is None if text is None else own or t == text[s:e]


def test_general_of(spark):
    values = ["", "none", "42 yrs", "007", "0", "٤٢", "x2019", "19 1999", "1999é", "1999́", "²1999", "1999²", "Ⅷ1999", "a-2001-b", "ⓐ1999", "_1999", "12000", "20٣٤", "1899 2099"]
    pairs = [(c, v) for c in ("age", "death_date", "country", "email", "postal_zip_pin_code", "no_such_one", *CATEGORIES) for v in values]
    df = spark.createDataFrame(pairs, "c string, v string").distinct()
    for c, v, want in df.select("c", "v", generalized(F.col("c"), F.col("v"))).collect():
        by = general_of(c)
        assert (v if by is None else by if isinstance(by, str) else by[1](v)) == want, (c, v)
        if isinstance(by, tuple) and not any(x.isdecimal() for x in v):
            assert by[0] == want


def test_made_in_row(spark):
    docs = spark.createDataFrame(list(enumerate([None, "", "short", "é𝒳\n" * 31, "w" * 40, "w" * 69, "v" * 160, *["ab c" * 30] * 30])), "doc_id bigint, text string")
    one = F.explode(inputs.made_in_row(F.col("doc_id"), F.col("text"))).alias("s")
    got = docs.select("doc_id", one).select("doc_id", *[f"s.{c}" for c in ("span_idx", "category", "start", "end", "l1", "text", "score")])
    same(got, inputs.made_spans(docs))


@pytest.mark.parametrize("name", ["anonymize_text", "spans_union", "mask_without_merge", "redact_l1_mask"])
def test_made_spans_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode([0,1,2,3,4])" not in plan


def test_a_table_is_united_once_a_text(spark):
    """A filter on the exploded array would unite each text's spans a second and third time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = S.union_overlapping(docs, inputs.made_spans(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max") == 1
