import json

import pytest

from hushframe.operators import pseudonyms as P
from tests.helpers import docs_of, spans_of, texts

NAME, OTHER, CITY = "primary_subject_name", "other_person_name", "city_district"


def found(spark, rows):
    """rows: (record, page, start, category, value)."""
    from pyspark.sql import functions as F

    from hushframe.functions.text import normal
    from hushframe.taxonomy import label_of

    df = spark.createDataFrame([(r, p, p, s, c, v) for r, p, s, c, v in rows], "record_id string, page_no bigint, doc_id bigint, start int, category string, original string")
    return df.withColumns({"label": label_of(F.col("category")), "norm_key": normal(F.col("original"))})


def names(mapping):
    return {(r["record_id"], r["label"], r["norm_key"]): (r["pseudonym"], r["original"]) for r in mapping.collect()}


def test_numbers_follow_first_places(spark):
    m = names(P.numbered(found(spark, [("r", 1, 0, NAME, "John"), ("r", 1, 9, OTHER, "Asha"), ("r", 2, 3, OTHER, "  JOHN "), ("r", 2, 9, CITY, "Bangalore"), ("q", 5, 1, NAME, "Asha")])))
    assert m == {("r", "Person", "john"): ("Person_1", "John"), ("r", "Person", "asha"): ("Person_2", "Asha"), ("r", "City", "bangalore"): ("City_1", "Bangalore"), ("q", "Person", "asha"): ("Person_1", "Asha")}


def test_numbers_over_page_ranges(spark):
    rows = [("r", page, i, NAME, f"n{page}-{i}") for page in (1, 1023, 1024, 5000) for i in range(3)]
    m = names(P.numbered(found(spark, rows)))
    assert [m["r", "Person", v.casefold()][0] for *_, v in rows] == [f"Person_{i + 1}" for i in range(12)]


def test_texts_and_threads(spark):
    docs = docs_of(spark, "John met Asha. John left.", "Asha and John", "Patient: Mr. John Doe here").selectExpr("doc_id", "text", "doc_id div 3 as record")
    spans = spans_of(spark, docs.select("doc_id", "text"), [(1, NAME, 0, 4), (1, NAME, 9, 13), (1, NAME, 15, 19), (2, NAME, 0, 4), (2, OTHER, 9, 13), (3, NAME, 9, 17), (3, NAME, 18, 21)])
    out, mapping = P.deidentify(docs, spans, record="record")
    assert texts(out) == {1: "Person_1 met Person_2. Person_1 left.", 2: "Person_2 and Person_1", 3: "Patient: Person_1 here"}
    assert mapping.count() == 3 and set(out.columns) == set(docs.columns)
    hashed, by_token = P.deidentify(docs, spans, strategy="hash", record="record")
    assert texts(hashed)[3] == "Patient: Person_539681 here" and ("1", "Person", "mr. john doe") in names(by_token)
    with pytest.raises(ValueError, match="vault"):
        P.deidentify(docs, spans.limit(0), strategy="vault")
    assert texts(P.anonymize(docs, spans))[3] == "Patient: [PERSON] here"


def test_prior_mapping_goes_on(spark):
    first = P.numbered(found(spark, [("r", 1, 0, NAME, "John"), ("r", 1, 5, NAME, "Asha")]))
    counters = P.counters_of(first)
    stored = P.exported(first, counters)
    body = json.loads(stored.first()["mapping"])
    assert body == {"entries": {"Person": {"Person_1": "John", "Person_2": "Asha"}}, "counters": {"Person": 2}}
    back, counts = P.imported(stored)
    more = [("r", 2, 0, NAME, "asha"), ("r", 2, 4, NAME, "Ravi")]
    got = names(P.numbered(found(spark, more), back, counts))
    assert got["r", "Person", "ravi"][0] == "Person_3" and got["r", "Person", "asha"] == ("Person_2", "Asha") and len(got) == 3
    # without counters, numbers go on after the stored ones; with greater counters, after those
    assert names(P.numbered(found(spark, more), back))["r", "Person", "ravi"][0] == "Person_3"
    high = spark.createDataFrame([("r", "Person", 7)], P.COUNTERS)
    assert names(P.numbered(found(spark, more), back, high))["r", "Person", "ravi"][0] == "Person_8"
    nothing = spark.createDataFrame([("r", None)], "record_id string, mapping string")
    assert P.imported(nothing)[0].count() == 0


def test_tokens_are_recorded_once(spark):
    m = P.hashed(found(spark, [("r", 1, 0, NAME, "John Doe"), ("r", 1, 20, NAME, "john  doe")]))
    assert names(m) == {("r", "Person", "john doe"): (m.first()["pseudonym"], "John Doe")}
    kept = P.hashed(found(spark, [("r", 2, 0, NAME, "John Doe")]), spark.createDataFrame([("r", "Person", "john doe", "Person_1", "John Doe")], P.MAPPING))
    assert names(kept)["r", "Person", "john doe"][0] == "Person_1" and kept.count() == 1
    same = spark.createDataFrame([("r", "Person", "a", "Person_1", "a"), ("r", "Person", "b", "Person_1", "b")], P.MAPPING)
    assert [tuple(r) for r in P.collisions(same).collect()] == [("Person", "Person_1", 2)]
    assert P.relinked(same.select("record_id", "pseudonym").limit(1), same).count() == 2
