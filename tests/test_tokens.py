from hushframe.operators import tokens as T
from tests.helpers import docs_of

TOKENS = "doc_id bigint, chunk_idx int, tok_idx int, char_start int, char_end int, label string, score double"


def spans(spark, text, toks):
    rows = [(1, c, i, *t) for c, chunk in enumerate(toks) for i, t in enumerate(chunk)]
    return [(r["category"], r["start"], r["end"], r["l1"], r["score"]) for r in T.decoded(docs_of(spark, text), spark.createDataFrame(rows, TOKENS)).orderBy("start").collect()]


def test_begin_and_inside(spark):
    toks = [(0, 5, "O", 0.9), (5, 10, "B-EMAIL", 0.8), (10, 12, "I-EMAIL", 0.7), (12, 16, "I-EMAIL", 0.6), (16, 20, "O", 0.95)]
    assert spans(spark, "Email john@x.com now", [toks]) == [("email", 6, 16, "contact", 0.7)]


def test_neighbours_specials_and_strays(spark):
    assert [x[:3] for x in spans(spark, "Asha Bob", [[(0, 4, "B-PRIMARY_SUBJECT_NAME", 0.9), (4, 8, "B-OTHER_PERSON_NAME", 0.9)]])] == [("primary_subject_name", 0, 4), ("other_person_name", 5, 8)]
    assert [x[:3] for x in spans(spark, "hi name", [[(0, 0, "O", 1.0), (0, 2, "O", 1.0), (2, 7, "B-OTHER_PERSON_NAME", 1.0), (0, 0, "O", 1.0)]])] == [("other_person_name", 3, 7)]
    assert [x[:3] for x in spans(spark, "ab cd", [[(0, 2, "I-AGE", 0.5), (2, 5, "X-AGE", None)]])] == [("age", 0, 5)]
    assert spans(spark, "a   b", [[(1, 4, "B-AGE", 0.5)]]) == []


def test_first_chunk_wins(spark):
    chunks = [[(0, 3, "B-AGE", 0.9), (3, 6, "I-AGE", 0.8), (6, 6, "B-AGE", 0.1)], [(3, 6, "B-GENDER", 0.5), (6, 9, "B-COUNTRY", 0.7)]]
    rows = [(1, c, i, *t) for c, chunk in enumerate(chunks) for i, t in enumerate(chunk)]
    got = T.flattened(spark.createDataFrame(rows, TOKENS)).orderBy("char_start").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 3, "B-AGE", 0.9), (3, 6, "I-AGE", 0.8), (6, 9, "B-COUNTRY", 0.7)]


def test_chunks_cover_all(spark):
    toks = spark.range(25).selectExpr("1L as doc_id", "cast(id as int) tok_idx")
    got = {}
    for r in T.chunked(toks, most=12, overlap=4).collect():
        got.setdefault(r["chunk_idx"], []).append(r["tok_idx"])
    assert {c: (min(v), max(v)) for c, v in got.items()} == {0: (0, 9), 1: (6, 15), 2: (12, 21), 3: (18, 24)}


def test_argmax(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0],)], "logits array<double>")
    r = T.best_label(df, ["O", "A", "B"]).first()
    assert r["label"] == "A" and abs(r["score"] - 0.46831) < 1e-4


def test_words(spark):
    words = spark.createDataFrame([(1, 0, "Asha"), (1, 1, "and"), (1, 2, "Bob")], "page_id bigint, word_idx int, word string")
    pieces = spark.createDataFrame([(1, 1, 0, 0, "I-x", 0.1), (1, 0, 1, 0, "B-name", 0.91239), (1, 0, 0, None, "O", 1.0), (1, 0, 2, 1, "O", 0.9)], "page_id bigint, chunk_idx int, tok_idx int, word_idx int, label string, score double")
    got = T.word_labels(words, pieces).orderBy("word_idx").collect()
    assert [(r["label"], r["score"]) for r in got] == [("B-name", 0.91239), ("O", 0.9), ("O", None)]
    from pyspark.sql import functions as F

    e = T.word_entities(T.word_labels(words, pieces).withColumn("box", F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"))).collect()
    assert [(r["category"], r["text"], r["score"], r["kind"]) for r in e] == [("name", "Asha", 0.9124, "text")]
