"""Rows that share an id and a source but not a text."""

from hushframe.llm import mixing


def test_rows_of_one_id_and_of_none_enter_once(spark):
    rows = [(i, "a b " * (n + 1), "s") for i in (None, 1) for n in range(6)] + [(i, "w " * (i % 7 + 1), "t") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["source"], r["size"]) for r in mixed) == sorted((i or 0, s, len(t.split())) for i, t, s in rows)
