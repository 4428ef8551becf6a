"""Tables with columns that the transforms use names of themselves."""

from hushframe.operators import pseudonyms, spans
from hushframe.sources.rules import rule_spans
from hushframe.streaming import deid

ROWS = [(1, "r", "mail a.b@x.example.com", 1, 2, 3), (2, "r", "none", 4, 5, 6), (3, "q", None, 7, 8, 9)]


def test_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, record string, text string, spans int, names int, _Spans int")
    found = rule_spans(docs)
    for out, said in (
        (spans.redact(docs, found), "[REDACTED]"), (spans.apply_mask(docs, found, "#"), "#"), (deid.redacted(docs), "[REDACTED]"),
        (pseudonyms.deidentify(docs, found, record="record")[0], "Email_1"), (pseudonyms.anonymize(docs, found), "[EMAIL]"),
    ):
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == [(1, "r", f"mail {said}", 1, 2, 3), ROWS[1], ROWS[2]]
