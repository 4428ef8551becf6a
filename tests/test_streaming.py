import uuid

from pyspark.sql import functions as F

from hushframe.operators import pseudonyms, spans
from hushframe.sources.rules import rule_spans
from hushframe.streaming import deid
from tests.helpers import texts

MAILS = ["mail a.b@x.example.com", "c@y.example.com and a.b@x.example.com", "none", None, "A.B@X.example.com again, 10.0.0.1"]


def stream(spark, folder, rows):
    spark.createDataFrame(rows, "record_id string, page_no bigint, doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("record_id string, page_no bigint, doc_id bigint, text string").parquet(folder)


def test_rows_as_in_batch(spark, tmp_path):
    s = stream(spark, f"{tmp_path}/in", [("r", i, i, t) for i, t in enumerate(MAILS)])
    batch = spark.read.parquet(f"{tmp_path}/in")
    found = rule_spans(batch)
    for n, (step, expected) in enumerate(((deid.redacted, spans.redact(batch, found)), (deid.anonymized, pseudonyms.anonymize(batch, found)), (deid.hashed, pseudonyms.deidentify(batch, found, "hash")[0]))):
        assert texts(deid.drained(step(s), f"t{uuid.uuid4().hex}", f"{tmp_path}/c{n}")) == texts(expected)


def test_numbers_go_on_over_batches(spark, tmp_path):
    s = stream(spark, f"{tmp_path}/in", [("r", 2, 2, MAILS[1]), ("r", 1, 1, MAILS[0]), ("q", 1, 9, MAILS[1])])

    def drained():
        out = f"{tmp_path}/out"
        query = deid.numbered(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r["doc_id"]: r["text"] for r in spark.read.parquet(out).collect()}

    assert drained() == {1: "mail Email_1", 2: "Email_2 and Email_1", 9: "Email_1 and Email_2"}
    stream(spark, f"{tmp_path}/in", [("r", 3, 3, MAILS[4]), ("r", 4, 4, None)])
    all_ = drained()
    assert len(all_) == 5 and all_[3] == "Email_1 again, IPAddress_1" and all_[4] is None


def test_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:10:00' ts, 'a' k union all select timestamp'2024-01-01 10:50:00', 'a' union all select timestamp'2024-01-01 11:00:00', 'b'").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    got = deid.drained(deid.counted(events, "k"), f"t{uuid.uuid4().hex}", f"{tmp_path}/c", "complete").select(F.hour("start"), "k", "n").collect()
    assert sorted(map(tuple, got)) == [(10, "a", 2), (11, "b", 1)]
