"""The batch job, names for SQL, and what a worker keeps."""

import os

import pytest

from hushframe import job
from hushframe.functions import sql
from hushframe.functions.generalize import generalized
from hushframe.functions.text import token
from hushframe.operators import pseudonyms, spans as sp
from hushframe.sources import models
from hushframe.sources.rules import rule_spans
from pyspark.sql import functions as F
from tests.helpers import docs_of, texts

MAILS = ("write to a.b@c.org or 10.0.0.1", "nothing", None, "", "A.B@C.org, again a.b@c.org; x@y.net")


@pytest.fixture
def place(spark, tmp_path):
    docs = docs_of(spark, *MAILS)
    docs.write.parquet(f"{tmp_path}/in")
    return docs, str(tmp_path)


def test_tasks_write_what_the_operators_give(spark, place, capsys):
    docs, folder = place
    found = rule_spans(docs)
    job.main(["detect", "--input", f"{folder}/in", "--output", f"{folder}/spans", "--output-format", "json"])
    assert spark.read.json(f"{folder}/spans").count() == found.count() == 5
    assert "email" in capsys.readouterr().out
    job.main(["redact", "--input", f"{folder}/in", "--output", f"{folder}/masked", "--mask", "[{category}]", "--categories", "email"])
    assert texts(spark.read.parquet(f"{folder}/masked")) == texts(sp.redact(docs, found.where("category = 'email'"), "[{category}]"))
    job.main(["anonymize", "--input", f"{folder}/in", "--output", f"{folder}/coarse"])
    assert texts(spark.read.parquet(f"{folder}/coarse")) == texts(pseudonyms.anonymize(docs, found))


def test_pseudonyms_go_on_from_a_stored_mapping(spark, place):
    docs, folder = place
    names = ["deidentify", "--input", f"{folder}/in", "--mapping-output"]
    job.main([*names, f"{folder}/map", "--output", f"{folder}/one"])
    job.main([*names, f"{folder}/more", "--output", f"{folder}/two", "--mapping", f"{folder}/map"])
    one, two = (texts(spark.read.parquet(f"{folder}/{n}")) for n in ("one", "two"))
    assert one == two and one[5] == "Email_1, again Email_1; Email_2"
    assert spark.read.parquet(f"{folder}/more").count() == spark.read.parquet(f"{folder}/map").count() == 4


def test_settings_count_where_flags_are_missing(spark):
    spark.conf.set("spark.hushframe.mask", "<{l1}>")
    try:
        assert job.options(spark, ["redact", "--input", "a", "--output", "b"]).mask == "<{l1}>"
        assert job.options(spark, ["redact", "--input", "a", "--output", "b", "--mask", "x"]).mask == "x"
    finally:
        spark.conf.unset("spark.hushframe.mask")
    for wrong in (["redact"], ["deidentify", "--input", "a", "--output", "b"], ["guess", "--input", "a", "--output", "b"]):
        with pytest.raises(SystemExit):
            job.options(spark, wrong)
    with pytest.raises(ValueError, match="nonsense"):
        job.options(spark, ["redact", "--input", "a", "--output", "b", "--categories", "email,nonsense"])


def test_names_for_sql(spark):
    sql.register(spark)
    docs = docs_of(spark, *MAILS)
    docs.createOrReplaceTempView("mails")
    got = spark.sql("SELECT doc_id, s.* FROM mails, LATERAL pii_spans(text) s")
    want = rule_spans(docs).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    values = [("age", "42 years"), ("date_of_birth", "born 3 May 1987"), ("city_district", "Oslo"), ("country", "Norway"), ("email", "Straße  X "), ("made_up_kind", "v"), ("age", None)]
    rows = spark.createDataFrame(values, "category string, value string")
    rows.createOrReplaceTempView("kinds")
    c, v = F.col("category"), F.col("value")
    assert spark.sql("SELECT pii_generalize(category, value) a, pii_token(category, value) b FROM kinds").collect() == rows.select(generalized(c, v).alias("a"), token(c, v).alias("b")).collect()
    assert spark.sql("SELECT pii_group('email') g").first()["g"] == "contact"


def test_a_worker_builds_once_and_models_come_from_folders(tmp_path):
    built = []

    def make():
        return len(os.listdir("/"))

    get, again = models.once_a_worker(make), models.once_a_worker(make)
    models._BUILT.clear()
    built = [get(), again()]
    assert len(models._BUILT) == 1 and built[0] == built[1]
    (tmp_path / "m" / "text").mkdir(parents=True)
    assert models.located(f"{tmp_path}/m") == f"{tmp_path}/m"
    assert models.located(f"{tmp_path}/m", "text") == f"{tmp_path}/m/text"
    assert models.located(f"{tmp_path}/m", "visual") == f"{tmp_path}/m"
    with pytest.raises(FileNotFoundError):
        models.located(f"{tmp_path}/none")
