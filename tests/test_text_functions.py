import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hushframe import taxonomy
from hushframe.functions import text as T
from hushframe.functions.generalize import generalized
from tests.helpers import one

GOLDEN = [
    ("primary_subject_name", "Mr. John Doe", "Person_539681", "[PERSON]"), ("age", "45", "Age_6c8349", "40–49"), ("date_of_birth", "12-03-1979", "Date_7f19c4", "1979"),
    ("city_district", "Indiranagar", "City_d12704", "[LOCATION]"), ("city_district", "Bangalore", "City_60c7d5", "[LOCATION]"), ("phone_mobile", "+91 98765 43210", "Phone_d57003", "[PHONE]"),
]


def test_categories(spark):
    rows = taxonomy.taxonomy(spark).collect()
    assert len(rows) == 54 and sum(r["kind"] == "text" for r in rows) == 48
    sizes = {}
    for r in rows:
        sizes[r["l1"]] = sizes.get(r["l1"], 0) + 1
    assert sizes == {"person": 8, "location": 6, "date_time": 3, "contact": 4, "uid": 20, "device_net": 3, "credential": 3, "entity": 1, "biometric_visual": 6}
    assert len({r["label"] for r in rows if r["kind"] == "text"}) == 45
    assert [r["category"] for r in rows][:2] == ["primary_subject_name", "other_person_name"]


def test_checked_categories():
    assert taxonomy.checked(None) is None
    assert taxonomy.checked([]) == [] and taxonomy.checked(["logo", "email"]) == ["logo", "email"]
    with pytest.raises(ValueError, match="nope"):
        taxonomy.checked(["nope"])


def test_labels_and_groups(spark):
    c = spark.createDataFrame([("email",), ("logo",), ("not_a_real_category",)], "c string")
    got = {r["c"]: (r["l"], r["g"]) for r in c.select("c", taxonomy.label_of(F.col("c")).alias("l"), taxonomy.group_of(F.col("c")).alias("g")).collect()}
    assert got == {"email": ("Email", "contact"), "logo": ("Logo", "biometric_visual"), "not_a_real_category": ("NotARealCategory", "unknown")}
    assert taxonomy.plain_label("not_a_real_category") == "NotARealCategory"


@pytest.mark.parametrize("category, value, name, general", GOLDEN)
def test_golden_values(spark, category, value, name, general):
    assert one(spark, T.token(F.lit(category), F.lit(value))) == name
    assert one(spark, generalized(F.lit(category), F.lit(value))) == general


def test_tokens_follow_the_normal_form_and_the_secret(spark):
    t = lambda v, s=None: one(spark, T.token(F.lit("other_person_name"), F.lit(v), s))
    assert t("John Doe") == t("  john   DOE ") and t("John Doe", "a") == t("john doe", "a") != t("john doe")
    assert t("x", "s") == "Person_" + hashlib.md5(b"sx").hexdigest()[:6]


@pytest.mark.parametrize(
    "category, value, expected",
    [
        ("age", "45 yrs", "40–49"), ("age", "7", "0–9"), ("age", "elderly", "[AGE]"), ("age", "045", "40–49"), ("age", "45-50", "40–49"), ("age", "1979", "1970–1979"), ("age", "४५", "40–49"),
        ("age", "9" * 60, "9" * 59 + "0–" + "9" * 60), ("age", "0", "0–9"), ("date_of_birth", "02/06/2026", "2026"), ("death_date", "12th March", "[DATE]"), ("other_date_time", "21/03/79", "[DATE]"),
        ("date_of_birth", "DOB1979", "[DATE]"), ("date_of_birth", "1979_", "[DATE]"), ("state_province", "Karnataka", "Karnataka"), ("country", "India", "India"), ("street_address", "14 MG Road", "[LOCATION]"),
        ("blood_type", "O+", "[BLOODTYPE]"), ("aadhaar_12_digit", "1234 5678 9012", "[AADHAAR]"), ("something_new", "x", "[SOMETHINGNEW]"),
    ],
)
def test_generalisation(spark, category, value, expected):
    assert one(spark, generalized(F.lit(category), F.lit(value))) == expected


def test_folding_and_white_space_are_pythons(spark):
    draw = random.Random(5)
    odd = "aAßẞſﬁΣςİıéÉ𐐀Ⅷ᾿ŉΐ  \t\n\x1c\x1f　​ﬀ"
    values = ["".join(draw.choice(odd) for _ in range(draw.randrange(12))) for _ in range(400)]
    values += [chr(c) for c in range(0x300) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.normal(F.col("v")).alias("n"), T.is_blank(F.col("v")).alias("b"), T.lead(F.col("v")).alias("l"), T.trail(F.col("v")).alias("t")).collect()
    for r in rows:
        v = r["v"]
        assert r["n"] == " ".join(v.split()).casefold(), repr(v)
        assert r["b"] == (not v.strip()) and r["l"] == len(v) - len(v.lstrip()) and r["t"] == len(v) - len(v.rstrip()), repr(v)


def test_characters_not_bytes(spark):
    assert one(spark, T.cut(F.lit("a🙂bc"), F.lit(1), F.lit(3))) == "🙂b"
    assert one(spark, T.escape_html(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    assert one(spark, T.hex_colour(F.lit("#ff0a10"))) == [255, 10, 16]
    assert one(spark, T.colour_hex(F.lit(255), F.lit(10), F.lit(16))) == "#ff0a10"
    assert one(spark, T.listed(F.lit(","))) == [] and one(spark, T.listed(F.lit("a,,b"))) == ["a", "b"] and one(spark, T.listed(F.lit(None).cast("string"))) is None
