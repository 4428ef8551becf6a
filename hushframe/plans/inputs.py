"""Spans, tokens, words and boxes made from the driver's tables by arithmetic, for queries on tables that have none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.pixels import to_png
from hushframe.functions.text import let
from hushframe.operators.boxes import box
from hushframe.operators.spans import placed
from hushframe.taxonomy import group_of

KINDS = ("email", "age", "country")
#: Words to a line of the grid.
ACROSS = 8


def made_spans(docs: DataFrame) -> DataFrame:
    """Five short spans in every 40 characters of each text, the last ones cut at its end; they overlap, touch and repeat."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("at", "t"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    start = ((F.col("doc_id") * 7 + F.col("k") * 5) % 30).cast("int")
    size = (1 + (F.col("doc_id") + F.col("k") * 3) % 8).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("doc_id") + F.col("k")) % 3 + 1).cast("int"))
    score = F.when((F.col("doc_id") + F.col("k")) % 5 != 0, ((F.col("doc_id") * F.col("k")) % 4 + 5).cast("double") / F.lit(10.0))
    idx, first = (F.col("at") * 5 + F.col("k")).cast("int"), F.col("at") * 40
    rows = rows.where(start < F.length("t")).select("doc_id", idx.alias("span_idx"), kind.alias("category"), first.alias("first"), F.substring(F.col("t"), start + 1, size).alias("text"), start.alias("start"), score.alias("score"))
    start = F.col("first") + F.col("start")
    return rows.select("doc_id", "span_idx", "category", start.alias("start"), (start + F.length("text")).alias("end"), group_of(F.col("category")).alias("l1"), "text", "score")


def made_in_row(doc_id: Column, text: Column) -> Column:
    """The array of a text's `made_spans`, by expressions on the one row; null for the null text.

    Where the five spans lie and what they are hangs on the document alone and is worked out once; pieces of a text come in order.
    """

    def span(k: int) -> Column:
        kind = F.element_at(F.array(*map(F.lit, KINDS)), ((doc_id + k) % 3 + 1).cast("int"))
        score = F.when((doc_id + k) % 5 != 0, ((doc_id * k) % 4 + 5).cast("double") / F.lit(10.0))
        start, size = ((doc_id * 7 + k * 5) % 30).cast("int"), (1 + (doc_id + k * 3) % 8).cast("int")
        return F.struct(start.alias("start"), size.alias("size"), (start + size).alias("end"), F.lit(k).alias("k"), kind.alias("category"), group_of(kind).alias("l1"), score.alias("score"))

    def cut(five: Column, n: Column) -> Column:
        inside = F.filter(five, lambda s: s["start"] < n)
        size = lambda s: F.least(s["size"], n - s["start"])
        return F.transform(inside, lambda s: F.struct(s["start"], size(s).alias("size"), (s["start"] + size(s)).alias("end"), s["k"], s["category"], s["l1"], s["score"]))

    def piece(t: Column, at: Column, five: Column) -> Column:
        # the spans of a whole piece end within it
        inside = let(F.length(t), lambda n: F.when(n == 40, five).otherwise(cut(five, n)))
        one = lambda s, first: placed(first + s["start"], first + s["end"], at * 5 + s["k"], s["category"], s["l1"], F.substring(t, s["start"] + 1, s["size"]), s["score"])
        return let(at * 40, lambda first: F.transform(inside, lambda s: one(s, first)))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,40}"), F.lit(0))
    return let(F.sort_array(F.array(*map(span, range(5)))), lambda five: F.flatten(F.transform(pieces, lambda t, at: piece(t, at, five))))


def made_tokens(docs: DataFrame) -> DataFrame:
    """Tokens for the words of each text: labels by word length, in chunks of 20 that overlap by 5, with empty tokens between."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", " ")).alias("tok", "w"))
    rows = rows.select("doc_id", "tok", F.length("w").alias("n"))
    upto = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.sum(F.col("n") + 1).over(upto) - 1).cast("int")
    rows = rows.select("doc_id", "tok", (end - F.col("n")).alias("char_start"), end.alias("char_end"), "n")
    chunk = F.explode(F.array_distinct(F.array(F.floor(F.col("tok") / 15).cast("int"), F.greatest(F.lit(0), F.floor((F.col("tok") - 5) / 15)).cast("int")))).alias("chunk_idx")
    rows = rows.select("*", chunk)
    label = (
        F.when((F.col("n") + F.col("chunk_idx")) % 4 == 0, "O").when(F.col("n") % 7 == 1, "B-AGE").when(F.col("n") % 3 == 0, "I-AGE").when(F.col("n") % 3 == 1, "B-EMAIL").otherwise("I-EMAIL")
    )
    score = ((F.col("n") * 3 + F.col("chunk_idx")) % 8).cast("double") / F.lit(8.0)
    return rows.select("doc_id", "chunk_idx", F.col("tok").cast("int").alias("tok_idx"), "char_start", "char_end", label.alias("label"), score.alias("score"))


def page_height(text: str = "text") -> Column:
    """Pixels that the lines of a text's grid take, 200 at least."""
    return F.greatest(F.lit(200), F.ceil(F.size(F.split(text, r"[ \n]")) / ACROSS) * 20).cast("int")


def made_words(docs: DataFrame) -> DataFrame:
    """(page_id, word_idx, word, box, height): the words of each text on a grid of 8 to a line, 60 x 20 pixels a cell, and their page's height."""
    # the height first: beside the generator it would be worked out for each word
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("page_id"), "text", page_height().alias("height"))
    rows = rows.select("page_id", "height", F.posexplode(F.split("text", r"[ \n]")).alias("word_idx", "word")).where("word <> ''")
    x0 = (F.col("word_idx") % ACROSS) * 60 + F.col("page_id") % 3
    y0 = F.floor(F.col("word_idx") / ACROSS) * 20
    wide, high = F.least(F.lit(58), F.length("word") * 7), 10 + F.length("word") % 5
    return rows.select("page_id", "word_idx", "word", box(x0, y0, x0 + wide, y0 + high).alias("box"), "height")


def made_entities(docs: DataFrame) -> DataFrame:
    """Text entities for the words whose length is 3, 5 or 7, and a logo and a signature on every page."""
    words = made_words(docs)
    n = F.length("word")
    kind = F.when(n == 3, "other_person_name").when(n == 5, "city_district").when(n == 7, "phone_mobile")
    score = (n % 4).cast("double") / F.lit(4.0)
    text = words.withColumn("category", kind).where("category is not null").select("page_id", F.col("word_idx").alias("ent_idx"), "category", F.lit("text").alias("kind"), F.col("box").alias("bbox"), F.col("word").alias("text"), score.alias("score"))
    seen = docs.select(F.col("doc_id").alias("page_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ent_idx"))
    area = F.when(F.col("ent_idx") == 0, box(F.lit(100), F.lit(30), F.lit(260), F.lit(90))).otherwise(box(F.lit(300), F.lit(0), F.lit(420), F.lit(45)))
    visual = seen.select("page_id", "ent_idx", F.when(F.col("ent_idx") == 0, "logo").otherwise("signature").alias("category"), F.lit("visual").alias("kind"), area.alias("bbox"), F.lit(None).cast("string").alias("text"), F.lit(0.5).alias("score"))
    return text.unionByName(visual).withColumn("l1", group_of(F.col("category")))


#: Pixels of a made picture.
PICTURE = (96, 64)


def pattern(page: int) -> np.ndarray:
    """A picture of slopes that no two pages in a row share."""
    wide, high = PICTURE
    y, x, c = np.ogrid[:high, :wide, :3]
    return ((x * 3 + y * 5 + c * 40 + page * 7) % 256).astype(np.uint8)


def made_images(parts: DataFrame) -> DataFrame:
    """(page_id, record_id, page_no, width, height, content): a PNG for each part."""

    @F.pandas_udf("binary")
    def png(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: to_png(pattern(int(k))))

    key, (wide, high) = F.col("p_partkey"), PICTURE
    return parts.select(key.alias("page_id"), F.col("p_brand").alias("record_id"), key.alias("page_no"), F.lit(wide).alias("width"), F.lit(high).alias("height"), png(key).alias("content"))


def made_print(parts: DataFrame) -> DataFrame:
    """Entities on `made_images`: the words of each part's name, three to a line, and a logo that one may lie in."""
    words = parts.select(F.col("p_partkey").alias("page_id"), F.posexplode(F.split("p_name", " ")).alias("ent_idx", "text"))
    i, x0 = F.col("ent_idx"), 4 + F.col("ent_idx") % 3 * 30
    y0, kinds = 6 + F.floor(F.col("ent_idx") / 3) * 20, F.array(*map(F.lit, ("other_person_name", "city_district", "age")))
    text = words.select("page_id", "ent_idx", F.element_at(kinds, ((F.col("page_id") + i) % 3 + 1).cast("int")).alias("category"), F.lit("text").alias("kind"),
        box(x0, y0, x0 + F.least(F.lit(28), F.length("text") * 4), y0 + 10).alias("bbox"), "text")
    logo = parts.select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("ent_idx"), F.lit("logo").alias("category"), F.lit("visual").alias("kind"),
        box(F.lit(60), F.lit(22), F.lit(94), F.lit(60)).alias("bbox"), F.lit(None).cast("string").alias("text"))
    return text.unionByName(logo).withColumn("score", F.lit(0.5)).withColumn("l1", group_of(F.col("category")))


def made_pages(docs: DataFrame) -> DataFrame:
    """(page_id, record_id, page_no, width, height), high enough for the words of `made_words`."""
    return docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("record_id"), F.col("doc_id").alias("page_no"), F.lit(480).alias("width"), F.coalesce(page_height(), F.lit(200)).alias("height"))
