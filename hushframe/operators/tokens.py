"""From labelled tokens and words to spans and entities.

Token tables have doc_id, chunk_idx, tok_idx, char_start, char_end, label and score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.exact import round4
from hushframe.functions.text import cut, lead, trail
from hushframe.taxonomy import group_of


def chunked(tokens: DataFrame, most: int = 512, overlap: int = 128, special: int = 2) -> DataFrame:
    """tokens (doc_id, tok_idx, ...) with chunk_idx: windows of `most` less the special tokens, each repeating the last `overlap`.

    A token is in one chunk, or in several where they overlap; every text's last chunk ends with its last token.
    """
    room = most - special
    step = room - overlap
    if step <= 0:
        raise ValueError("the overlap leaves no room")
    # the first chunk that reaches a token, and the last that begins at or before it and is needed at all
    count = F.max("tok_idx").over(Window.partitionBy("doc_id")) + 1
    last_chunk = F.greatest(F.lit(0), F.ceil((count - room) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("tok_idx") - room + 1) / step))
    last = F.least(F.floor(F.col("tok_idx") / step), last_chunk)
    rows = tokens.withColumn("__last", last.cast("int"))
    return rows.withColumn("chunk_idx", F.explode(F.sequence(first.cast("int"), "__last"))).drop("__last")


def best_label(logits: DataFrame, names: list[str]) -> DataFrame:
    """logits (…, logits array) with label, the first greatest, and score, its share of the exponentials."""
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    label = F.element_at(F.array(*map(F.lit, names)), F.array_position("logits", top).cast("int"))
    return logits.withColumns({"label": label, "score": F.lit(1.0) / total}).drop("logits")


def flattened(tokens: DataFrame) -> DataFrame:
    """One token for each range of characters, that of the first chunk; tokens without characters are left out."""
    first = F.min_by(F.struct("label", "score"), F.struct("chunk_idx", "tok_idx")).alias("t")
    return tokens.where("char_end > char_start").groupBy("doc_id", "char_start", "char_end").agg(first).select("doc_id", "char_start", "char_end", "t.label", "t.score")


def decoded(docs: DataFrame, tokens: DataFrame, rounded: bool = True) -> DataFrame:
    """Spans of texts from B-, I- and O labels.

    A span begins at a B label, where none is open, and where the category changes; other labels but O extend it. White
    space at its ends is cut off, and a span of nothing else is dropped. The score is the mean of the tokens' that
    have one, to 4 places.
    """
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    category = F.lower(F.substring("label", 3, 2**31 - 1))
    rows = flattened(tokens).withColumns({"out": F.col("label") == "O", "category": category})
    before = rows.withColumns({"was_out": F.lag("out", 1, True).over(order), "was": F.lag("category").over(order)})
    begins = ~F.col("out") & (F.col("label").startswith("B") | F.col("was_out") | (F.col("was") != F.col("category")))
    marked = before.withColumn("island", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("out"))
    spans = marked.groupBy("doc_id", "island").agg(F.first("category").alias("category"), F.min("char_start").alias("a"), F.max("char_end").alias("b"), F.avg("score").alias("score"))
    # a text per span would repeat it: the spans of a text travel together
    packed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "category", "score"))).alias("spans"))
    met = docs.select("doc_id", F.col("text").alias("whole")).join(packed.hint("shuffle_hash"), "doc_id").where(F.length("whole") > 0)
    raw = F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["category"].alias("category"), s["score"].alias("score"), cut(F.col("whole"), s["a"], s["b"]).alias("raw")))
    out = met.select("doc_id", F.explode(raw).alias("s"))
    start = F.col("s.a") + lead(F.col("s.raw"))
    end = F.col("s.a") + F.length("s.raw") - trail(F.col("s.raw"))
    out = out.select("doc_id", "s.category", start.alias("start"), end.alias("end"), "s.raw", "s.a", "s.score").where("end > start")
    out = out.withColumns({"text": F.substring(F.col("raw"), F.col("start") - F.col("a") + 1, F.col("end") - F.col("start")), "l1": group_of(F.col("category"))})
    if rounded:
        out = out.withColumn("score", round4("score"))
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1).cast("int")
    return out.select("doc_id", idx.alias("span_idx"), "category", "start", "end", "l1", "text", "score")


def word_labels(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """words (page_id, word_idx, ...) with label and score of their first piece (chunk_idx, tok_idx); O where there is none."""
    first = pieces.where("word_idx is not null").groupBy("page_id", "word_idx").agg(F.min_by(F.struct("label", "score"), F.struct("chunk_idx", "tok_idx")).alias("p"))
    both = words.join(first, ["page_id", "word_idx"], "left")
    return both.withColumns({"label": F.coalesce("p.label", F.lit("O")), "score": F.col("p.score")}).drop("p")


def word_entities(labelled: DataFrame, rounded: bool = True) -> DataFrame:
    """One text entity for each word (page_id, word_idx, word, box, label, score) whose label isn't O; B- and I- are cut off."""
    rows = labelled.where("label <> 'O'").withColumn("category", F.regexp_replace("label", "^[BI]-", ""))
    score = round4("score") if rounded else F.col("score")
    return rows.select(
        "page_id", F.col("word_idx").alias("ent_idx"), "category", F.lit("text").alias("kind"), "box", group_of(F.col("category")).alias("l1"),
        F.col("word").alias("text"), score.alias("score"),
    ).withColumnRenamed("box", "bbox")
