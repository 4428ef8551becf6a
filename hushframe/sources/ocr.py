"""Words of pages with boxes: from the caller, or from an engine's function."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.boxes import box, to_pixels
from hushframe.sources.models import once_a_worker

WORDS = "page_id bigint, word_idx int, word string, box struct<x0:int,y0:int,x1:int,y1:int>"


def check_lists(words: list | None, boxes: list | None) -> None:
    """ValueError unless both lists or neither are given, of one length, with boxes of 4 in order."""
    if (words is None) != (boxes is None):
        raise ValueError("pass BOTH words and boxes, or neither")
    if words is None:
        return
    if len(words) != len(boxes):
        raise ValueError(f"words and boxes must have the same length: {len(words)} and {len(boxes)}")
    for i, b in enumerate(boxes):
        if len(b) != 4:
            raise ValueError(f"boxes[{i}] must have 4 coordinates, it has {len(b)}")
        if b[0] > b[2] or b[1] > b[3]:
            raise ValueError(f"boxes[{i}] is inverted: {list(b)}")


def fault(b) -> F.Column:
    """What is wrong with an array box, or null."""
    return F.when(b.isNull() | (F.size(b) != 4), "must have 4 coordinates").when((b[0] > b[2]) | (b[1] > b[3]), "is inverted")


def own_words(words: DataFrame) -> DataFrame:
    """words (page_id, word_idx, word, box array of 4 numbers) as a words table: boxes cut to whole numbers, else untouched.

    A box that isn't one raises with its place when its row is read.
    """
    wrong = F.coalesce(F.assert_true(fault(F.col("box")).isNull(), F.concat(F.lit("boxes["), F.col("word_idx").cast("string"), F.lit("] "), F.coalesce(fault(F.col("box")), F.lit("")))), F.lit(True))
    whole = box(*[F.col("box")[i] for i in range(4)])
    return words.where(wrong).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("word_idx").cast("int").alias("word_idx"), "word", whole.alias("box"))


def rejects(words: DataFrame) -> DataFrame:
    """(page_id, word_idx, reason) for boxes that `own_words` would raise on."""
    return words.select("page_id", "word_idx", fault(F.col("box")).alias("reason")).where("reason is not null")


def adapted(predictions: DataFrame) -> DataFrame:
    """Another engine's predictions (page_id, word_idx, text, left, right, upper, lower, width, height) as own words.

    Rows without text are left out; coordinates up to 1.5 are shares of the page; corners come in any order; numbers
    are rounded to the even whole.
    """
    rows = predictions.where(F.coalesce("text", F.lit("")) != "")
    share = F.greatest("left", "right", "upper", "lower") <= 1.5
    across, down = F.when(share, F.col("width")).otherwise(1), F.when(share, F.col("height")).otherwise(1)
    xs, ys = [F.rint(F.col(c) * across) for c in ("left", "right")], [F.rint(F.col(c) * down) for c in ("upper", "lower")]
    b = box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    return rows.select("page_id", "word_idx", F.col("text").alias("word"), b.alias("box"))


def engine_words(pages: DataFrame, make: Callable[[], Callable[[bytes], Iterable[tuple[str, tuple]]]]) -> DataFrame:
    """Words that an OCR engine reads from pages (page_id, width, height, content).

    make() builds the engine once a Python worker; it gives (word, box in thousandths) for an image's bytes. Boxes
    come back in pixels.
    """

    built = once_a_worker(make)

    def run(frames):
        read = built()
        for pdf in frames:
            rows = [
                (page, i, word, dict(zip(("x0", "y0", "x1", "y1"), map(int, b))), w, h)
                for page, data, w, h in zip(pdf["page_id"], pdf["content"], pdf["width"], pdf["height"])
                for i, (word, b) in enumerate(read(bytes(data)))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "word_idx", "word", "box", "width", "height"])

    raw = pages.select("page_id", "content", "width", "height").mapInPandas(run, f"{WORDS}, width int, height int")
    return raw.withColumn("box", to_pixels(F.col("box"), F.col("width"), F.col("height"))).drop("width", "height")
