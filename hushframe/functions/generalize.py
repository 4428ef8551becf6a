"""One-way generalisation of values by category."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.text import first_number
from hushframe.taxonomy import LABELS, upper_label_of

# What each kind of category becomes.
KEPT = ("country", "state_province")
DATES = ("date_of_birth", "death_date", "other_date_time")
PLACES = ("city_district", "street_address", "postal_zip_pin_code", "geocode_coordinates")
DASH = "–"


def generalized(category: Column, value: Column) -> Column:
    """Coarse places as they are, ages as their decade, dates as their year, fine places and all else as a mark."""
    number = first_number(value)
    tens = F.regexp_replace(number, ".$", "")
    decade = F.concat(tens, F.lit("0" + DASH), tens, F.lit("9"))
    year = F.regexp_extract(value, r"(?U)\b(19|20)\d{2}\b", 0)
    return (
        F.when(category.isin(*KEPT), value)
        .when(category == "age", F.when(number == "", "[AGE]").otherwise(decade))
        .when(category.isin(*DATES), F.when(year == "", "[DATE]").otherwise(year))
        .when(category.isin(*PLACES), "[LOCATION]")
        .otherwise(F.concat(F.lit("["), upper_label_of(category), F.lit("]")))
    )


def _in_word(c: str) -> bool:
    """Whether a character is one of a word by Java's Unicode classes."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9"


def _decade(value: str) -> str:
    if not (run := re.search(r"\d+", value)):
        return "[AGE]"
    tens = ("".join(str(unicodedata.digit(c)) for c in run[0]).lstrip("0") or "0")[:-1]
    return f"{tens}0{DASH}{tens}9"


def _year(value: str) -> str:
    for m in re.finditer(r"(?=((?:19|20)\d\d))", value):
        before, after = value[: m.start(1)][-1:], value[m.end(1) :][:1]
        if not (before and _in_word(before)) and not (after and _in_word(after)):
            return m[1]
    return "[DATE]"


def general_of(category: str, l1: str = "") -> str | tuple[str, Callable[[str], str]] | None:
    """`generalized` of a plain category: what all its values become, None if they stay, or what those without a digit become and the function for any."""
    if category in KEPT:
        return None
    if category == "age":
        return "[AGE]", _decade
    if category in DATES:
        return "[DATE]", _year
    return "[LOCATION]" if category in PLACES else f"[{LABELS.get(category, category.replace('_', '')).upper()}]"
