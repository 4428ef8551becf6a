"""Column functions on text that follow Python's rules for characters, with no Python at run time."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.taxonomy import label_of

#: What counts as white space: Java's Unicode class and the four separators that it leaves out.
SPACE = r"[\s\x1c-\x1f]"
FAR = 2**31 - 1
#: Characters of a piece of a text.
CELL_BITS = 6
CELL = 1 << CELL_BITS


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in characters."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is worked out once: the end of a fold over nothing, which copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


def cells(text: Column) -> Column:
    """The text in pieces of CELL characters and an empty one, for `cut_cells`: a place in a text is found by walking from its beginning.

    Larger pieces are taken first, so that the walks stay short.
    """

    def pieces(t: Column, size: int) -> Column:
        last = F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * size + 1, F.lit(size)))

    def parts(t: Column, sizes: tuple[int, ...]) -> Column:
        if len(sizes) == 1:
            return pieces(t, sizes[0])
        return F.flatten(F.transform(pieces(t, sizes[0]), lambda p: parts(p, sizes[1:])))

    return F.concat(let(text, lambda t: parts(t, (CELL << 8, CELL << 4, CELL))), F.array(F.lit("")))


def cut_cells(text: Column, pieces: Column, start: Column, end: Column) -> Column:
    """As `cut`, of a text whose `cells` are there: time grows with what is cut, not with where it is."""
    first, last = F.shiftright(start, CELL_BITS), F.shiftright(end - 1, CELL_BITS)
    at, size = start.bitwiseAND(F.lit(CELL - 1)) + 1, end - start
    one = F.substring(F.get(pieces, F.least(first, F.size(pieces) - 1)), at, size)
    more = F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), at, size)
    return F.when(start < 0, cut(text, start, end)).when(end <= start, F.substring(text, 1, 0)).when(first == last, one).otherwise(more)


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is there; also for the empty text."""
    return text.rlike(rf"^(?U){SPACE}*$")


def lead(text: Column) -> Column:
    """The number of white space characters at the beginning."""
    return F.length(F.regexp_extract(text, rf"^(?U){SPACE}*", 0))


def trail(text: Column) -> Column:
    """The number of white space characters at the end."""
    return F.length(F.regexp_extract(text, rf"(?U){SPACE}*$", 0))


@cache
def _digits() -> tuple[str, str]:
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose folded form is one other character, those forms, and longer forms by character."""
    one, more = {}, {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if (f := c.casefold()) != c and not 0xD800 <= ord(c) < 0xE000:
            (one if len(f) == 1 else more)[c] = f
    return "".join(one), "".join(one.values()), more


def casefold(text: Column) -> Column:
    """Full case folding, character by character as Unicode has it."""
    old, new, more = _folds()
    table = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    long = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.translate(F.when(text.rlike("[" + "".join(more) + "]"), long).otherwise(text), old, new)


def normal(text: Column) -> Column:
    """The form by which two spellings are one value: white space runs as one space, none around, case folded."""
    return casefold(F.regexp_replace(F.regexp_replace(text, rf"(?U){SPACE}+", " "), "^ | $", ""))


def token(category: Column, value: Column, secret: str | None = None, digits: int = 6) -> Column:
    """Label_xxxxxx: the first hex digits of the MD5 of the normal form after the secret. More digits clash less."""
    return F.concat(label_of(category), F.lit("_"), F.substring(F.md5(F.concat(F.lit(secret or ""), normal(value)).cast("binary")), 1, digits))


def first_number(text: Column) -> Column:
    """The first run of decimal digits of any script, as ASCII digits without leading zeros; empty if there is none."""
    run = F.translate(F.regexp_extract(text, r"(?U)\d+", 0), *_digits())
    return F.when(run == "", "").otherwise(F.regexp_replace(run, "^0+(?=.)", ""))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def hex_colour(text: Column) -> Column:
    """array(red, green, blue) of rrggbb, with or without #."""
    plain = F.regexp_replace(text, "^#", "")
    return F.array(*[F.conv(F.substring(plain, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def colour_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (red, green, blue)])


def listed(text: Column) -> Column:
    """The parts of a comma-separated list, empty ones left out; null stays null, which stands for all."""
    return F.filter(F.split(text, ",", -1), lambda x: x != "")
