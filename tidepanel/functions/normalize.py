"""Lookup keys: accent folding, upper-casing and separator collapsing without a UDF.

Spark has no built-in for compatibility decomposition (NFKD), so the folding is generated from Python's
``unicodedata`` once: characters that decompose to a single base character go through one
``translate``; those that decompose to several are looked up by their place in a string of all of them, and
Hangul syllables are composed from their three parts by arithmetic; combining marks left over are removed by a
generated character class. Plain ASCII text skips all of it, and only texts that have a character that expands
are taken apart.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = range(0xAC00, 0xD7A4)
SURROGATES = range(0xD800, 0xE000)
SEPARATOR = "\x01"


def _folded(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _char_class(points: Iterable[int]) -> str:
    ranges: list[list[int]] = []
    for point in sorted(points):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """``(from, to, expansions, mark class)`` for the folding expression, derived from unicodedata."""
    singles: list[tuple[str, str]] = []
    expansions: list[tuple[str, str]] = []
    marks = []
    for point in range(0x80, sys.maxunicode + 1):
        if point in HANGUL or point in SURROGATES:
            continue
        char = chr(point)
        folded = _folded(char)
        if unicodedata.combining(char):
            marks.append(point)
        elif folded != char:
            (singles if len(folded) == 1 else expansions).append((char, folded))
    sources = "".join(source for source, _ in singles)
    targets = "".join(target for _, target in singles)
    return sources, targets, tuple(expansions), _char_class(marks)


def _hangul(point: Column) -> Column:
    """The two or three parts of a Hangul syllable."""
    place = point - HANGUL.start
    first, second, third = (
        F.split(F.lit(SEPARATOR.join(chr(start + i) for i in range(count))), SEPARATOR)
        for start, count in ((0x1100, 19), (0x1161, 21), (0x11A7, 28))
    )
    last = (place % 28).cast("int")
    return F.concat(
        F.element_at(first, F.floor(place / 588).cast("int") + 1),
        F.element_at(second, F.floor((place % 588) / 28).cast("int") + 1),
        F.when(last > 0, F.element_at(third, last + 1)).otherwise(""),
    )


def _expanded(value: Column, expansions: tuple[tuple[str, str], ...]) -> Column:
    sources = "".join(char for char, _ in expansions)
    targets = F.split(F.lit(SEPARATOR.join(folded for _, folded in expansions)), SEPARATOR)

    def one(char: Column) -> Column:
        point, place = F.ascii(char), F.position(char, F.lit(sources))
        return (
            F.when(point.between(HANGUL.start, HANGUL.stop - 1), _hangul(point))
            .when(place > 0, F.element_at(targets, place))
            .otherwise(char)
        )

    chars = F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1))
    able = _char_class([*map(ord, sources), *HANGUL])
    return F.when(F.rlike(value, F.lit(able)), F.array_join(F.transform(chars, one), "")).otherwise(value)


def fold_marks(value: Column) -> Column:
    """Compatibility-decompose and drop combining marks: ``Türkiye`` -> ``Turkiye``."""
    sources, targets, expansions, marks = fold_tables()
    folded = F.regexp_replace(_expanded(F.translate(value, sources, targets), expansions), marks, "")
    return F.when(F.rlike(value, F.lit(r"^\p{ASCII}*$")), value).otherwise(folded)


def _key(value: Column, separators: str) -> Column:
    return F.trim(F.regexp_replace(F.upper(fold_marks(value)), _java(separators), " "))


def _java(separators: str) -> str:
    """The pattern with Python's idea of white space, which has four control characters more."""
    return "(?U)" + separators.replace(r"\s", r"\s\x1c-\x1f")


def stripped(value: Column) -> Column:
    """The text without white space at either end, as Python strips it."""
    return F.regexp_replace(value, _java(r"^[\s]+|[\s]+$"), "")


WHITESPACE = r"[\s]+"
LABEL_SEPARATORS = r"[\s\-_]+"
GROUP_SEPARATORS = r"[\s\-_/&,.]+"


def alias_key(value: Column) -> Column:
    """Key of an entity spelling: folded, upper case, whitespace collapsed."""
    return _key(value, WHITESPACE)


def group_key(value: Column) -> Column:
    """Key of a region or income spelling: hyphens and underscores also count as spaces."""
    return _key(value, LABEL_SEPARATORS)


def label_key(value: Column) -> Column:
    """Key of a curated group spelling: ``/ & , .`` also count as spaces."""
    return _key(value, GROUP_SEPARATORS)


def key_of(text: str, separators: str) -> str:
    """The same key for one parameter on the driver."""
    return re.sub(separators, " ", _folded(text).upper()).strip()
