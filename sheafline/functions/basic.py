"""Small string expressions that the others are built from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it and wherever the optimizer moves it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing or an empty string matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is part of the text; null text: false."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def lines(text: Column) -> Column:
    """The stripped lines that are not empty."""
    cut = F.transform(F.split(text, "\n"), strip)
    return F.filter(cut, lambda line: line != "")


def first_known(values: Column, labels: Sequence[str]) -> Column:
    """The first value of a map, in the order of the labels, that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(values, F.lit(label)), F.lit("")) for label in labels])
