"""Dates in mixed writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    """The number of a month by its first three letters."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS.split("|")[:12], 1) for x in (m[:3], str(i))]), F.lower(F.substring(name, 1, 3)))


def month_first(text: Column) -> Column:
    pattern = rf"(?i)\b({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    return _iso(F.regexp_extract(text, pattern, 3), _month(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2))


def day_month(text: Column) -> Column:
    pattern = rf"(?i)\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\b"
    return _iso(F.regexp_extract(text, pattern, 3), _month(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 1))


def iso(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")


def slashed(text: Column) -> Column:
    """Day first."""
    pattern = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    return _iso(F.regexp_extract(text, pattern, 3), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1))


def loose_date(text: Column, day_first: bool = True) -> Column:
    """The first complete date in a text, however it is written; null if it names no day, month and year.

    Words and numbers are read from left to right. A month is a name, or its first three letters or more; a year has
    four digits, or two where day and month stand before it; a day is the number beside the month's name. Numbers
    alone are day, month and year, or year, month and day; which of two comes first is told by one above 12, else by
    ``day_first``. Ordinal endings, ``of`` and ``the`` do not count; any other word cuts off numbers before it.
    """
    names = [m for m in MONTHS.split("|")[:12]]
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|\d+"), F.lit(0))
    fields = ("day", "month", "year", "one", "two", "done")

    def state(**now: Column) -> Column:
        return F.struct(*[now[f].alias(f) for f in fields])

    null = F.lit(None).cast("int")
    start = state(day=null, month=null, year=null, one=null, two=null, done=F.lit(False))

    def step(s: Column, t: Column) -> Column:
        month = null
        for i, name in enumerate(names, 1):
            month = F.when((F.length(t) >= 3) & F.startswith(F.lit(name), t), F.lit(i)).when((t == "sept") & F.lit(i == 9), F.lit(9)).otherwise(month)
        n = t.try_cast("int")
        short = F.length(t) <= 2
        year = F.when((F.length(t) == 4) & (n >= 1000) & (n < 3000), n)
        day, old, two, one = s["day"], s["year"], s["two"], s["one"]
        known = {f: s[f] for f in fields}
        # numbers alone: the two before a year, or the two after it
        first, second = (two, one) if day_first else (one, two)
        swapped = second > 12
        by_year = state(**known | {"day": F.when(swapped, second).otherwise(first), "month": F.when(swapped, first).otherwise(second), "year": year, "done": F.lit(True)})
        after_year = state(**known | {"day": n, "month": one, "done": F.lit(True)})
        of_year = (
            F.when(s["month"].isNotNull() & day.isNotNull(), state(**known | {"year": year, "done": F.lit(True)}))
            .when(s["month"].isNull() & two.isNotNull() & one.isNotNull(), by_year)
            .otherwise(state(**known | {"year": year, "one": null, "two": null}))
        )
        century = F.when(n < 69, n + 2000).otherwise(n + 1900)
        of_number = (
            F.when(s["month"].isNotNull() & day.isNull() & n.between(1, 31), state(**known | {"day": n, "done": old.isNotNull()}))
            .when(s["month"].isNotNull() & day.isNotNull() & old.isNull(), state(**known | {"year": century, "done": F.lit(True)}))
            .when(s["month"].isNull() & old.isNotNull() & one.isNotNull() & one.between(1, 12) & n.between(1, 31), after_year)
            .otherwise(state(**known | {"two": one, "one": n}))
        )
        of_month = state(**known | {"month": month, "day": F.when(one.between(1, 31), one), "one": null, "two": null, "done": old.isNotNull() & F.coalesce(one.between(1, 31), F.lit(False))})
        aside = t.isin("st", "nd", "rd", "th", "of", "the", "t")
        return (
            F.when(s["done"] | aside, s)
            .when(year.isNotNull(), of_year)
            .when(n.isNotNull() & short, of_number)
            .when(month.isNotNull() & s["month"].isNull(), of_month)
            .otherwise(state(**known | {"one": null, "two": null, "year": F.when(s["month"].isNotNull(), old)}))
        )

    return F.aggregate(tokens, start, step, lambda s: F.when(s["done"], _iso(s["year"].cast("string"), s["month"].cast("string"), s["day"].cast("string"))))


def parse_date(text: Column, iso_first: bool = False, loose: bool = False) -> Column:
    """The first date that a text holds, by writing: month first, day and month, ISO, slashed; null if none.

    loose: where none of the four writings occurs, any other complete date is looked for.
    """
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    ways = [month_first(flat), day_month(flat), iso(flat), slashed(flat)]
    ways = [ways[2], ways[0], ways[1], ways[3]] if iso_first else ways
    return F.coalesce(*ways, *([loose_date(flat)] if loose else []))


def question_date(text: Column) -> Column:
    """A date named in a question: ISO, else month first with the full name or its short form."""
    return F.coalesce(iso(text), month_first(text))


def strict_iso(text: Column) -> Column:
    """A date only where the whole text is an ISO date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)).cast("bigint")


def years_named(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def dates_named(text: Column) -> Column:
    """All dates as written, ISO or day, short month and year."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[-/\s][A-Za-z]{3}[-/\s]\d{2,4})\b"), F.lit(0))
