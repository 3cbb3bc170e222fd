"""Numbers given as answers: validity, bounds, issues, repair, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import once
from .money import number_once

# Bounds and defaults of answers by type.
MAX_DAYS = 18_250
STRICT_MAX_DAYS = 7_300
COMPANY_TOTAL = 55_300_000_000.0
DEFAULTS = {"money": 100_000_000.0, "percent": 50.0, "count": 2.0, "days": 730.0}
OTHER_DEFAULT = 0.0
BASELINE_MAX_COUNT = 10_000


def finite(value: Column) -> Column:
    """The value, or null if it is not a finite number."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def valid_number(text: Column) -> Column:
    """The number of an answer, without commas, rupee sign, INR and percent sign; null if it is none. Unit words make it invalid."""
    return once(number_once(F.regexp_replace(text.cast("string"), "[,₹%]|INR", "")), finite)


def submitted_number(text: Column) -> Column:
    """Like ``valid_number``, but a percent sign makes it invalid."""
    return once(number_once(F.regexp_replace(text.cast("string"), "[,₹]|INR", "")), finite)


def is_fraction(value: Column) -> Column:
    """Whether a percentage looks like a fraction of one."""
    return F.coalesce((value > 0) & (value <= 1), F.lit(False))


def issues(value: Column, kind: Column) -> Column:
    """Codes of what is wrong or doubtful about an answer of a kind; value null: not a number."""
    whole = value == F.floor(value)
    tests = [
        ("INVALID_NUMBER", value.isNull()),
        ("OUT_OF_BOUNDS_PERCENT", (kind == "percent") & ((value < 0) | (value > 100))),
        ("FRACTION_PERCENT_SUSPECTED", (kind == "percent") & is_fraction(value)),
        ("NEGATIVE_DAYS", (kind == "days") & (value < 0)),
        ("SUSPICIOUS_DAYS", (kind == "days") & (value > MAX_DAYS)),
        ("NEGATIVE_COUNT", (kind == "count") & (value < 0)),
        ("NON_INTEGER_COUNT", (kind == "count") & ~whole),
        ("NEGATIVE_MONEY", (kind == "money") & (value < 0)),
        ("SUSPICIOUS_HIGH_MONEY", (kind == "money") & (value > 2 * COMPANY_TOTAL)),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))


def implausible(value: Column, kind: Column) -> Column:
    """Codes of the stricter check before a release."""
    tests = [
        ("not a number", value.isNull()),
        ("money above the company's total", (kind == "money") & (value > COMPANY_TOTAL)),
        ("money below a thousand", (kind == "money") & (value != 0) & (F.abs(value) < 1000)),
        ("percent out of range", (kind == "percent") & ((value < 0) | (value > 100))),
        ("days out of range", (kind == "days") & ((value < 0) | (value > STRICT_MAX_DAYS))),
        ("not whole", kind.isin("count", "days") & (value != F.floor(value))),
        ("negative", kind.isin("count", "money") & (value < 0)),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))


def default_answer(kind: Column) -> Column:
    out = F.lit(OTHER_DEFAULT)
    for name, value in DEFAULTS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def cents(value: Column) -> Column:
    """Rounded to two places, ties away from zero, by decimal arithmetic."""
    return F.round(value.cast("decimal(28,8)"), 2).cast("double")


def repaired(value: Column, kind: Column, rescale: bool = True) -> Column:
    """An answer that can be handed in: the default where there is no number, percent rescaled and clamped, the rest rounded and not negative."""
    percent = F.when(is_fraction(value), value * 100).otherwise(value) if rescale else value
    fixed = (
        F.when(kind == "percent", cents(F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))))
        .when(kind.isin("count", "days"), F.greatest(F.bround(value, 0), F.lit(0.0)) + 0.0)  # no negative zero
        .when(kind == "money", cents(F.greatest(value, F.lit(0.0))))
        .otherwise(cents(value))
    )
    return F.when(value.isNull(), default_answer(kind)).otherwise(fixed)


def bounded(value: Column, kind: Column) -> Column:
    """The baseline solver's bounds: what is out of them gets a stock value."""
    percent = F.when(value < 0, 0.0).when(is_fraction(value), value * 100).when(value > 100, 50.0).otherwise(value)
    return (
        F.when(kind == "percent", cents(percent))
        .when(kind == "days", F.when((value < 0) | (value > MAX_DAYS), 730.0).otherwise(F.bround(value, 0)))
        .when(kind == "count", F.when((value < 0) | (value > BASELINE_MAX_COUNT), 2.0).otherwise(F.bround(value, 0)))
        .otherwise(F.when(value < 0, 100_000_000.0).otherwise(cents(value)))
    )


def score_one(gold: Column, got: Column) -> Column:
    """1 less the relative error, 0 at least; a gold of 0 must be met exactly; nothing for what is not a finite number."""
    gold, got = finite(gold.cast("double")), finite(got.cast("double"))
    relative = F.when(gold == 0, F.when(got == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(got - gold) / F.nullif(F.abs(gold), F.lit(0.0))))
    return F.when(gold.isNull() | got.isNull(), 0.0).otherwise(relative)


def answer_text(value: Column) -> Column:
    """A whole number without a point, another with two places."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))
