"""Amounts of money and numbers in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import once, strip

# Unit words with their factors.
UNITS = {"crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "thousand": 1_000, "k": 1_000}
# Patterns of a currency's sign, of an amount and of a mention of money.
CURRENCY = r"(?:INR|Rs\.?|₹)"
AMOUNT = r"[\d,]+(?:\.\d+)?"
# A bare number counts as a mention of money only with one of the large units.
MENTION = rf"(?i){CURRENCY}\s*{AMOUNT}(?:\s*(?:crores?|cr|lakhs?|lacs?|thousand|k))?(?:\s*/-)?|{AMOUNT}\s*(?:crores?|cr|lakhs?|lacs?)\b"
# Number words.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}


def _factor(unit: Column) -> Column:
    chosen = F.lit(1)
    for factor in sorted(set(UNITS.values())):
        chosen = F.when(unit.isin([u for u, f in UNITS.items() if f == factor]), factor).otherwise(chosen)
    return chosen


def _digits(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?<=\d)_(?=\d)", "")


def _number(digits: Column) -> Column:
    shaped = digits.rlike(r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))$")
    return F.when(shaped, F.regexp_replace(digits, "^[+]", "").try_cast("double"))


def plain_number(text: Column) -> Column:
    """A number as a program writes it (sign, point, exponent, nan, inf), else null."""
    return _number(_digits(text))


def number_once(text: Column) -> Column:
    """The same with the text read once a row. Not for bodies of SQL functions, whose text cannot hold what ``once`` makes."""
    return once(_digits(text), _number)


def bare_amount(text: Column) -> Column:
    """An amount without its currency and closing ``/-``: the first step of ``parse_money``."""
    bare = strip(F.regexp_replace(strip(text.cast("string")), "/-?$", ""))
    return strip(F.regexp_replace(bare, rf"(?i)^{CURRENCY}\s*", ""))


#: Digits and unit of a bare amount.
SHAPE = rf"(?i)^({AMOUNT})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})?$"


def unit_of(bare: Column) -> Column:
    return F.lower(F.regexp_extract(bare, SHAPE, 2))


def amount_of(bare: Column, unit: Column) -> Column:
    """Rupees of a bare amount with its unit: the last step of ``parse_money``."""
    digits = F.replace(F.regexp_extract(bare, SHAPE, 1), F.lit(","), F.lit(""))
    exact = (digits.try_cast("decimal(26,6)") * _factor(unit)).cast("double")
    return F.when(bare.rlike(SHAPE), F.when(digits != "", exact)).otherwise(plain_number(F.replace(bare, F.lit(","), F.lit(""))))


def parse_money(text: Column) -> Column:
    """Rupees of one amount, with or without currency, unit and closing ``/-``; null if it is none.

    The arithmetic is exact (decimal) up to the last step, so 10.13 Cr is 101300000.
    """
    bare = bare_amount(text)
    return amount_of(bare, unit_of(bare))


def money_mentions(text: Column) -> Column:
    """All amounts in a text, in order: array of struct(raw, value)."""
    raw = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    return F.filter(F.transform(raw, lambda m: F.struct(m.alias("raw"), parse_money(m).alias("value"))), lambda m: m["value"].isNotNull())


def cell_value(text: Column) -> Column:
    """A spreadsheet cell as a number: a plain number, else an amount of money."""
    return F.coalesce(plain_number(text), parse_money(text))


def number_in_words(text: Column) -> Column:
    """Rupees of a phrase such as ``five crore twenty-five lakh`` or ``5.5 crore``; null if it has no number.

    Words are read in order: numbers add up, ``hundred`` multiplies what has added up, and a unit
    moves that times its factor to the total.
    """
    words = F.split(strip(F.replace(F.lower(text), F.lit("-"), F.lit(" "))), r"\s+")
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in (pair[0], float(pair[1]))])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"), F.lit(False).alias("any"))

    def step(state: Column, word: Column) -> Column:
        number = F.coalesce(F.try_element_at(table, word), F.when(word.rlike(r"^[\d,]*\d[\d,]*(\.\d+)?$"), F.replace(word, F.lit(","), F.lit("")).try_cast("double")))
        total, part = state["total"], state["part"]
        large = F.when(word.startswith("crore") | (word == "cr"), 1e7).when(word.startswith("lakh") | word.startswith("lac"), 1e5)
        return (
            F.when(number.isNotNull(), F.struct(total.alias("total"), (part + number).alias("part"), F.lit(True).alias("any")))
            .when(word == "hundred", F.struct(total.alias("total"), (part * 100).alias("part"), state["any"].alias("any")))
            .when(large.isNotNull(), F.struct((total + part * large).alias("total"), F.lit(0.0).alias("part"), state["any"].alias("any")))
            .otherwise(state)
        )

    return F.aggregate(words, start, step, lambda s: F.when(s["any"], s["total"] + s["part"]))
