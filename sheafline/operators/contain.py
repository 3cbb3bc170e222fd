"""Which texts contain which names, by an equi-join on a part of the name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import has_any
from .lineage import cut, shuffled

#: Characters of the part by which a name is looked up: the largest of these that the name has.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32)
#: A part of a text is only looked up if some name has a part whose beginning, of so many characters, falls on the same of so many bits.
LEAD, BITS = 4, 1 << 15
#: Texts are first asked for the beginnings of the parts where there are up to so many.
FEW = 32
#: Names of up to so many characters in all are broadcast, and then no text is shuffled.
BROADCAST_CHARACTERS = 1_000_000


def _places(text: Column, size: Column) -> Column:
    """Where the parts of the text with so many characters begin."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _bit(text: Column, at: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(text, at, F.least(size, F.lit(LEAD)))), F.lit(BITS)).cast("int")


def _parts(text: Column, size: Column, begins: Column | None = None) -> Column:
    """Hashes of all parts of the text with so many characters; pairs are verified, so a hash that parts share does no harm.

    begins: bits of which 32 stand in each long; only parts with a beginning that has its bit set are given.
    """
    places = _places(text, size)
    if begins is not None:
        has = lambda i: F.getbit(F.element_at(begins, F.shiftright(_bit(text, i, size), 5) + 1), _bit(text, i, size).bitwiseAND(F.lit(31))) == 1
        places = F.filter(places, has)
    return F.transform(places, lambda i: F.xxhash64(F.substring(text, i, size)))


def _looked_up(names: DataFrame) -> DataFrame:
    """name, part: of the parts of each name the one that the fewest names have, so that a common word in many names brings none of them together."""
    own = names.select("name", F.explode(F.array_distinct(_parts(F.col("name"), F.col("n")))).alias("part"))
    counts = own.groupBy("part").agg(F.count("*").alias("names"))
    rarest = shuffled(own).join(shuffled(counts), "part").groupBy("name").agg(F.min(F.struct("names", "part")).alias("least"))
    return rarest.select("name", F.col("least.part").alias("part"))


def _begins(names: DataFrame) -> dict[int, Column]:
    """For each size of parts the bits of the beginnings of the names' parts: at most 1024 rows a size, whatever the number of names."""
    bits = names.select("n", F.explode(F.array_distinct(F.transform(_places(F.col("name"), F.col("n")), lambda i: _bit(F.col("name"), i, F.col("n"))))).alias("bit"))
    words = bits.groupBy("n", F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("set"))
    found: dict[int, list[int]] = {}
    for row in words.collect():
        found.setdefault(row["n"], [0] * (BITS // 32))[row["word"]] = row["set"]
    return {n: F.expr("array(" + ",".join(f"{x}L" for x in words) + ")") for n, words in found.items()}


def _leads(names: DataFrame) -> list[str]:
    """The beginnings of the names' parts, if there are few; else none."""
    own = names.select(F.explode(F.array_distinct(F.transform(_places(F.col("name"), F.col("n")), lambda i: F.substring("name", i, F.least("n", F.lit(LEAD)))))).alias("lead"))
    leads = [row["lead"] for row in own.distinct().limit(FEW + 1).collect()]
    return leads if len(leads) <= FEW else []


def _of_texts(begins: dict[int, Column], leads: Sequence[str]) -> Column:
    """The parts of a text; an outer explode, for below an inner one Spark puts a condition that works them out once more.

    Where the names' parts begin in few ways a text without any of these is not gone through place by place.
    """
    parts = F.array_distinct(F.flatten(F.array(*[_parts(F.col("text"), F.lit(n), begins[n]) for n in sorted(begins)])))
    return F.explode_outer(F.when(has_any(F.col("text"), leads), parts) if leads else parts).alias("part")


def candidates(texts: DataFrame, names: DataFrame, begins: dict[int, Column], leads: Sequence[str] = ()) -> DataFrame:
    """th (the hash of a text), name: the pairs to verify. names: name, n (the size of its parts)."""
    return texts.select(F.xxhash64("text").alias("th"), _of_texts(begins, leads)).join(shuffled(_looked_up(names)), "part").select("th", "name").distinct()


def contained_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """All pairs id, name in which the text has the name in it. texts: id, text. names: name.

    A name is looked up by one of its parts, of half its length at least up to 32
    characters: by that which the fewest names have. Every pair found is then
    verified. Texts meet the names of their parts by hashes alone, and come back
    for the verification; where there are few names these go to the texts.
    Null and empty names are contained in nothing, and null texts contain
    nothing. Repeated names count once; rows that repeat an id are one text
    each, of which any may hold the name.
    """
    texts = texts.select("id", "text").where("text is not null")
    size = F.array_max(F.filter(F.array(*[F.lit(n) for n in SIZES]), lambda n: n <= F.length("name")))
    names = cut(names.select("name").where("name is not null and name <> ''").distinct().withColumn("n", size))
    begins = _begins(names)
    if not begins:
        return texts.select("id", F.lit(None).cast("string").alias("name")).limit(0)
    leads = _leads(names)
    if names.agg(F.sum(F.length("name").cast("long"))).first()[0] <= BROADCAST_CHARACTERS:
        pairs = texts.select("id", "text", _of_texts(begins, leads)).join(F.broadcast(_looked_up(names)), "part")
    else:
        pairs = texts.withColumn("th", F.xxhash64("text")).join(shuffled(candidates(texts, names, begins, leads)), "th")
    return pairs.where(F.contains("text", "name")).select("id", "name").distinct()
