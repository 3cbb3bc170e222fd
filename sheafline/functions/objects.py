"""Objects of unknown shape, cleaned to plain JSON: VARIANT values are walked within their row, very deep ones level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .basic import once

#: Objects and arrays within one another up to so many levels are cleaned within their row.
LEVELS = 8


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return once(F.to_json(F.struct(text.alias("v"))), lambda c: F.substr(c, F.lit(6), F.length(c) - 6))


def _leaf(value: Column, kind: Column) -> Column:
    """The JSON text of a value that holds no others: dates and times in ISO writing, no-numbers as null."""
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    moment = F.try_variant_get(value, "$", "timestamp")
    when = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(moment, "SSSSSS") != "000000", F.date_format(moment, ".SSSSSS")).otherwise(""))
    return (
        F.when(kind.isin("DOUBLE", "FLOAT") & (F.isnan(number) | (F.abs(number) == float("inf"))), F.lit("null"))
        .when(kind == "DATE", _quoted(text))
        .when(kind.isin("TIMESTAMP", "TIMESTAMP_NTZ"), _quoted(when))
        .otherwise(F.coalesce(F.to_json(value), F.lit("null")))
    )


def _shape(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _members(value: Column, shape: Column) -> Column:
    """name (null in an array) and value of what an object or an array holds, in order; null for any other value."""
    named = F.transform(F.map_entries(value.cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    plain = F.transform(value.cast("array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("value")))
    return F.when(shape.startswith("OBJECT"), named).when(shape.startswith("ARRAY"), plain)


def _joined(parts: Column, is_object: Column, name: Column, sets: tuple[str, ...]) -> Column:
    """The JSON text of an object or an array from the names and texts of its parts."""
    named = F.transform(parts, lambda p: F.concat(_quoted(p["name"]), F.lit(":"), p["text"]))
    plain = F.transform(parts, lambda p: p["text"])
    listed = F.when(name.isin(*sets), F.array_sort(F.array_distinct(plain))).otherwise(plain) if sets else plain
    inside = lambda c, a, b: F.concat(F.lit(a), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit(b))
    return F.when(is_object, inside(named, "{", "}")).otherwise(inside(listed, "[", "]"))


def _deeper(value: Column, levels: int) -> Column:
    """Whether the value has objects or arrays within one another on more than so many levels."""

    def of(shape: Column) -> Column:
        if levels == 0:
            return shape.startswith("OBJECT") | shape.startswith("ARRAY")
        return F.coalesce(F.exists(_members(value, shape), lambda m: _deeper(m["value"], levels - 1)), F.lit(False))

    return once(_shape(value), of)


def _cleaned(value: Column, name: Column, sets: tuple[str, ...], levels: int) -> Column:
    """The JSON text of a value of so many levels at most."""

    def of(shape: Column) -> Column:
        leaf = _leaf(value, shape)
        if levels == 0:
            return leaf
        parts = F.transform(_members(value, shape), lambda m: F.struct(m["name"].alias("name"), _cleaned(m["value"], m["name"], sets, levels - 1).alias("text")))
        return once(parts, lambda p: F.when(p.isNull(), leaf).otherwise(_joined(p, shape.startswith("OBJECT"), name, sets)))

    return once(_shape(value), of)


def clean_json(rows: DataFrame, key: str, value: str, sets: tuple[str, ...] = ()) -> DataFrame:
    """key, json: each VARIANT as JSON text that any reader takes, whatever its shape.

    Dates and times become ISO text, numbers that are none become null, and the arrays under the names in ``sets`` lose
    repeated members and are sorted by their JSON text; the fields of an object are sorted by name, as VARIANT has them. A
    null value is ``null``.

    A value is cleaned within its row, without a shuffle; only those with more than ``LEVELS`` levels of objects and arrays
    are taken apart. Rows that repeat a key are each cleaned by themselves; those with a null key too.
    """
    deep = once(F.col(value), lambda v: _deeper(v, LEVELS))
    json = once(F.col(value), lambda v: _cleaned(v, F.lit(None).cast("string"), sets, LEVELS)).alias("json")
    left = rows.where(deep)
    return rows.select(key, json) if left.isEmpty() else rows.where(~deep).select(key, json).unionByName(_by_levels(left, key, value, sets))


def _by_levels(rows: DataFrame, key: str, value: str, sets: tuple[str, ...]) -> DataFrame:
    """The same for values of any depth: each level is one explode over all rows; on the way back the parts of each object are
    put together by a grouping, deepest first. The number of levels is that of the deepest object.
    """
    level = rows.select(F.col(key).alias("key"), F.col(value).alias("v")).withColumn("id", F.monotonically_increasing_id().cast("string"))
    level = cut(level.select("key", "id", F.lit("").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"), F.col("v")))
    roots, levels = level.select("key", "id"), []
    while True:
        shape = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("leaf")
        level = level.withColumn("shape", shape).withColumn("kind", kind)
        levels.append(level.select("id", "parent", "pos", "name", "kind", F.when(F.col("kind") == "leaf", _leaf(F.col("v"), F.col("shape"))).alias("text")))
        deeper = level.where("kind <> 'leaf'")
        if deeper.isEmpty():
            break
        deeper.createOrReplaceTempView("_sheafline_level")
        level = cut(rows.sparkSession.sql("SELECT concat(l.id, '.', e.pos) AS id, l.id AS parent, e.pos AS pos, e.key AS name, e.value AS v FROM _sheafline_level l, LATERAL variant_explode(l.v) e"))
    done = None
    for depth in reversed(range(len(levels))):
        now = levels[depth]
        if done is not None:
            member = F.struct("pos", "name", "text")
            own = done.groupBy("parent").agg(F.array_sort(F.collect_list(member)).alias("parts")).withColumnRenamed("parent", "id")
            now = now.join(own, "id", "left")
            text = F.when(F.col("kind") == "leaf", F.col("text")).otherwise(_joined(F.col("parts"), F.col("kind") == "object", F.col("name"), sets))
        else:
            text = F.when(F.col("kind") == "object", F.lit("{}")).when(F.col("kind") == "array", F.lit("[]")).otherwise(F.col("text"))
        done = now.select("id", "parent", "pos", "name", text.alias("text"))
    return roots.join(done, "id").select(F.col("key").alias(key), F.col("text").alias("json"))
