"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern; each pattern's words flow to the quotas of its sources, and every
further pass over a pattern costs more than the one before, so repetition is
spread out and goes no further than needed. The flow of a pattern then becomes
whole passes over its documents and one part pass, whose documents are those
with the smallest seeded hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .components import connected

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: No source's target, and no document, is taken more often than this.
MOST_PASSES = 2
SEED = 42
#: Tables with a row for each pattern or source are broadcast up to so many rows, and joined by key beyond.
BROADCAST_ROWS = 50_000
#: Hexadecimal digits of the order that one narrowing step reads, and the rows at the edge at which narrowing ends.
STEP_DIGITS, EDGE_ROWS = 3, 4096


def min_cost_flow(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], passes: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources.

    patterns: (words, sources). A pass over a pattern is an arc with its words as
    capacity, and costs twice the pass before. A path's cost is that of its first
    arc alone, so the cheapest paths are those that begin with the earliest pass
    that still has one: for each pass in turn the shortest paths are filled
    together, level by level, until none is left. That makes the flow the
    largest one and, of those, the cheapest. The network has a node for each
    pattern and source, so its size does not depend on the number of documents.
    """
    takes = [list(sources) for _, sources in patterns]
    gives: list[list[int]] = [[] for _ in quotas]
    for p, sources in enumerate(takes):
        for s in sources:
            gives[s].append(p)
    flows = [dict.fromkeys(sources, 0) for sources in takes]
    room = list(quotas)
    for _ in range(passes):
        supply = [words for words, _ in patterns]
        while levels := _levels(supply, takes, gives, flows, room):
            _fill(*levels, supply, takes, gives, flows, room)
    return flows


def _levels(supply: list[int], takes: list[list[int]], gives: list[list[int]], flows: list[dict[int, int]], room: list[int]) -> tuple[list[int], list[int]] | None:
    """How far each pattern and source is from a pattern with words left, up to the first source with room; none if there is no such source."""
    of_pattern, of_source, depth = [-1] * len(takes), [-1] * len(gives), 0
    here = [p for p, left in enumerate(supply) if left > 0]
    while here:
        for p in here:
            of_pattern[p] = depth
        reached = []
        for p in here:
            for s in takes[p]:
                if of_source[s] < 0:
                    of_source[s] = depth + 1
                    reached.append(s)
        if any(room[s] > 0 for s in reached):
            return of_pattern, of_source
        depth += 2
        here = list(dict.fromkeys(p for s in reached for p in gives[s] if of_pattern[p] < 0 and flows[p][s] > 0))
    return None


def _fill(of_pattern: list[int], of_source: list[int], supply: list[int], takes: list[list[int]], gives: list[list[int]], flows: list[dict[int, int]], room: list[int]) -> None:
    """Fill paths that go one level down at each step, until none is left; each arc that leads nowhere is looked at once."""
    next_source, next_pattern = [0] * len(takes), [0] * len(gives)

    def onward(s: int) -> int | None:
        while next_pattern[s] < len(gives[s]):
            q = gives[s][next_pattern[s]]
            if of_pattern[q] == of_source[s] + 1 and flows[q][s] > 0:
                return q
            next_pattern[s] += 1
        return None

    for start in (p for p, level in enumerate(of_pattern) if level == 0):
        path = [start]
        while path and supply[start] > 0:
            p = path[-1]
            if next_source[p] == len(takes[p]):  # a dead end: go back and never come here again
                path.pop()
                if path:
                    next_pattern[path.pop()] += 1
                continue
            s = takes[p][next_source[p]]
            if of_source[s] == of_pattern[p] + 1:
                if room[s] > 0:
                    steps = [*path, s]
                    backs = list(zip(steps[1:-1:2], steps[2::2], strict=True))  # source, and the pattern that gives it up
                    push = min(supply[start], room[s], *(flows[q][x] for x, q in backs)) if backs else min(supply[start], room[s])
                    supply[start] -= push
                    room[s] -= push
                    for q, x in zip(steps[::2], steps[1::2], strict=True):
                        flows[q][x] += push
                    for x, q in backs:
                        flows[q][x] -= push
                    path = [start]
                    continue
                if (q := onward(s)) is not None:
                    path += [s, q]
                    continue
            next_source[p] += 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources (source, size) with ``place``: 0, 1, ... by code point, a null source last."""
    ordered = saved(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("at", 33), F.expr("at & 8589934591")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the ordered table
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ordered.withColumn("part", part).join(F.broadcast(parts), "part").select("source", "size", (F.col("before") + within).alias("place"))


def _with_targets(ranked: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` by weight, adding up to ``share`` of all sizes; what is above ``most`` times a size is shared out again.

    A source is held at its bound if the words for a weight of 1 exceed what it
    holds for one. Each round fixes more of them, and only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.withColumn("weight", weight).withColumn("bound", most * F.col("size").cast("double")))
    total = share * float(ranked.agg(F.sum("size")).first()[0] or 0)
    unit, held = 0.0, None
    while True:
        over = F.col("weight") * unit > F.col("bound")
        n, fixed, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("bound"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not free:
            break
        held, unit = n, (total - (fixed or 0.0)) / free
    return ranked.withColumn("target", F.least("bound", F.col("weight") * unit)).select("source", "size", "place", "target")


def _flows(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """_pattern and flow, the words that the mix takes of each pattern (_pattern, sources, words).

    Sources that patterns connect make a network, one that shares no pattern a
    network of its own; the flow of each is solved in a task of its own.
    """
    members = patterns.select("_pattern", "words", F.explode("sources").alias("source"), F.size("sources").alias("n"))
    members = saved(members.join(sources, members["source"].eqNullSafe(sources["source"])).select("_pattern", "words", "n", "place", F.round("target").cast("long").alias("quota")))
    groups = members.select(F.col("place").alias("node"), F.col("place").alias("least")).distinct()
    first = members.where("n > 1").groupBy("_pattern").agg(F.min("place").alias("a"))
    links = members.join(first, "_pattern").where("a <> place").select("a", F.col("place").alias("b"))
    if not links.isEmpty():
        groups = connected(groups, links)
    network = members.join(groups, members["place"] == groups["node"]).select(F.col("least").alias("network"), "_pattern", "words", "place", "quota")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_pattern", "place"])
        quotas = rows.groupby("place")["quota"].first().sort_index()
        at = {place: i for i, place in enumerate(quotas.index)}
        each = [(name, int(part["words"].iloc[0]), [at[x] for x in part["place"]]) for name, part in rows.groupby("_pattern", sort=True)]
        flows = min_cost_flow([(words, to) for _, words, to in each], [int(q) for q in quotas], passes)
        return pd.DataFrame({"_pattern": [name for name, _, _ in each], "flow": [sum(f.values()) for f in flows]})

    return network.groupBy("network").applyInPandas(solve, "_pattern string, flow long")


def _part_pass(docs: DataFrame, wanted: DataFrame, patterns: int) -> DataFrame:
    """The documents of each pattern that together make ``rest`` words, by smallest ``_order``: adds column ``part``.

    docs: _pattern, _size, _order (hexadecimal digits) and more. wanted:
    _pattern, rest. Each step sums the words by the next digits of the order,
    below the value reached, and finds the value at which the sum passes what is
    wanted. Steps go on until few documents share that value, and the one
    at which the sum passes is taken for the words that are left.
    """
    reached = wanted.select("_pattern", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    digits, edge = 0, EDGE_ROWS + 1
    while edge > EDGE_ROWS and digits < 30:
        here = docs.select("_pattern", "_size", F.substring("_order", 1, digits).alias("above"), F.substring("_order", 1, digits + STEP_DIGITS).alias("top"))
        here = here.join(_small(reached, patterns), "_pattern").where("above = prefix")
        sums = here.groupBy("_pattern", "left", "top").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
        bins = F.sort_array(F.collect_list(F.struct("top", "words", "n"))).alias("bins")  # 4096 at most
        passed = "aggregate(bins, struct(left, '' as at, 0L as n), (a, x) -> if(a.at <> '', a, if(x.words > a.left, struct(a.left, x.top as at, x.n), struct(a.left - x.words as left, '' as at, 0L as n))))"
        found = sums.groupBy("_pattern", "left").agg(bins).select("_pattern", F.expr(passed).alias("a"))
        reached = saved(found.where("a.at <> ''").select("_pattern", "a.left", F.col("a.at").alias("prefix"), F.col("a.n").alias("n")))
        edge = reached.agg(F.max("n")).first()[0] or 0
        reached, digits = reached.drop("n"), digits + STEP_DIGITS
    marked = docs.join(_small(wanted, patterns), "_pattern", "left").join(_small(reached, patterns), "_pattern", "left")
    top = F.substring("_order", 1, digits)
    state = F.when(F.col("rest").isNull() | (F.col("rest") <= 0), F.lit("none"))
    state = state.when(F.col("prefix").isNull() | (top < F.col("prefix")), F.lit("all")).when(top == F.col("prefix"), F.lit("edge")).otherwise(F.lit("none"))
    marked = marked.withColumn("_state", state)
    order = Window.partitionBy("_pattern").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = marked.where("_state = 'edge'").withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least("_size", F.col("left") - F.col("_before"))).cast("long")).drop("_before")
    rest = marked.where("_state <> 'edge'").withColumn("part", F.when(F.col("_state") == "all", F.col("_size")).otherwise(F.lit(0)).cast("long"))
    return rest.unionByName(at_edge).drop("rest", "left", "prefix", "_state")


def mix(docs: DataFrame, memberships: Column, size: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """What a mix takes of every document: doc_id, sources, size, source_size, target, taken, then the columns of ``carry``.

    memberships: an array of the document's sources (a null source is one of
    its own, sorted last; a null or empty array: none, and nothing is taken).
    Sources sort by code point and weigh ``weights``, repeating. A source's size
    is that of all its documents, its target the quota; source_size and target are
    those of a document's first source. Documents at the edge
    of a part pass are taken for a part of their words, one for each pattern, so
    a source's words equal its target but for rounding wherever the flow fills
    it; ``taken`` never exceeds ``passes`` times the size.

    Order of the documents, and so every tie, goes by a seeded hash of doc_id and
    text, then by place in the table; rows that repeat in both are alike, and
    which of them stands at the edge shows only in the columns of ``carry``. A
    null doc_id hashes as such. An empty text has size 0 and takes 0. An empty
    table gives no rows. Columns besides those named and text are not read. There
    may be any number of sources and patterns; a set of sources that overlapping
    patterns connect is solved in one task, by patterns.
    """
    ids = F.col("doc_id").cast("long")
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("_rest")] if carry else []
    kept = ["_rest"] if carry else []
    drawn = F.xxhash64(F.lit(seed), F.coalesce(ids, F.lit(-1)), ids.isNull(), F.col("text").cast("string"))
    sized = docs.select(
        ids.alias("doc_id"),
        F.array_sort(F.array_distinct(F.coalesce(memberships, F.array().cast("array<string>")))).alias("sources"),
        size.cast("long").alias("_size"),
        F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (drawn, F.xxhash64(F.monotonically_increasing_id()))]).alias("_order"),
        *rest,
    )
    sized = saved(sized.withColumn("_pattern", F.to_json(F.struct(F.col("sources")), {"ignoreNullFields": "false"})))
    patterns = saved(sized.groupBy("_pattern", "sources").agg(F.sum("_size").alias("words")))
    n = patterns.count()
    sources = patterns.select("words", F.explode("sources").alias("source")).groupBy("source").agg(F.sum("words").alias("size"))
    sources = saved(_with_targets(_ranked(sources), weights, share, passes))
    flow = patterns.join(_flows(patterns, sources, passes), "_pattern", "left").withColumn("flow", F.coalesce("flow", F.lit(0)))
    flow = flow.withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("flow") / F.col("words"))).otherwise(0).cast("long"))
    about = sources.select(F.col("source").alias("first"), F.col("size").alias("source_size"), "target")
    first = F.try_element_at("sources", F.lit(1))
    plan = flow.select("_pattern", "whole", (F.col("flow") - F.col("whole") * F.col("words")).alias("rest"), first.alias("own"), (F.size("sources") > 0).alias("some"))
    plan = saved(plan.join(about, F.col("some") & F.col("own").eqNullSafe(F.col("first")), "left").select("_pattern", "whole", "rest", "source_size", "target"))
    taken = _part_pass(sized, plan.select("_pattern", "rest"), n).join(_small(plan.drop("rest"), n), "_pattern")
    taken = taken.withColumn("taken", F.col("whole") * F.col("_size") + F.col("part"))
    return taken.select("doc_id", "sources", F.col("_size").alias("size"), "source_size", "target", "taken", *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(carry)])
