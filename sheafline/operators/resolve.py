"""Entity resolution of mentions in texts: containment, then fuzzy, then by package or first name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import found
from ..functions.names import normalize_mention, package_code, telling_words
from .contain import BITS, contained_pairs
from .lineage import cut, shuffled
from .works import top_row

# Thresholds of the fuzzy layer.
LEAST_RATIO, CONFIDENT, MARGIN, LAST_RESORT, PER_WORD = 60, 78, 5, 65, 5


def _indel_ratio(a: str, b: str) -> float:
    """100 less the share of insertions and deletions between two strings (longest common subsequence)."""
    if not a and not b:
        return 100.0
    places = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(b)) - 1
    for c in a:
        match = row & places.get(c, 0)
        row = (row + match | row - match) & (1 << len(b)) - 1
    common = len(b) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_similarity(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's shared and own words; 100 if one side's words are all shared."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    shared = " ".join(sorted(one & two))
    if shared and (one <= two or two <= one):
        return 100.0
    left, right = (" ".join(filter(None, (shared, " ".join(sorted(x))))) for x in (one - two, two - one))
    return max([_indel_ratio(left, right), *([_indel_ratio(shared, left), _indel_ratio(shared, right)] if shared else [])])


def token_set_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([token_set_similarity(x or "", y or "") for x, y in zip(one, two, strict=True)])

    return ratio(a, b)


def _normalized(mentions: DataFrame) -> DataFrame:
    """qid and the normalized text, which ``resolve`` has worked out already."""
    return mentions.select("qid", "_text") if "_text" in mentions.columns else mentions.select("qid", normalize_mention(F.col("text")).alias("_text"))


def _named(entities: DataFrame) -> DataFrame:
    """entity and its normalized name, which ``resolve`` has worked out already."""
    return entities.select("entity", "_name") if "_name" in entities.columns else entities.select("entity", normalize_mention(F.col("entity")).alias("_name")).where("_name <> ''").distinct()


def contained(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Layer 1: qid and the longest entity whose normalized name is part of the normalized text."""
    m, e = _normalized(mentions), _named(entities)
    pairs = contained_pairs(m.select(F.col("qid").alias("id"), F.col("_text").alias("text")), e.select(F.col("_name").alias("name")))
    hits = cut(pairs).select(F.col("id").alias("qid"), F.col("name").alias("_name")).join(e, "_name")
    return top_row(hits, ["qid"], [F.length("entity").desc(), F.col("entity")]).select("qid", "entity")


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)).cast("int")


def _words_like(words: DataFrame) -> Column:
    """The bits on which the words (column w) fall, 32 in each long: at most 1024 rows, whatever the number of words."""
    bits = words.select(_bit(F.col("w")).alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("set"))
    known = [0] * (BITS // 32)
    for row in bits.collect():
        known[row["at"]] = row["set"]
    return F.expr("array(" + ",".join(f"{x}L" for x in known) + ")")


def fuzzy(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Layer 2 candidates: qid, entity, score and place, the candidate's among those of the mention's text, from the best. Only pairs
    with a telling word in common are compared (an equi-join on words), and texts that repeat are compared once.

    A mention's word that falls on no bit of an entity's word is in no entity, and does not leave its task.
    """
    m, e = _normalized(mentions), _named(entities)
    words_e = e.select("entity", F.explode(telling_words(F.col("_name"))).alias("w"))
    known = _words_like(words_e)
    some = F.filter(telling_words(F.col("_text")), lambda w: F.getbit(F.element_at(known, F.shiftright(_bit(w), 5) + 1), _bit(w).bitwiseAND(F.lit(31))) == 1)
    # an outer explode: below an inner one Spark puts a condition that works the words out once more
    said = cut(m.select("qid", F.col("_text").alias("_said"), F.explode_outer(some).alias("w")).where("w is not null"))
    shared = said.select("_said", "w").distinct().join(shuffled(words_e), "w").groupBy("_said", "entity").agg(F.count("*").alias("overlap"))
    pairs = shared.join(shuffled(e), "entity").withColumn("_ratio", token_set_ratio(F.col("_name"), F.col("_said")))
    scored = pairs.where(F.col("_ratio") >= LEAST_RATIO).select("_said", "entity", (F.col("_ratio") + PER_WORD * F.col("overlap")).alias("score"))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("_said").orderBy(F.col("score").desc(), "entity")))
    return said.select("qid", "_said").distinct().join(shuffled(placed), "_said").select("qid", "entity", "score", "place")


def confident(candidates: DataFrame) -> DataFrame:
    """The best candidate where it is good enough and far enough ahead of the second."""
    ranked = candidates.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity"))).alias("r"))
    best, second = -F.col("r")[0]["s"], -F.try_element_at("r", F.lit(2))["s"]
    ahead = F.coalesce(best - second >= MARGIN, F.lit(True))
    return ranked.where((best >= CONFIDENT) & ahead).select("qid", F.col("r")[0]["entity"].alias("entity"))


def find_clients(queries: DataFrame, clients: DataFrame) -> DataFrame:
    """qid, client: the first client by name whose name, in any case, is part of the query or has the query as a part; null if none.

    queries: qid, text. clients: client. A null or empty query finds nothing.
    """
    asked = queries.select("qid", F.lower(F.trim("text")).alias("text")).where("text <> ''")
    known = clients.where("client <> ''").select("client", F.lower("client").alias("low")).distinct()
    inside = contained_pairs(asked.select(F.col("qid").alias("id"), "text"), known.select(F.col("low").alias("name"))).select(F.col("id").alias("qid"), F.col("name").alias("low"))
    around = contained_pairs(known.select(F.col("low").alias("id"), F.col("low").alias("text")), asked.select(F.col("text").alias("name"))).select(F.col("id").alias("low"), F.col("name").alias("text"))
    around = around.join(asked, "text").select("qid", "low")
    best = inside.unionByName(around).join(known, "low").groupBy("qid").agg(F.min("client").alias("client"))
    return queries.select("qid").join(best, "qid", "left")


def shortlist(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates of each mention, for a disambiguator."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity"))), 1, n)
    return candidates.groupBy("qid").agg(F.transform(best, lambda x: x["entity"]).alias("shortlist"))


def by_package(mentions: DataFrame, certs: DataFrame) -> DataFrame:
    """Layer 3: the client of the package that is named, by the smallest doc_id."""
    known = certs.where("client_name is not null and package_code is not null")
    clients = known.groupBy(F.lower("package_code").alias("_p")).agg(F.min_by("client_name", "doc_id").alias("entity"))
    return mentions.select("qid", F.lower(package_code(F.col("text"))).alias("_p")).join(clients, "_p").select("qid", "entity")


def by_first_name(mentions: DataFrame, certs: DataFrame) -> DataFrame:
    """Layer 3, where no package helps: the client of the first work led by someone whose first name, of four letters or more, is named."""
    first_name = F.lower(found(F.col("project_lead"), r"^([A-Za-z]{4,})"))
    leads = certs.where("client_name is not null").select(first_name.alias("_w"), "client_name", "doc_id").where("_w is not null")
    leads = leads.groupBy("_w").agg(F.min_by("client_name", "doc_id").alias("entity"), F.min("doc_id").alias("_d"))
    said = mentions.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{4,})\b"), F.lit(1)))).alias("_w"))
    return said.join(leads, "_w").groupBy("qid").agg(F.min_by("entity", "_d").alias("entity"))


def normalized(mentions: DataFrame) -> DataFrame:
    """The mentions with ``_text``, dealt out first: a small file of very many mentions is read by one task, which would then hold all that is found."""
    return mentions.repartition("qid").withColumn("_text", normalize_mention(F.col("text")))


def found_entities(mentions: DataFrame, entities: DataFrame, certs: DataFrame | None = None, choices: DataFrame | None = None) -> DataFrame:
    """qid, entity and layer of the mentions for which ``resolve`` finds an entity: one row for each such qid.

    mentions: as for ``resolve``, or what is kept of ``normalized``, which then serves several calls.
    """
    candidates: list[DataFrame] = []
    # names are told apart before they are normalized, for a condition on what is made of them would move down to all rows
    given = cut(entities.select("entity").distinct())
    entities = cut(_named(given))

    def scored(left: DataFrame) -> DataFrame:
        if not candidates:
            # the layers ask for the best and the second alone
            candidates.append(cut(fuzzy(left, entities).where("place <= 2")))
        return candidates[0].join(shuffled(left.select("qid").distinct()), "qid", "left_semi")

    layers = [(1, lambda left: contained(left, entities)), (2, lambda left: confident(scored(left)))]
    if certs is not None:
        layers += [(3, lambda left: by_package(left, certs)), (3, lambda left: by_first_name(left, certs))]
    if choices is not None:
        layers.append((4, lambda left: choices.join(left, "qid", "left_semi").join(given, "entity").groupBy("qid").agg(F.min("entity").alias("entity"))))
    layers.append((5, lambda left: top_row(scored(left).where(F.col("score") >= LAST_RESORT), ["qid"], [F.col("score").desc(), F.col("entity")]).select("qid", "entity")))
    left = mentions if "_text" in mentions.columns else cut(normalized(mentions))
    every = None
    for number, layer in layers:
        hits = cut(layer(left).select("qid", F.col("entity").cast("string").alias("entity"), F.lit(number).alias("layer")))
        if every is None:
            every = hits
        if hits.isEmpty():
            continue  # what is left is as it was, and is not written again
        every = hits if every is hits else every.unionByName(hits)
        if number == layers[-1][0]:
            break
        left = cut(left.join(shuffled(hits), "qid", "left_anti"))
        if left.isEmpty():
            break
    return every


def resolve(mentions: DataFrame, entities: DataFrame, certs: DataFrame | None = None, choices: DataFrame | None = None) -> DataFrame:
    """qid, entity and layer (1, 2, 3, 4 or 5; null where nothing is found) of every mention.

    mentions: qid, text. entities: entity. certs (client_name, package_code, project_lead, doc_id) allow layer 3,
    which finds clients by the package, or by a lead's first name of four letters or more; leave it out when
    resolving others. choices: qid, entity of an outside disambiguator (layer 4), taken only if it is an entity.
    The last resort is the best fuzzy candidate above a lower bound.

    A layer gets only the mentions that those before it left, and none is worked out when nothing is left: what
    containment finds is never compared letter by letter. What a layer found and left is kept in the shared folder.
    A qid that repeats is one mention, of which any text may decide.
    """
    every = found_entities(mentions.select("qid", "text"), entities, certs, choices)
    return mentions.select("qid").join(shuffled(every), "qid", "left").select("qid", "entity", "layer")
