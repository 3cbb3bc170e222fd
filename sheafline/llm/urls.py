"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

All of it is DataFrame and SQL functions. The labelled table is small, so the
regression is trained in its dual form, one weight per labelled URL, by gradient
steps inside one row; its weights per n-gram bucket, of which there are
``BUCKETS`` at most, then score every URL without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
STEPS = 200
RATE = 0.5
DECAY = 0.002
#: A page is blocked only where the regression is this sure.
THRESHOLD = 0.9
#: No more labelled URLs than this are used for training (those with the smallest hashes).
MOST_LABELLED = 400

#: Rules: verdict, host with path. A rule holds for its host and every subdomain.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: A small labelled URL table: words of unwanted and of ordinary hosts, each put into URLs of several shapes.
UNWANTED = (
    "casino", "casino-royal", "online-casino", "win-jackpot", "slots", "poker-room", "bets", "sports-bets", "free-spins", "lucky-win",
    "adult", "adult-video", "xxx", "sex-cams", "porn-tube", "escorts", "cheap-meds", "pills-online", "viagra-pills", "cheap-replica",
    "spam", "spam-mail", "link-farm", "ads", "ads-server", "click-track", "tracker", "ad-click", "free-money", "payday-loans",
    "win-prize", "crack-keygen",
)
ORDINARY = (
    "news", "daily-herald", "library", "university", "museum", "weather", "city-council", "gardening", "recipes", "kitchen",
    "history", "physics", "math-notes", "travel", "railway", "open-data", "encyclopedia", "dictionary", "football-club", "music-school",
    "hospital", "parliament", "theatre", "cinema", "bookshop", "software-docs", "forum", "health-service", "astronomy", "the-times",
    "nation", "farmers",
)
SHAPES = ("https://{}.example.com/en/12.html", "http://www.{}.example.net/de/345", "https://blog.{}.example.org/fr/67/?page=2", "https://m.{}.com/es/8901#top")


def seed_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, unwanted): each word in two of the shapes."""
    rows = [(SHAPES[(i + j) % 4].format(word), unwanted) for words, unwanted in ((UNWANTED, 1), (ORDINARY, 0)) for i, word in enumerate(words) for j in (0, 1)]
    return spark.createDataFrame(rows, "url string, unwanted int")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of the 3- to 5-grams of host and of path, digits counting as one another."""
    marked = F.array(F.concat(F.lit("h^"), host, F.lit("$")), F.concat(F.lit("p^"), F.regexp_replace(path, "[0-9]", "0"), F.lit("$")))

    def grams(text: Column, n: int) -> Column:
        return F.when(
            F.length(text) >= n + 1,
            F.transform(F.sequence(F.lit(3), F.length(text) - n + 2), lambda i: F.concat(F.substring(text, 1, 1), F.substring(text, i - 1, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    all_grams = F.flatten(F.transform(marked, lambda text: F.concat(*[grams(text, n) for n in (3, 4, 5)])))
    return F.array_sort(F.array_distinct(F.transform(all_grams, lambda gram: F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int"))))


def logistic_weights(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row: ``weights``, the bias at 0 and the weight of bucket b at b + 1.

    Gradient steps on the mean log loss with weight decay, from zero. A row with
    a null url or label is left out. With no row left, all weights are 0.
    """
    known = labelled.where("url is not null and unwanted is not null").select("url", F.col("unwanted").cast("int").alias("unwanted"))
    known = known.distinct().orderBy(F.xxhash64("url"), "url", "unwanted").limit(MOST_LABELLED)
    rows = known.select("url", "unwanted", ngram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("grams"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "unwanted", "grams"))).alias("rows"))
    kernel = """
        transform(rows, r -> transform(rows, s ->
            1 + size(array_intersect(r.grams, s.grams)) / sqrt(greatest(1, size(r.grams)) * greatest(1, size(s.grams)))))"""
    solved = f"""
        aggregate(sequence(1, {steps}), transform(rows, r -> 0D), (dual, step) ->
            transform(dual, (own, i) -> own * (1 - {rate * decay}D) + {rate}D * (rows[i].unwanted
                - 1 / (1 + exp(-aggregate(zip_with(kernel[i], dual, (k, d) -> k * d), 0D, (sum, x) -> sum + x))))))"""
    # the exchanges of one row keep each step's result from being worked out anew inside the next one's loop
    one = one.where("size(rows) > 0").repartition(1).withColumn("kernel", F.expr(kernel)).repartition(1)
    one = one.select("rows", F.expr(solved).alias("dual")).repartition(1)
    each = one.select(F.explode(F.arrays_zip("rows", "dual")).alias("x")).select("x.rows.grams", "x.dual")
    parts = each.select(F.explode(F.expr("concat(array(struct(0 as slot, dual as part)), transform(grams, g -> struct(g + 1 as slot, dual / sqrt(size(grams)) as part)))")).alias("p"))
    parts = parts.select(F.col("p.slot").cast("long").alias("id"), "p.part")
    slots = labelled.sparkSession.range(buckets + 1).select("id", F.lit(0.0).alias("part"))
    summed = slots.unionByName(parts).groupBy("id").agg(F.sum("part").alias("weight"))
    return summed.agg(F.expr("transform(array_sort(collect_list(struct(id, weight))), x -> x.weight)").alias("weights"))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        here = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fits.append(F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every page's url: page_id, host, path, rule, score, verdict (allow or block).

    host and path are empty for a null url or one without ``://``; such a url
    fits no rule and has no n-grams, and is allowed. page_id may be null.
    Repeated rows are judged alike, each by itself. An empty table gives no
    rows. Columns besides page_id and url are not read. Without labelled rows
    every url that no rule fits is allowed.
    """
    weights = logistic_weights(labelled).scalar()
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), ngram_buckets(F.col("host"), F.col("path")).alias("grams"), weights.alias("w"))
    raw = F.expr("w[0] + aggregate(grams, 0D, (sum, g) -> sum + w[g + 1]) / sqrt(size(grams))")
    score = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(1 / (1 + F.exp(-raw)))
    judged = judged.withColumn("score", score)
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")
