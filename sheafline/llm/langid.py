"""Language identification: known words first, then shorter and shorter character n-grams.

The model is fitted on a bounded sample of labelled documents: for every word
its log frequency in each language, and the same for the n-grams of words. A
word that the model knows counts by its own frequencies; another counts by its
n-grams of the greatest length of which any is known.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: Bounds of the labelled sample, in documents on average: of each language, and of all.
DOCUMENTS_PER_LANGUAGE = 2_500
DOCUMENTS = 100_000
LONGEST_GRAM = 4
#: Tasks that cut the words of the sample into n-grams.
FIT_PARTS = 32
#: A word must be seen this often in the sample to be known.
LEAST_COUNT = 2
SMOOTHING = 0.1
#: Words that count as evidence at most: the score of a longer text is that of so many words like its mean.
EVIDENCE = 25
#: Unseen words that a Python worker keeps, and the numbers that it keeps for them.
CACHE, CACHED_NUMBERS = 200_000, 4_000_000
FOLDS, HELD_FOLD = 5, 0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_FOLD) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % folds == fold


class Frequencies:
    """Log frequencies by language of words or n-grams.

    entries: for each name its languages (numbers) and its counts in them. Only
    those are kept; where a name was not seen in a language, its log frequency
    there is ``base``, from the smoothing alone.
    """

    def __init__(self, entries: list[tuple[str, list[int], list[int]]], languages: int):
        self.place = {name: i for i, (name, _, _) in enumerate(entries)}
        self.ends = np.cumsum([0, *(len(langs) for _, langs, _ in entries)])
        self.langs = np.array([x for _, langs, _ in entries for x in langs], dtype=np.int32)
        counts = np.array([x for _, _, counts in entries for x in counts], dtype=np.float64)
        totals = np.bincount(self.langs, weights=counts, minlength=languages) + SMOOTHING * len(entries)
        self.base = np.log(SMOOTHING / totals) if entries else np.zeros(languages)
        self.above = (np.log(counts + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32)

    @functools.cached_property
    def _lists(self) -> tuple[list, list, list]:
        return self.ends.tolist(), self.langs.tolist(), self.above.tolist()

    def mean(self, places: list[int]) -> np.ndarray:
        """The mean of the log frequencies of the few names at ``places``, for every language."""
        ends, langs, above = self._lists
        row, share = self.base.copy(), 1 / len(places)
        for x in places:
            for at in range(ends[x], ends[x + 1]):
                row[langs[at]] += share * above[at]
        return row

    def total(self, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The sum over the names at ``places`` of their log frequencies, each ``times`` over, for every language."""
        begin, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return times.sum() * self.base + np.bincount(self.langs[at], weights=np.repeat(times, sizes) * self.above[at], minlength=len(self.base))


class LanguageModel:
    """Frequencies of words and of n-grams (by length, from 1), and what a text scores under them."""

    def __init__(self, languages: list[str], words: Frequencies | None = None, grams: list[Frequencies] | None = None):
        self.languages, self.words, self.grams = languages, words, grams or []
        self.unseen: dict[str, np.ndarray] = {}
        self.cached = min(CACHE, CACHED_NUMBERS // max(1, len(languages)))

    def backed_off(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's known n-grams of the greatest length that has any."""
        marked = f" {word} "
        for n in range(len(self.grams), 0, -1):
            place = self.grams[n - 1].place
            known = [x for i in range(len(marked) - n + 1) if (x := place.get(marked[i : i + n])) is not None]
            if known:
                return self.grams[n - 1].mean(known)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the score, from 0 to 1."""
        counts = Counter(_WORD.findall(text.lower())) if text else {}
        if not self.languages or not any(c.isalpha() for word in counts for c in word):
            return UNKNOWN, 0.0
        place = self.words.place.get
        at = np.fromiter((place(word, -1) for word in counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        known = at >= 0
        total = self.words.total(at[known], times[known])
        if not known.all():
            rows = []
            for word in compress(counts, ~known):
                row = self.unseen.get(word)
                if row is None:
                    if len(self.unseen) >= self.cached:
                        self.unseen.clear()
                    row = self.unseen[word] = self.backed_off(word)
                rows.append(row)
            total = total + times[~known] @ np.array(rows)
        n = times.sum()
        likely = np.exp((total - total.max()) / n * min(n, EVIDENCE))
        best = int(np.argmax(likely))
        return self.languages[best], float(likely[best] / likely.sum())


def fit(labelled: DataFrame) -> LanguageModel:
    """A model from rows (doc_id, text, lang).

    Of each language the documents with the smallest hashes of doc_id and text
    are used, ``DOCUMENTS_PER_LANGUAGE`` of them on average, or as many as make
    ``DOCUMENTS`` in all if there are very many languages; a language with fewer
    is used whole, and none is left out. Rows with a null text or lang are left
    out. All words and n-grams that occur ``LEAST_COUNT`` times in the sample are
    kept. What comes to the driver is the model, bounded by the sample.
    """
    labelled = labelled.where("text is not null and lang is not null")
    sizes = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([])
    quota = min(DOCUMENTS_PER_LANGUAGE, DOCUMENTS / len(languages))
    number = {lang: i for i, lang in enumerate(languages)}
    shares = labelled.sparkSession.createDataFrame([(r["lang"], number[r["lang"]], min(1.0, quota / r["count"])) for r in sizes], "lang string, l int, share double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.coalesce("doc_id", F.lit(-1)), "text"), 11) / float(2**53)
    sample = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    words = sample.select("l", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("x"))
    words = saved(words.groupBy("x", "l").agg(F.count("*").alias("n")).repartition(FIT_PARTS))  # few bytes, but much to do for each
    # n-grams of all lengths in one pass; words have the mark 0
    placed = words.select("l", "n", F.concat(F.lit(" "), "x", F.lit(" ")).alias("x")).select("*", F.explode(F.expr("sequence(1, length(x))")).alias("i"))
    cut = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("x", F.col("i"), F.lit(k)).alias("g")) for k in range(1, LONGEST_GRAM + 1)]))
    grams = placed.select("l", "n", cut).where("length(g) = k")  # what is cut off by the end of the word is shorter
    every = words.select(F.lit(0).alias("k"), "x", "l", "n").unionByName(grams.select("k", F.col("g").alias("x"), "l", "n"))
    every = every.groupBy("k", "x", "l").agg(F.sum("n").alias("n")).groupBy("k", "x").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("l", "n"))).alias("seen"))
    found = every.where(F.col("total") >= LEAST_COUNT).orderBy("k", "x").select("k", "x", F.col("seen.l").alias("langs"), F.col("seen.n").alias("counts")).toArrow()
    entries: list[list[tuple]] = [[] for _ in range(LONGEST_GRAM + 1)]
    for k, *entry in zip(*(found.column(c).to_pylist() for c in ("k", "x", "langs", "counts")), strict=True):
        entries[k].append(tuple(entry))
    words_of, *grams_of = (Frequencies(some, len(languages)) for some in entries)
    return LanguageModel(languages, words_of, grams_of)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document, from the text alone.

    lang_pred is ``und`` and the score 0 where the text is null or has no letter,
    or where no language was learned. A tie goes to the language whose name sorts
    first. Repeated rows are judged alike, each by itself; a null doc_id stays
    null; an empty table gives no rows; other columns are not read. Whole texts
    are read, of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(judge, "doc_id long, lang_pred string, score double")


def language_of(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of a column of texts, as ``identify`` has it."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(text) for text in texts], columns=["lang_pred", "score"])

    return judge(text.cast("string"))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
