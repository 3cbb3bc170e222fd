"""Fill-in-the-middle: a text's middle is moved behind its prefix and suffix, between marks.

Units come from the ``Split`` pre-tokenizer of the tokenizers library, with every
match of a pattern isolated; nothing is trained. It gives the code-point offset
of each unit: the number of offsets is the text's length in units, and the
offsets at two drawn ranks are where the text is cut.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of A-Z and a-z, or any other code point. Together the two match everything, so units leave no gaps.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that stay plain, and of the others those that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points that are split at a time, which bounds the list of matches.
SLAB = 4096

_SAME_UNIT = re.compile("[A-Za-z]+")


def unit_starts(text: str, split) -> np.ndarray:
    """Where the units of ``text`` start, in code points; ``split`` is a pre-tokenizer.

    A text is read in slabs, each prolonged to the end of the unit that it would cut.
    """
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = at + SLAB
        if rest := _SAME_UNIT.match(text, end - 1):
            end = rest.end()
        found.append(np.array([place[0] for _, place in split(text[at:end])], np.int64) + at)
        at = end
    return np.concatenate(found)


def _drawn(key: Column, place: int) -> Column:
    """The ``place``-th group of eight hexadecimal digits of a key, from 0, as a number."""
    return F.conv(F.substring(key, 8 * place + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """Each text with its middle moved to the end, or as it is.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and output. The ends of prefix and
    middle are drawn from 0 to n units. psm is prefix, suffix and middle behind
    their marks, spm suffix, prefix and middle. A text stays plain if it is empty,
    has one of the marks in it or is drawn to be, ``PLAIN`` in a hundred.

    All draws come from the SHA-256 of seed:doc_id, so that a rerun makes the
    same cuts; rows that repeat a doc_id draw alike, each for its own text. A
    null doc_id draws as an empty one and stays null. A null text is empty. An
    empty table gives no rows. Only doc_id and text are read. There is no shuffle:
    a row is done where it is read, and its text stays in the JVM, which gets the
    two cuts alone from Python.
    """

    @F.pandas_udf("n long, first long, second long")
    def cuts(text: pd.Series, one: pd.Series, other: pd.Series) -> pd.DataFrame:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(PATTERN), "isolated").pre_tokenize_str
        out = np.zeros((len(text), 3), np.int64)
        for row, (t, a, b) in enumerate(zip(text, one, other, strict=True)):
            starts = unit_starts(t, split)
            ends = np.append(starts, len(t))[sorted((a % (len(starts) + 1), b % (len(starts) + 1)))]
            out[row] = len(starts), *ends
        return pd.DataFrame(out, columns=["n", "first", "second"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id"), text.alias("text"), key.alias("key"))
    rows = rows.select("doc_id", "text", "key", cuts("text", _drawn(F.col("key"), 0), _drawn(F.col("key"), 1)).alias("cut"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (_drawn(F.col("key"), 2) % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(_drawn(F.col("key"), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring("text", F.lit(1), first))
    middle = F.concat(F.lit(MIDDLE), F.substring("text", first + 1, second - first))
    suffix = F.concat(F.lit(SUFFIX), F.substring("text", second + 1, F.length("text")))
    made = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "text", "cut", form.alias("form")).select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, F.col("cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        made.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no mark stands in a text that is not plain, so the marks part it exactly."""
    parts = F.split(output, "|".join(re.escape(mark) for mark in (PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    moved = F.when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).otherwise(moved)


#: The same from the definition: units by a pattern, lengths added up.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
        ('0x' || k[1:8])::UBIGINT AS h1, ('0x' || k[9:16])::UBIGINT AS h2, ('0x' || k[17:24])::UBIGINT AS h3, ('0x' || k[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a+1:b], '') AS m, array_to_string(units[b+1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""
