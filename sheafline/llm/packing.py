"""Packing of tokenized documents into fixed windows.

Tokens come from a public tokenizer whose file is a parameter. A document is
cut into full windows and rests, and the rests are packed by multiway
differencing (Karmarkar and Karp): the two partial partitions with the largest
imbalance are merged, the largest sums of one against the smallest of the
other, until one partition with near-equal sums is left. While a sum exceeds
the capacity, the number of windows rises.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 4096
#: Rests are cut to at most this many tokens before packing.
LONGEST_REST = 2048
#: Rests in one packing group, on average.
GROUP = 2048
#: Entries of the table of words in each Python worker.
CACHE = 700_000
END_ID = 2

# The normalizer and the splitter of the tokenizer files that ``WordTokenizer`` can read.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_TAIL = b".,;:!?$%&*#\"()"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = f"{_PIECES}, sequence_id long, offset long"


class WordTokenizer(dict):
    """Token bytes (little-endian unsigned 32-bit ids) of texts, by way of a table of words that it keeps.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order. A word's ids do not depend on A-Z
    against a-z, and a closing run of punctuation is a token of its own; both
    keep the table small. The results are those of ``encode`` on the text. A
    tokenizer of which this does not hold is refused.
    """

    def __init__(self, path: str, size: int = CACHE):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        if parts["normalizer"] != NORMALIZER or parts["pre_tokenizer"] != SPLITTER or parts["post_processor"]:
            raise ValueError(f"{path} does not normalize and split as the table of words assumes")
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.most = size

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            # one run of letters that the normalizer leaves as it is: only the merges are left to do
            ids = [token.id for token in self.merge(text if text.isascii() else self.as_bytes(text)[0][0])]
        else:
            ids = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        core = word.rstrip(_TAIL)
        if core and core != word and core[-1:].isalpha():
            found = self[core] + self[word[len(core) :]]
        else:
            found = self._ids(word)
        self[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" in data:  # special tokens may stand in the text
            return self._ids(data)
        lower = data.lower()
        if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower.decode()):
            data = lower
        return b"".join(map(self.__getitem__, data.split()))


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, once for each Python worker, so that its words serve all tasks of the worker."""
    return WordTokenizer(path)


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, longest_rest: int = LONGEST_REST) -> DataFrame:
    """The pieces of every document: full windows, then rests of at most ``longest_rest`` tokens."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = word_tokenizer(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                while at < n:
                    length = window if n - at >= window else min(longest_rest, n - at)
                    for column, value in zip(out, (doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Parts of ``range(len(sizes))`` in ``k`` windows with near-equal sums; empty windows are left out."""
    pairs: dict[int, tuple[int, int]] = {}
    # a partition is a list of (-sum, node), the largest sum first
    heap = [(-size, i, [(-size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    node = order = len(sizes)
    while len(heap) > 1:
        one = heapq.heappop(heap)[2]
        other = heap[0][2]
        shared = len(one) + len(other) - k  # so many windows get a part of both
        if shared > 0:
            merged = one[:-shared] + other[:-shared]
            for (a, i), (b, j) in zip(one[-shared:], other[: -shared - 1 : -1], strict=True):
                pairs[node] = (i, j)
                merged.append((a + b, node))
                node += 1
        else:
            merged = one + other
        merged.sort()
        order += 1
        heapq.heapreplace(heap, (merged[0][0] - (merged[-1][0] if len(merged) == k else 0), order, merged))
    parts = []
    for _, top in heap[0][2] if heap else []:
        part, todo = [], [top]
        while todo:
            x = todo.pop()
            todo.extend(pairs[x]) if x in pairs else part.append(x)
        parts.append(sorted(part))
    return parts


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """``differencing`` with the least number of windows, from the total upwards, of which none exceeds ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        k += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, longest_rest: int = LONGEST_REST, group: int = GROUP) -> DataFrame:
    """Pack all documents into windows of at most ``window`` tokens.

    Returns a row per piece: doc_id, start (the document's tokens before it),
    length, ids_crc32, doc_tokens (with the end token), sequence_id, offset.
    Each token lies in exactly one piece; offsets are gapless from 0.

    A null or empty text is its end token alone. A null doc_id stays null.
    Repeated rows are packed each by itself. An empty table gives no rows.
    Columns besides doc_id and text are ignored. Rests go to packing groups by
    their places in the table of pieces, ``group`` of them on average, so a
    group's size grows neither with the input nor with rows that repeat; full
    windows, which need no packing, are numbered in groups of their own. Within a
    group, ties are broken by the pieces' order.
    """
    pieces = saved(cut_documents(docs, tokenizer_path, window, longest_rest))
    full = F.col("length") == window
    n_full, n_rests = pieces.select(F.count_if(full), F.count_if(~full)).first()
    groups, full_groups = (max(1, -(-n // group)) for n in (n_rests, n_full))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        length = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        whole = np.flatnonzero(length == window)
        sequence[whole] = np.arange(len(whole))
        rest = np.flatnonzero(length != window)
        for i, part in enumerate(near_equal_windows(length[rest].tolist(), window)):
            at = rest[part]
            sequence[at] = len(whole) + i
            offset[at] = np.concatenate([[0], np.cumsum(length[at])[:-1]])
        rows = rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]]
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return rows.assign(sequence_id=pd.Series(sequence + (int(key[0]) << 32)), offset=offset)

    hashed = F.xxhash64(F.monotonically_increasing_id())
    salted = F.when(full, groups + F.pmod(hashed, F.lit(full_groups))).otherwise(F.pmod(hashed, F.lit(groups)))
    return pieces.withColumn("_group", salted).groupBy("_group").applyInPandas(pack, _PACKED)
