"""Language-model scoring by a weighted backoff automaton.

The states of the automaton are n-grams shorter than ``ORDER``, the root being
the empty one. From the state h, a token w that training saw after h follows its
arc, of probability (c(hw) + M p(w)) / (c(h) + M), where p is the model of the
state without its oldest token, to the longest state that hw ends in. A token
that was not seen there follows the failure arc to that shorter state, of weight
M / (c(h) + M); at the root it is unknown, and unknown tokens together have
about the share of the words seen once. In all states the probabilities of all
known tokens and of an unknown one add up to 1. A text is scored in one pass
from left to right that carries the state and adds up the logarithms.

Counts cover all training tokens, and the whole automaton is too large for one
machine. Each piece of a few megabytes of documents asks for the counts of the
n-grams that occur in it: its request goes to the tasks that add up the counts,
split by key, and the answer comes back in the order of the request. From it
the piece makes the states and arcs that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix64, saved, utf8_column

ORDER = 3
#: M for n-grams of 2 tokens and more: so many tokens the shorter state's model counts for.
MASS = (0.0, 400.0, 5.0, 3.0)
FOLDS, HELD_FOLD = 7, 2
#: Bytes of text in a piece, unless one document has more, and in a block, on average.
PIECE_BYTES = 3 << 20
#: Tokens of the texts that one automaton is made for, unless one text has more.
AUTOMATON_TOKENS = 100_000
#: Requests are split by key into so many parts at least, and into one for each so many bytes of text.
PARTS, PART_BYTES = 64, 16 << 20
#: Bytes of a row group of the answers, whose rows are large.
ROW_GROUP = 16 << 20
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_FOLD) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % folds == fold


def tokens_of(array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of an Arrow column of texts: its words with A-Z lower-cased and, after each text, one end."""
    words, offsets = hashed_words(*utf8_column(array), fold=True)
    ends = np.zeros(len(offsets) - 1, dtype=np.int64) + offsets[1:]
    return np.insert(words, ends, _END), offsets + np.arange(len(offsets))


def ngrams(tokens: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to ``order`` the hash of the n-gram that ends at each token; before a text stand starts."""
    out, before = [tokens], tokens
    for n in range(2, order + 1):
        before = np.concatenate([[_START], before[:-1]])
        before[offsets[:-1]] = _START
        out.append(mix64(out[-1] * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(n)))
    return out


def _dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts, which are ranges of keys, that have some of the sorted keys, each with the places of its keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), slice(cuts[p], cuts[p + 1])


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys)) >> 1


def _planes(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then the next ones, and so on: small and sorted values compress well like this."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    """The reverse of ``_planes``."""
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts as compressed planes: most are small, which the codecs of shuffles and tables, without entropy coding, make little of."""
    import pyarrow as pa

    return pa.compress(_planes(counts), codec="zstd", asbytes=True)


def _from_squeezed(data: bytes, n: int, kind: str) -> np.ndarray:
    """The reverse of ``_squeezed`` for n counts."""
    import pyarrow as pa

    return _from_planes(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys of n-grams as the steps from one to the next."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    """The reverse of ``_packed``."""
    return np.cumsum(_from_planes(data, "<u8"), dtype=np.uint64)


class Automaton:
    """The states that the texts of a piece can reach, and the arcs that each of their tokens can take.

    grams: for n from 1 the n-gram that ends at each token, as the number of it
    among the distinct ones; first: the place of each distinct one's first
    occurrence; counts: how often training saw it. offsets: where texts begin.

    A token can take one arc from a state of each length, the one of the n-gram
    that ends in it, and only where training saw that: the arcs stand with the
    token, the longest state's first, and none has to be looked up.
    """

    def __init__(self, grams: list[np.ndarray], first: list[np.ndarray], counts: list[np.ndarray], offsets: np.ndarray, n_tokens: int, starts: float, unknown: float, mass: tuple[float, ...] = MASS):
        order = len(grams)
        begins = np.zeros(len(grams[0]), dtype=bool)
        begins[offsets[:-1]] = True
        # states: the root, the starts of a text (one for each length), then the known n-grams by length
        self.unknown, self.start = float(np.log10(unknown)), order - 1
        state = [np.zeros(1, np.int64)]
        lost, failure, length, made = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], order
        for n in range(1, order):
            lost.append(np.array([np.log10(mass[n] / (starts + mass[n]))]))
            failure.append(np.array([n - 1]))
            length.append(np.array([n]))
        for n in range(1, order):
            known = counts[n - 1] > 0
            state.append(np.where(known, made + np.cumsum(known) - 1, 0))
            shorter = np.zeros(len(known), np.int64) if n == 1 else state[n - 1][grams[n - 2][first[n - 1]]]
            lost.append(np.log10(mass[n] / (counts[n - 1][known] + mass[n])))
            failure.append(shorter[known])
            length.append(np.full(int(known.sum()), n))
            made += int(known.sum())
        arcs, shorter_p = [], None
        for n in range(1, order + 1):
            at, seen = first[n - 1], counts[n - 1] > 0
            if n == 1:
                source = np.zeros(len(at), np.int64)
                p = (1 - unknown) * counts[0] / max(1, n_tokens)
            else:
                history = grams[n - 2][at - 1]
                source = np.where(begins[at], n - 1, state[n - 1][history])
                left = np.where(begins[at], starts, counts[n - 2][history])
                p = (counts[n - 1] + mass[n - 1] * shorter_p[grams[n - 2][at]]) / (left + mass[n - 1])
            target = state[n] if n < order else state[n - 1][grams[n - 2][at]] if n > 1 else np.zeros(len(at), np.int64)
            weight = np.log10(p, out=np.zeros(len(p)), where=seen)
            own = grams[n - 1]
            arcs.append([np.where(seen, source, -1)[own].tolist(), weight[own].tolist(), target[own].tolist()])
            shorter_p = p
        self.arcs = list(zip(*(column for columns in reversed(arcs) for column in columns), strict=True))
        #: the length of the states that the arcs at each place of a token's arcs leave
        self.leaves = [n for n in reversed(range(order)) for _ in range(3)]
        self.lost, self.failure, self.length = (np.concatenate(x).tolist() for x in (lost, failure, length))

    def score(self, begin: int, end: int) -> float:
        """The log10 probability of the text from one token to another, by one pass from its start."""
        lost, failure, length, leaves = self.lost, self.failure, self.length, self.leaves
        state, total = self.start, 0.0
        for arcs in self.arcs[begin:end]:
            at = 0
            while arcs[at] != state:
                if length[state] == leaves[at]:  # this token has no arc from here: the failure arc leads to a shorter state
                    if not state:
                        total += self.unknown
                        break
                    total += lost[state]
                    state = failure[state]
                at += 3
            else:
                total += arcs[at + 1]
                state = arcs[at + 2]
        return total


def _pieces(batches: Iterator, piece_bytes: int) -> Iterator[tuple]:
    """Slices of a partition as (file, block, row of the first, texts, held): rows of one block that follow one another, up to ``piece_bytes`` of text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    now, begin, size, texts, held = None, 0, 0, [], []
    for batch in batches:
        files, blocks, rows = (batch.column(x).to_pylist() for x in ("file", "block", "row"))
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        at = 0
        for i, (key, n) in enumerate(zip(zip(files, blocks, strict=True), sizes, strict=True)):
            if key != now or size + n > piece_bytes:
                texts.append(batch.column("text").slice(at, i - at))
                held.append(batch.column("held").slice(at, i - at))
                if now is not None:
                    yield *now, begin, pa.concat_arrays(texts), pa.concat_arrays(held)
                now, begin, size, texts, held, at = key, rows[i], 0, [], [], i
            size += n
        texts.append(batch.column("text").slice(at))
        held.append(batch.column("held").slice(at))
    if now is not None:
        yield *now, begin, pa.concat_arrays(texts), pa.concat_arrays(held)


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, fold: int = HELD_FOLD, piece_bytes: int = PIECE_BYTES, stored: bool = False) -> DataFrame:
    """Score all documents by a model of those outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Tokens are the text's words with A-Z lower-cased, then one end.
    base_score sums log10((c + 1) / (N + V + 1)) over them; score is the
    automaton's log10 probability of the text.

    A null or empty text is its end alone. A null doc_id counts as an empty text
    for the fold and stays null. Rows that repeat a doc_id count and are scored
    each by itself. An empty table gives no rows; with no training document, N
    and V are 0 and all tokens are unknown. Only doc_id and text are read; whole
    texts are.

    Documents are told apart by their places in the files of a Parquet table,
    whatever tasks read them, so a lost executor changes nothing. stored says
    that docs is read straight from such a table; else it is written to one.
    The request of a piece goes out in at most as many rows as there are parts,
    and never in more than it has keys.
    """
    docs = docs.select("*") if stored else saved(docs.select("doc_id", "text"))
    size = F.octet_length(F.col("text").cast("string"))
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    block_rows = max(1, min(1 << 16, int(piece_bytes * n_docs / (n_bytes + 1)) if n_docs else 1))
    parts = max(PARTS, n_bytes // PART_BYTES)
    most = AUTOMATON_TOKENS
    place = F.col("_metadata.row_index")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), folds, fold).alias("held"),
        F.xxhash64("_metadata.file_path").alias("file"), F.floor(place / block_rows).cast("long").alias("block"), place.cast("long").alias("row"),
    )

    def request(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for file, block, begin, texts, held in _pieces(batches, piece_bytes):
            tokens, offsets = tokens_of(texts)
            training = np.repeat(~held.to_numpy(zero_copy_only=False), np.diff(offsets))
            for n, gram in enumerate(ngrams(tokens, offsets, order), 1):
                keys, at = np.unique(gram, return_inverse=True)
                counts = np.bincount(at, weights=training, minlength=len(keys)).astype("<i4")
                sent = [(p, n, file, block, begin, _packed(keys[own]), _squeezed(counts[own])) for p, own in _dealt(keys, parts)]
                kinds = *[pa.int64()] * 5, pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*sent, strict=True), kinds, strict=True)], ["part", "n", "file", "block", "begin", "keys", "counts"])

    asked = rows.drop("doc_id").mapInArrow(request, "part long, n long, file long, block long, begin long, keys binary, counts binary")

    def add_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked(x) for x in group["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_from_squeezed(x, len(k), "<i4") for x, k in zip(group["counts"], keys, strict=True)]), minlength=len(every))
        cuts = np.cumsum([0, *map(len, keys)])
        found = total[at].astype("<i8")
        out = group[["part", "n", "file", "block", "begin"]].assign(counts=[_squeezed(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        out["check"] = [_check(x) for x in keys]
        # the sums of the part stand in its first row
        out["total"] = [int(total.sum())] + [0] * (len(out) - 1)
        out["distinct"] = [int((total > 0).sum())] + [0] * (len(out) - 1)
        out["once"] = [int((total == 1).sum())] + [0] * (len(out) - 1)
        return out

    answers = saved(asked.groupBy("part", "n").applyInPandas(add_up, "part long, n long, file long, block long, begin long, counts binary, check long, total long, distinct long, once long"), ROW_GROUP)
    n_tokens, n_words, n_once = (int(x or 0) for x in answers.where("n = 1").agg(F.sum("total"), F.sum("distinct"), F.sum("once")).collect()[0])
    unknown = (n_once + 1) / (n_tokens + n_words + 1)
    # every training text was left by its start once; starts are counted as ends
    starts = docs.where(~held_out(F.col("doc_id"), folds, fold)).count()

    def piece_scores(texts, got: dict) -> dict:
        tokens, offsets = tokens_of(texts)
        grams, counts = [], []
        for n, gram in enumerate(ngrams(tokens, offsets, order), 1):
            keys, at = np.unique(gram, return_inverse=True)
            found = np.zeros(len(keys))
            for p, own in _dealt(keys, parts):
                values, check = got[p, n]
                if check != _check(keys[own]):
                    raise RuntimeError("the documents came out differently when read again")
                found[own] = _from_squeezed(values, len(keys[own]), "<i8")
            grams.append(at)
            counts.append(found)
        single, begin, scores, row = counts[0][grams[0]], offsets[:-1], [], 0
        while row < len(begin):  # an automaton for some texts at a time keeps its arcs few
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
            lo, hi = offsets[row], offsets[end]
            some = [np.unique(at[lo:hi], return_index=True, return_inverse=True) for at in grams]
            automaton = Automaton([at for _, _, at in some], [at for _, at, _ in some], [c[x] for c, (x, _, _) in zip(counts, some, strict=True)], offsets[row : end + 1] - lo, n_tokens, starts, unknown)
            scores += [automaton.score(a, b) for a, b in zip((offsets[row:end] - lo).tolist(), (offsets[row + 1 : end + 1] - lo).tolist(), strict=True)]
            row = end
        return {
            "n_tokens": np.diff(offsets),
            "n_known": np.add.reduceat((single > 0).astype(np.int64), begin),
            "train_tokens": np.full(len(begin), n_tokens),
            "base_score": np.add.reduceat(np.log10((single + 1) / (n_tokens + n_words + 1)), begin),
            "score": np.array(scores),
        }

    def score(texts, answer):
        import pyarrow as pa

        texts = texts.sort_by("row").combine_chunks()
        row = texts.column("row").to_numpy()
        answer = answer.sort_by("begin")
        begins, starts_at = np.unique(answer.column("begin").to_numpy(), return_index=True)
        cuts = [*np.searchsorted(row, begins).tolist(), len(row)]
        ends = [*starts_at[1:].tolist(), answer.num_rows]
        found = []
        for i, at in enumerate(starts_at.tolist()):
            some = answer.slice(at, ends[i] - at)
            got = {(p, n): (c, check) for p, n, c, check in zip(*(some.column(x).to_pylist() for x in ("part", "n", "counts", "check")), strict=True)}
            part = texts.column("text").slice(cuts[i], cuts[i + 1] - cuts[i]).combine_chunks()
            found.append(piece_scores(part.chunk(0) if isinstance(part, pa.ChunkedArray) else part, got))
        columns = {k: pa.array(np.concatenate([x[k] for x in found])) for k in found[0]}
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held")} | columns)

    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = answers.select("part", "n", "file", "block", "begin", "counts", "check")
    return rows.groupBy("file", "block").cogroup(answers.groupBy("file", "block")).applyInArrow(score, scored)
