"""Periodic runs of words, by masking on repeated k-grams and a Main-Lorentz search of what survives.

A run is a stretch of words with smallest period ``q`` and at least ``max(min_words, min_power * q)`` words that no
neighbouring word extends with that period. All but the first ``q`` words of it are repeats and are dropped.

A run of ``n`` words overlaps itself, moved by its period, in ``n - q`` words. That is never less than
``k = min_words - min_words // min_power``, so every word of a run stands in a k-gram that occurs twice in its document. Words
outside of such k-grams cannot join a run: they are masked, and the stretches between them are searched one by one. The search
halves a stretch again and again; a run that crosses a middle has at least half of what it must have on one side, so it shows as
words that are equal one period apart beside the middle. For every middle of a level and every period at once, equal g-grams find
the candidates (``g`` is what half of a shortest run overlaps), and common extensions on ranks of 2, 4, 8, ... words, which are
exact, give their ends. Work is n log n comparisons on arrays for a text of n words.

Cases: null, empty and blank texts have no words and no run. Very long texts are read whole, one text in one task. Repeated rows get
a row each; a null id is an id like any other; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
MIN_POWER = 3
WORD = r"[^\x20\x09-\x0D]+"


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram; equal k-grams have equal hashes."""
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out, done = mixed ^ (mixed >> np.uint64(29)), 1
        while done < k:
            step = min(done, k - done)
            out = out[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (out[step:] ^ (out[step:] >> np.uint64(31)))
            done += step
    return out


def surviving(codes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The stretches (start, end) of words that stand in a k-gram which occurs twice; a superset where hashes collide."""
    if len(codes) <= k:
        return []
    hashes = _windows(codes, k)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    marks = np.zeros(len(codes) + 1, np.int64)
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    marks[at] += 1
    marks[at + k] -= 1
    inside = np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))


class _Extensions:
    """Common extensions of pairs of places in one stretch, on the ranks of its 1-, 2-, 4-, ... grams."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, self.ranks = n, [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 << (len(self.ranks) - 1) <= n:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            self.ranks.append(np.unique(last[:-step] * n + last[step:], return_inverse=True)[1].astype(np.int64))

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the grams of ``length`` words at a and b (a < b) are equal; False where one does not fit."""
        level = length.bit_length() - 1
        rank, step = self.ranks[level], length - (1 << level)
        fits = (a >= 0) & (b + length <= self.n)
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        return fits & (rank[a] == rank[b]) & (rank[a + step] == rank[b + step])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (a < b) on are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            fits = b < len(rank)
            ok = fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)])
            step = ok.astype(np.int64) << level
            a, b, out = a + step, b + step, out + step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words just before a and before b (a < b) are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[level], 1 << level
            fits = a >= size
            ok = fits & (rank[np.where(fits, a - size, 0)] == rank[np.where(fits, b - size, 0)])
            step = ok.astype(np.int64) << level
            a, b, out = a - step, b - step, out + step
        return out


#: Pairs of a middle and a period that are looked at together.
_CHUNK = 1 << 20


def stretch_runs(words: np.ndarray, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, period, length) of the runs of one stretch, by start and period."""
    n = len(words)
    if n < min_words:
        return []
    ext = _Extensions(words)
    # On one side of a middle a run has half of its words or more; less one period, that many are equal beside the middle.
    gram = max(1, min(-(-max(min_words, min_power * q) // 2) - q for q in range(1, min_words + 1)))
    found: dict[tuple[int, int], int] = {}
    block = n
    while True:
        half = block // 2
        middles = np.arange(half, n, block) if block < n else np.array([half])
        # A run that crosses no middle of the level before is no longer than that level's blocks.
        longest = min(n, 2 * block) // min_power
        for low in range(1, longest + 1, max(1, _CHUNK // len(middles))):
            periods = np.arange(low, min(longest + 1, low + max(1, _CHUNK // len(middles))))
            m, p = (x.ravel() for x in np.meshgrid(middles, periods, indexing="ij"))
            for a, b in ((m, m + p), (m - p - gram, m - gram)):
                hit = ext.same(a, b, gram)
                a, b, q = a[hit], b[hit], p[hit]
                if not len(a):
                    continue
                start, length = a - ext.backward(a, b), b + ext.forward(a, b)
                length -= start
                good = length >= np.maximum(min_words, min_power * q)
                for s, size, period in zip(start[good].tolist(), length[good].tolist(), q[good].tolist()):
                    if period < found.get((s, size), n + 1):
                        found[s, size] = period
        if block < min_words:  # every run crosses one of these middles
            break
        block = -(-block // 2)
    return sorted((s, q, size) for (s, size), q in found.items())


def runs_of(words: list, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of a list of words, by start and period."""
    if len(words) < min_words:
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    out = []
    for a, b in surviving(codes, min_words - min_words // min_power):
        number: dict = {}
        exact = np.fromiter(map(number.setdefault, words[a:b], count()), np.int64, b - a)
        out += [(a + s, q, size) for s, q, size in stretch_runs(exact, min_words, min_power)]
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> DataFrame:
    """(doc_id, runs, collapsed): one row per row of ``docs``.

    ``runs`` are structs (start, period, length) by start and period; ``collapsed`` is the text of the words that stay, joined by
    spaces. A run has three periods at least: two would not show beside a middle.
    """
    if min_power < 3 or min_words < 2 * min_power:
        raise ValueError("runs have three periods or more, and at least twice as many words")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
        for b in batches:
            runs, texts = [], []
            for text in b["_text"]:
                words = (text.as_py() or "").encode().split()
                found = runs_of(words, min_words, min_power)
                runs.append([dict(zip(("start", "period", "length"), r)) for r in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(runs, pa.list_(run)), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, runs array<struct<start: bigint, period: bigint, length: bigint>>, collapsed string")


def run_summary(found: DataFrame) -> DataFrame:
    """Digest columns of ``periodic_runs``: the number of runs, the run of the greatest length in periods, and digests of runs and text."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start: bigint, period: bigint, length: bigint>"),
        # Length over period, compared as products; runs come by start and period, so of equal ones the first stays.
        lambda kept, r: F.when(kept.isNull() | (r["length"] * kept["period"] > kept["length"] * r["period"]), r).otherwise(kept),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The texts of ``docs`` with the end of one in ten made periodic, by the CRC of its id: words to search for runs in.

    With h the CRC of the id in decimal and g = h // 10, a text of n words with h % 10 = 0 repeats the words from
    a = g % n on with the period 1 + (n - a) // (3 + g % 8). A text with a null id stays as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    # One step over a list of one element binds the words, which else were searched for at every use.
    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeat(w), " ")).otherwise(""))
    return F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.get(tail, F.lit(0))).otherwise(F.col(text_col))
