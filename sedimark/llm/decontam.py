"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case word tokens. Fixed masks over a few neighbouring tokens say which of them a seed
looks at and which it ignores; the hashes of all masked windows of the benchmark are joined with those of
every document. A hit fixes an item and an alignment, which is then verified token by token: the document
is contaminated by the item if some stretch of the alignment has at least ``min_tokens`` tokens, begins and
ends with equal tokens, and differs in at most ``max_diff`` of them. The masks together hit every
stretch of 13 to 24 tokens with any substitutions of up to 20 % that the verification accepts. Items shorter than ``min_tokens`` must occur whole and unchanged.

The benchmark is taken in blocks of at most ``block_tokens`` tokens; a block's hashes and texts are
broadcast, and all documents are scanned once a block. No document is shuffled, so a passage that a third
of all documents share is a third of the results and no hot key.

Cases: null or empty texts have no tokens and are clean; so are items without tokens. Very long texts are
scanned whole. Repeated rows are searched each. An empty benchmark leaves every document clean; an empty documents table
gives an empty result. Extra columns are ignored, and pass through ``clean_documents``. Of several
alignments of an item in a document the one with most equal tokens counts, then the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MASKS = ("11101011", "110100111", "101000010111", "1100010111")
MIN_TOKENS = 13
MAX_DIFF = 0.2
BLOCK_TOKENS = 1_000_000

_WORD = re.compile(r"\w+")
_MEMO_LIMIT = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_HITS = 1 << 20


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode())
        return h


def token_hashes(text: str | None, memo: _Hashes) -> np.ndarray:
    tokens = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of ``h`` under ``mask``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(xxhash.xxh3_64_intdigest(mask.encode())))
    for at, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[at : at + n]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def best_stretch(equal: np.ndarray, min_tokens: int, max_diff: float) -> tuple[int, int] | None:
    """(start, end) of the longest stretch of at least ``min_tokens`` that begins and ends with equal
    tokens and has at most ``max_diff`` unequal ones; None where there is none."""
    at = np.flatnonzero(equal)
    if not len(at):
        return None
    # A stretch from at[i] to at[j] holds j - i + 1 equal tokens: (1 - max_diff) * length <= j - i + 1.
    key = (1 - max_diff) * at - np.arange(len(at))
    # The furthest j with a key of at most the bound is the last one whose least later key is.
    later = np.minimum.accumulate(key[::-1])[::-1]
    last = np.searchsorted(later, key + (max_diff + 1e-9), "right") - 1
    sizes = at[last] - at + 1
    i = int(np.argmax(sizes))
    return (int(at[i]), int(at[last[i]]) + 1) if sizes[i] >= min_tokens else None


class SeedIndex:
    """The seeds of one block of the benchmark, and its items for verification."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple = MASKS, min_tokens: int = MIN_TOKENS, max_diff: float = MAX_DIFF):
        memo = _Hashes()
        self.ids, self.masks, self.min_tokens, self.max_diff = [i for i, _ in items], list(masks), min_tokens, max_diff
        self.items = [token_hashes(t, memo) for _, t in items]
        short = sorted({len(h) for h in self.items if 0 < len(h) < min_tokens})
        self.masks += [m for m in ("1" * n for n in short) if m not in self.masks]
        self.tables = []
        for mask in self.masks:
            found, whose, where = [], [], []
            for k, h in enumerate(self.items):
                if len(h) >= min_tokens and mask in masks or len(h) < min_tokens and mask == "1" * len(h):
                    s = seeds(h, mask)
                    found.append(s)
                    whose.append(np.full(len(s), k))
                    where.append(np.arange(len(s)))
            found = np.concatenate(found) if found else np.empty(0, np.uint64)
            order = np.argsort(found, kind="stable")
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[found >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((found[order], *(np.concatenate(x)[order] if x else np.empty(0, int) for x in (whose, where)), sieve))

    def search(self, text: str | None, memo: _Hashes) -> list[tuple]:
        """(item_id, overlap, equal, doc_start, item_start) for each item that contaminates the text."""
        h = token_hashes(text, memo)
        alignments = np.empty(0, np.int64)
        for mask, (found, whose, where, sieve) in zip(self.masks, self.tables):
            if not len(found):
                continue
            mine = seeds(h, mask)
            at = np.flatnonzero(sieve[mine >> np.uint64(64 - _FILTER_BITS)])
            if not len(at):
                continue
            low, high = np.searchsorted(found, mine[at], "left"), np.searchsorted(found, mine[at], "right")
            # Repetitive texts hit often at few alignments, so hits are expanded in parts and kept once.
            cut = np.searchsorted(np.cumsum(high - low), np.arange(_HITS, int((high - low).sum()) + _HITS, _HITS))
            for a, b in zip([0, *(cut + 1)], [*(cut[:-1] + 1), len(at)]):
                n = (high - low)[a:b]
                k = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                alignments = np.union1d(alignments, (whose[k] << 36) + (np.repeat(at[a:b], n) - where[k] + (1 << 35)))
        best: dict[int, tuple] = {}
        for code in alignments.tolist():
            k, shift = code >> 36, (code & (1 << 36) - 1) - (1 << 35)
            item = self.items[k]
            if k in best and best[k][2] == len(item):
                continue  # no later alignment has more equal tokens
            start, end = max(0, -shift), min(len(item), len(h) - shift)
            equal = item[start:end] == h[start + shift : end + shift]
            if len(item) < self.min_tokens:
                stretch = (0, len(item)) if len(equal) == len(item) and equal.all() else None
            else:
                stretch = best_stretch(equal, self.min_tokens, self.max_diff)
            if stretch:
                a, b = stretch
                row = (self.ids[k], b - a, int(equal[a:b].sum()), start + shift + a, start + a)
                if k not in best or row[2] > best[k][2]:
                    best[k] = row
        return list(best.values())


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of about ``block_tokens`` tokens."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\w+")), F.lit(0))
    total = benchmark.agg(F.sum(words).alias("n")).collect()[0]["n"] or 0
    blocks = 1 + int(total) // block_tokens
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield [(r["id"], r["text"]) for r in rows.filter(F.col("block") == k).orderBy("id", "text").collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple = MASKS,
    min_tokens: int = MIN_TOKENS,
    max_diff: float = MAX_DIFF,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per contaminated row and item: doc_id, item_id, overlap, equal, doc_start, item_start (in tokens)."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    schema = f"doc_id {kind}, item_id {item_kind}, overlap int, equal int, doc_start int, item_start int"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    out = None
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_tokens):
        sent = docs.sparkSession.sparkContext.broadcast((items, masks, min_tokens, max_diff))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, memo = SeedIndex(*sent.value), _Hashes()
            for b in batches:
                found = [(k, *hit) for k, t in enumerate(b["_text"]) for hit in index.search(t.as_py(), memo)]
                ids = b["doc_id"].take(pa.array([f[0] for f in found], pa.int64()))
                item = pa.array([f[1] for f in found], item_type)
                rest = [pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([ids, item, *rest], ["doc_id", "item_id", "overlap", "equal", "doc_start", "item_start"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple = MASKS,
    min_tokens: int = MIN_TOKENS,
    max_diff: float = MAX_DIFF,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    place = docs.columns.index(text_col)
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_tokens):
        sent = docs.sparkSession.sparkContext.broadcast((items, masks, min_tokens, max_diff))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, memo = SeedIndex(*sent.value), _Hashes()
            for b in batches:
                yield pc.filter(b, pa.array([not index.search(t.as_py(), memo) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
