"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's special strings (one token each), normalised and pre-split as the
vocabulary's file says, and each piece is counted on its own: its symbols form a doubly linked list, a
heap holds the adjacent pairs that have a merge rank, and the lowest (rank, position) is popped again and
again; stale heap entries are skipped. A piece has as many tokens as it had symbols, less the merges made,
so no identifier is ever built. Pieces repeat, so each task remembers their counts.

The file at ``path`` is read on the driver; its merges, bounded by the vocabulary, are broadcast. Of normalisers it may
name Unicode forms, lower case and the replacement of white space by spaces; others raise an error. Letters newer than
Unicode 15.1 are cut and lower-cased by this interpreter's tables, which may differ from those of the library's build.

Cases: null counts as empty: no bytes, no tokens. Very long texts are counted whole. Repeated rows get a row
each; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
_MEMO_LIMIT = 500_000
_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print
    keep their own character, the others take the code points from 256 up in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What counting needs of a tokenizer file: merge ranks, symbols, word end, pattern, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = [s for s in steps.get("normalizers", [steps]) if s.get("pattern") != {"Regex": "\\s+"} or s.get("content") != " "]
    if unknown := [s["type"] for s in steps if s["type"] not in (*_FORMS, "Lowercase")]:
        raise ValueError(f"normalisers without support: {unknown}")
    splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return {
        "ranks": {(a, b): k for k, (a, b) in enumerate(pairs)},
        "symbols": set(model["vocab"]),
        "suffix": model["end_of_word_suffix"] or "",
        "pattern": splits[0]["pattern"]["Regex"],
        "special": [t["content"] for t in spec["added_tokens"]],
        # White space never gets into a piece, so which white space stands between pieces makes no difference.
        "normal": [s["type"] for s in steps],
    }


class MergeCounter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.ranks, self.suffix = vocabulary["ranks"], vocabulary["suffix"]
        self.known, self.bytes = vocabulary["symbols"], byte_symbols()
        # In the file's regular expressions \s is Unicode white space, without the separators U+001C to U+001F.
        self.pieces = regex.compile(vocabulary["pattern"].replace(r"[^\s", r"[^\p{White_Space}"))
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.normal = vocabulary["normal"]
        self.memo: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        units = [self.bytes[b] for b in text.encode("utf-8")]
        units[-1] += self.suffix
        units = [u for u in units if u in self.known]
        n = len(units)
        if n < 2:
            return n
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get((units[i], units[i + 1]))
            if rank is not None:
                heap.append((rank, i, units[i], units[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if units[i] is not None else n
            if j >= n or units[i] != left or units[j] != right:
                continue
            merges += 1
            units[i], units[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((units[i], units[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, units[i], units[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((units[h], units[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, h, units[h], units[i]))
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        plain, total, memo = text.isascii(), 0, self.memo
        for step in self.normal:
            if step == "Lowercase":  # letter by letter, so no final form of sigma
                text = (text.replace("Σ", "σ") if not plain and "Σ" in text else text).lower()
            elif not plain:
                text = unicodedata.normalize(step, text)
        for piece, k in Counter(self.pieces.findall(text)).items():
            n = memo.get(piece)
            if n is None:
                if len(memo) >= _MEMO_LIMIT:
                    memo.clear()
                n = self.piece(piece)
                if len(piece) <= 32:
                    memo[piece] = n
            total += n * k
        return total

    def __call__(self, text: str) -> int:
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(sent.value)
        for b in batches:
            tokens = [counter(t.as_py()) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["n_bytes"], pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
