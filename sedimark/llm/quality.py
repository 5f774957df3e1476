"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader.

A text becomes a sequence of tokens (words and runs of punctuation); a word's token tells whether it is all
capitals, and a word equal to one of the two tokens before it becomes a token of its own. Token unigrams and bigrams
are hashed into ``2 ** bits`` cells, and a text's score is the logistic of a sparse dot product: the mean
weight of its n-grams, scaled. Fitting uses FTRL-Proximal (per-coordinate rates, L1 and L2) on ``shards``
disjoint parts of a bounded sample of labelled rows, and averages the parts' weights; the model has at most
``2 ** bits`` numbers, so it is sent to every task.

Cases: null and empty texts have no n-grams and score the logistic of the bias. Long texts are scored whole.
Without labelled rows every score is 0.5. Repeated rows get a row each. Extra columns pass through
``accepted`` untouched and are ignored by ``quality_scores``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.sampling import labelled

BITS = 18
MAX_TRAIN_ROWS = 16_000
SHARDS = 8
EPOCHS = 3
SCALE = 24.0
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 1.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO_LIMIT = 400_000
_REPEAT = np.uint64(1 << 32)


class _Tokens(dict):
    """Token text to its 32-bit hash, remembered."""

    def __missing__(self, token: str) -> int:
        shape = "C" if len(token) > 1 and token.isupper() else "w"
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        word = token[0].isalnum() or token[0] == "_"
        self[token] = h = zlib.crc32((shape + token.lower()).encode()) & ~1 | word  # odd: a word
        return h


def ngram_cells(text: str, memo: _Tokens, bits: int = BITS) -> np.ndarray:
    """The cell of every unigram and bigram of ``text``, with repeats."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64)
    ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    same = np.zeros(len(ids), bool)
    np.equal(ids[1:], ids[:-1], out=same[1:])
    same[2:] |= ids[2:] == ids[:-2]
    ids[same & (ids & np.uint64(1) > 0)] = _REPEAT
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    shift, mixer = np.uint64(64 - bits), np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate((((ids + np.uint64(1)) * mixer) >> shift, (pairs * mixer) >> shift)).astype(np.int64)


def ftrl_fit(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, scale: float) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of FTRL-Proximal over ``rows`` of (cells, label)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        w = -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)
        return np.where(np.abs(zk) <= L1, 0.0, w)

    sparse = []
    for cells, label in rows:
        k, counts = np.unique(cells, return_counts=True)
        x = np.append(counts * (scale / max(1, len(cells))), 1.0)
        sparse.append((np.append(k, bias), x, label))
    for _ in range(epochs):
        for k, x, label in sparse:
            w = weights(k)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            nk = n[k]
            z[k] += g - (np.sqrt(nk + g * g) - np.sqrt(nk)) / ALPHA * w
            n[k] = nk + g * g
    w = weights(np.arange(len(z)))
    return w[:bias], float(w[bias])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
    bits: int = BITS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    scale: float = SCALE,
) -> tuple[np.ndarray, float]:
    """(weights, bias) learned from at most about ``max_rows`` of the rows that ``labels`` marks."""
    sample = labelled(docs, labels, label, id_col, text_col, max_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rows = _Tokens(), []
        for b in batches:
            for order, text, mark in zip(b["_order"].to_pylist(), b["text"].to_pylist(), b["label"].to_pylist()):
                rows.append((order, ngram_cells(text, memo, bits).astype(np.int32), int(mark)))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        w, bias = ftrl_fit([(c, m) for _, c, m in rows], bits, epochs, scale)
        k = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(w[k], bias), pa.float64())], ["cell", "weight"]
        )

    parts = sample.repartition(shards, F.pmod(F.col("_order"), F.lit(shards))).mapInArrow(fit, "cell long, weight double")
    # At most 2 ** bits + 1 rows reach the driver.
    rows = parts.groupBy("cell").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    fitted = max((r["n"] for r in rows if r["cell"] == -1), default=1)
    weights, bias = np.zeros(1 << bits, np.float32), 0.0
    for r in rows:
        if r["cell"] < 0:
            bias = r["w"] / fitted
        else:
            weights[r["cell"]] = r["w"] / fitted
    return weights, bias


def score_text(text: str | None, weights: np.ndarray, bias: float, memo: _Tokens, bits: int, scale: float) -> float:
    cells = ngram_cells(text or "", memo, bits)
    dot = float(weights[cells].sum(dtype=np.float64)) * scale / len(cells) if len(cells) else 0.0
    return 1.0 / (1.0 + float(np.exp(-np.clip(dot + bias, -35, 35))))


def quality_scores(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", scale: float = SCALE
) -> DataFrame:
    """(doc_id, score), one row per row of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        memo, bits = _Tokens(), int(len(weights)).bit_length() - 1
        for b in batches:
            scores = [score_text(t.as_py(), weights, bias, memo, bits, scale) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def accepted(
    docs: DataFrame,
    model: tuple[np.ndarray, float],
    threshold: float = THRESHOLD,
    text_col: str = "text",
    scale: float = SCALE,
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        memo, bits = _Tokens(), int(len(weights)).bit_length() - 1
        for b in batches:
            good = [score_text(t.as_py(), weights, bias, memo, bits, scale) >= threshold for t in b.column(place)]
            yield pc.filter(b, pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
