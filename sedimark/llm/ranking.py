"""Ranked lexical search: the best documents for each of many query items, by a threshold-seeded join.

Items and documents meet on terms, and a document's score for an item is a sum of impacts of the terms that they share. Four steps
spare most of that join:

1. One scan of the texts writes a forward index: each document with its length and its counts of the items' terms.
2. Per term the k-th largest impact is stored. A term of an item gives at least k documents that impact, so the largest of them bounds the
   item's k-th score from below: the seed of its threshold.
3. With the terms of an item by falling largest impact, those at the end whose largest impacts together stay below the threshold
   cannot lift a document into the result alone. They are pruned: only the terms before them generate candidates.
4. Candidates whose impacts so far and all that the pruned terms could add stay below the threshold go; the others are
   scored exactly, in 64-bit integers, on all terms. A task raises its thresholds to the k-th score that it has itself.

Documents are never shuffled by term, so a frequent term is no hot key; what is shuffled is at most k rows a task and item. Items are taken in
blocks of at most ``block_terms`` terms, whose tables are broadcast; a block costs one scan of the texts.

Terms are ASCII letters and digits, lower-cased, and all signs beyond ASCII, read from the whole text.

Cases: null and empty texts have no terms; such documents do not count and are in no result, such items have none. Equal scores go by id,
nulls first. Repeated rows of documents count and rank each; repeated items are ranked once. Extra columns are ignored. Empty tables
give an empty result.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sedimark.storage import staged

TOP = 50
BLOCK_TERMS = 1 << 18
#: Terms of an item whose k-th impact is stored, those of most weight among the terms of at least k documents.
SEEDS = 4
#: Postings, or terms of candidates, that a task looks at together.
_PART = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.encode().translate(_FOLD).split() if text else []


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score: its term's weight times the damped count, in a document of ``length`` terms."""
    m = 50 + 50 * length * n_docs // n_terms
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and distinct terms of the items, in blocks of about ``block_terms`` terms."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    total = rows.agg(F.sum(words).alias("n")).collect()[0]["n"] or 0
    blocks = 1 + int(total) // block_terms
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for k in range(blocks):
        terms: dict = {}
        for r in rows.filter(F.col("block") == k).collect():
            terms.setdefault(r["id"], set()).update(terms_of(r["text"]))
        ids = sorted((i for i, t in terms.items() if t), key=lambda i: (i is not None, i))
        yield ids, [sorted(terms[i]) for i in ids]


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: length, and numbers and counts of the terms in ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for b in batches:
            rows, lengths, offsets, ids, counts = [], [], [0], [], []
            for k, text in enumerate(b["_text"]):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = [(i, c) for w, c in Counter(words).items() if (i := number.get(w)) is not None]
                rows.append(k)
                lengths.append(len(words))
                ids += [i for i, _ in found]
                counts += [c for _, c in found]
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(index, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def _postings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term, count and document length of every posting of a batch of the forward index."""
    terms, counts = b["terms"].flatten().to_numpy(), b["counts"].flatten().to_numpy()
    sizes = np.diff(b["terms"].offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), terms, counts, np.repeat(b["n"].to_numpy(), sizes)


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df): documents of each term that has one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(b["terms"].flatten().to_numpy(), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    return index.select("terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def stored_impacts(index: DataFrame, weights: np.ndarray, seeds: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, largest, kth): the largest impact of every term and, of those marked in ``seeds``, the k-th largest (0 with fewer than k)."""
    sent = index.sparkSession.sparkContext.broadcast((weights, np.where(seeds, k, 1)))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, keep = sent.value
        terms, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            _, t, tf, n = _postings(b)
            terms, values = np.concatenate([terms, t]), np.concatenate([values, impacts(weights[t], tf, n, n_docs, n_terms)])
            order = np.lexsort((-values, terms))
            terms, values = terms[order], values[order]
            first = np.searchsorted(terms, terms)
            kept = np.arange(len(terms)) - first < keep[terms]
            terms, values = terms[kept], values[kept]
        for a in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + 100_000], pa.int32()), pa.array(values[a : a + 100_000])], ["term", "impact"])

    best = index.select("n", "terms", "counts").mapInArrow(largest, "term int, impact bigint")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    best = best.withColumn("place", place).filter(F.col("place") <= k)
    return best.groupBy("term").agg(F.max("impact").alias("largest"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


class ItemIndex:
    """The items of a block as flat arrays: their terms by falling largest impact, and the thresholds of a task."""

    def __init__(self, items: list[np.ndarray], largest: np.ndarray, thresholds: np.ndarray, n_vocabulary: int):
        self.sizes = np.array([len(t) for t in items], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        terms = np.concatenate(items).astype(np.int64) if items else np.empty(0, np.int64)
        order = np.lexsort((terms, -largest[terms], self.item))
        self.terms, self.n_vocabulary = terms[order], n_vocabulary
        # What a term and those after it can add to a score of their item.
        top = largest[self.terms]
        through = np.cumsum(top)
        ends = through[self.starts[1:] - 1] if len(items) else through[:0]
        self.suffix = np.repeat(ends, self.sizes) - through + top
        self.thresholds = thresholds.copy()
        self.prune()

    def prune(self) -> None:
        """Keeps, for each item, the terms that generate candidates; what the others can add together is ``rest``."""
        keep = self.suffix >= self.thresholds[self.item]
        n_kept = np.bincount(self.item[keep], minlength=len(self.sizes))
        at = self.starts[:-1] + n_kept
        self.rest = np.where(n_kept < self.sizes, np.append(self.suffix, 0)[np.minimum(at, len(self.suffix))], 0)
        order = np.argsort(self.terms[keep], kind="stable")
        self.by_term = self.item[keep][order]
        self.by_start = np.searchsorted(self.terms[keep][order], np.arange(self.n_vocabulary + 1))

    def candidates(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and items whose score may reach the item's threshold; postings are sorted by row."""
        fan = np.diff(self.by_start)[term]
        total = np.cumsum(fan)
        cuts = np.searchsorted(total, np.arange(_PART, int(total[-1]) + _PART if len(total) else _PART, _PART))
        rows, items, low = [], [], 0
        for cut in [*cuts.tolist(), len(row)]:
            # A row is never cut in two: its impacts are summed here.
            high = len(row) if cut >= len(row) else int(np.searchsorted(row, row[cut], "right"))
            if high <= low:
                continue
            r, t, v, n = row[low:high], term[low:high], impact[low:high], fan[low:high]
            at = np.repeat(self.by_start[t] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            key = (np.repeat(r, n) - r[0]) * len(self.sizes) + self.by_term[at]
            # Sums stay below 2^53, so adding them as doubles is exact.
            some = np.bincount(key, np.repeat(v, n), (int(r[-1]) - int(r[0]) + 1) * len(self.sizes)).astype(np.int64)
            met = np.flatnonzero(some)
            item = met % len(self.sizes)
            met = met[some[met] + self.rest[item] >= self.thresholds[item]]
            rows.append(met // len(self.sizes) + int(r[0]))
            items.append(met % len(self.sizes))
            low = high
        none = np.empty(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *items])

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The exact scores of pairs of a row and an item."""
        key = row * self.n_vocabulary + term
        order = np.argsort(key)
        key, impact = key[order], impact[order]
        out = []
        step = max(1, _PART // max(1, int(self.sizes.max(initial=1))))
        for a in range(0, len(rows), step):
            r, i = rows[a : a + step], items[a : a + step]
            n = self.sizes[i]
            first = np.cumsum(n) - n
            at = np.repeat(self.starts[i] - first, n) + np.arange(int(n.sum()))
            wanted = np.repeat(r, n) * self.n_vocabulary + self.terms[at]
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            out.append(np.add.reduceat(np.where(key[place] == wanted, impact[place], 0), first))
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _best(items: np.ndarray, scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """The places of the k best of each item: by score, then id."""
    by_id = np.empty(len(ids), np.int64)
    by_id[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((by_id, -scores, items))
    ordered = items[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def best_of_tasks(index: DataFrame, items: ItemIndex, weights: np.ndarray, item_ids: pa.Array, n_docs: int, n_terms: int, k: int, schema: str) -> DataFrame:
    """(item_id, doc_id, score): of each task the k best documents of every item, as far as they may be in the result."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights, item_ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, weights, item_ids = sent.value
        items = copy.copy(shared)  # workers are used again, and thresholds are the task's own
        items.thresholds = shared.thresholds.copy()
        kept_items, kept_scores, kept_ids = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            for low in range(0, len(batch), 1000):
                b = batch.slice(low, 1000)
                row, term, tf, n = _postings(b)
                if not len(row):
                    continue
                impact = impacts(weights[term], tf, n, n_docs, n_terms)
                rows, found = items.candidates(row, term, impact)
                score = items.scores(row, term, impact, rows, found)
                good = score >= np.maximum(items.thresholds[found], 1)
                if not good.any():
                    continue
                ids = b["doc_id"].take(pa.array(rows[good]))
                ids = ids if kept_ids is None else pa.concat_arrays([kept_ids, ids])
                all_items, all_scores = np.concatenate([kept_items, found[good]]), np.concatenate([kept_scores, score[good]])
                at = _best(all_items, all_scores, ids, k)
                kept_items, kept_scores, kept_ids = all_items[at], all_scores[at], ids.take(pa.array(at))
                last = np.flatnonzero(np.bincount(kept_items, minlength=len(items.sizes)) >= k)
                kth = kept_scores[np.searchsorted(kept_items, last, "right") - 1]
                if (kth > items.thresholds[last]).any():
                    items.thresholds[last] = np.maximum(items.thresholds[last], kth)
                    items.prune()
        if kept_ids is not None:
            yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(kept_items)), kept_ids, pa.array(kept_scores)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(search, schema)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    seeds: int = SEEDS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item with a score above 0, by score, then id."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))
    schema, item_type = f"item_id {item_kind}, doc_id {kind}, score bigint", to_arrow_type(items.schema[item_col].dataType)
    spark = docs.sparkSession
    out = None
    for ids, terms in item_blocks(items, item_col, item_text_col, block_terms):
        vocabulary = {t: k for k, t in enumerate(sorted({t for own in terms for t in own}))}
        index = staged(forward_index(docs, vocabulary, id_col, text_col), "forward-index")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        if not n_docs or not ids:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in document_counts(index).collect():  # one row a term of the block
            df[r["term"]] = r["df"]
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        own = [np.array([vocabulary[t] for t in x], np.int64) for x in terms]
        own = [x[df[x] > 0] for x in own]
        marked = np.zeros(len(vocabulary), bool)
        for x in own:
            often = x[df[x] >= top]
            marked[often[np.argsort(-weights[often], kind="stable")[:seeds]]] = True
        largest, kth = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        for r in stored_impacts(index, weights, marked, n_docs, n_terms, top).collect():
            largest[r["term"]], kth[r["term"]] = r["largest"], r["kth"]
        with_terms = [k for k, x in enumerate(own) if len(x)]
        own = [own[k] for k in with_terms]
        block = ItemIndex(own, largest, np.array([kth[x].max() for x in own], np.int64), len(vocabulary))
        found = best_of_tasks(index, block, weights, pa.array([ids[k] for k in with_terms], item_type), n_docs, n_terms, top, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
