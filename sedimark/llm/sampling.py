"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the text of no digits."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of ``rows`` at most, chosen by a hash of the id; all rows where there are fewer.

    Adds ``_order``, the hash that also fixes the order in which a fit sees the rows.
    """
    n = rows.count()
    hashed = rows.withColumn("_order", F.xxhash64(F.col(id_col), F.lit("fit")))
    if n <= max_rows:
        return hashed
    return hashed.filter(F.pmod(F.col("_order"), F.lit(n)) < max_rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(_order, text, label) of a bounded sample of the labelled rows; null labels and repeats of an id do not count."""
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("label"))
    marks = bounded_sample(marks, "_id", max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has a bound of max_rows short rows, so it may be broadcast whatever the corpus is.
    return texts.join(F.broadcast(marks), "_id").select("_order", "text", "label")


SIGNATURES = 4
_MULTIPLIERS = [0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * k for k in range(SIGNATURES)]


def without_copies(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample without near copies of earlier ones, so that copies do not vote twice.

    Rows are copies when one of ``SIGNATURES`` minimum hashes of their five-word shingles is the same. The
    signatures of the sample's rows, whose number is bounded, are compared on the driver.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = []
            for text in b["text"].to_pylist():
                words = text.split()
                shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
                hashes = [xxhash.xxh3_64_intdigest(s) for s in shingles]
                out.append([min(h * m >> 20 & (1 << 63) - 1 for h in hashes) for m in _MULTIPLIERS])
            yield pa.RecordBatch.from_arrays([b["_order"], pa.array(out, pa.list_(pa.int64()))], ["_order", "signs"])

    rows = sample.mapInArrow(sign, "_order long, signs array<long>").collect()
    seen: set[tuple[int, int]] = set()
    kept = []
    for order, signs in sorted((r["_order"], r["signs"]) for r in rows):
        marks = set(enumerate(signs))
        if not marks & seen:
            kept.append((order,))
        seen |= marks
    keep = sample.sparkSession.createDataFrame(kept, "_order long")
    return sample.join(F.broadcast(keep), "_order", "left_semi")
