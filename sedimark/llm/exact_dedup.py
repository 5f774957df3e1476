"""Exact deduplication through an extendible-hash index kept in the shared folder.

Every text is normalised (each run of ASCII white space becomes one space; null counts as empty) and
hashed to 64 bits. Keys of the index are the different hashes, with the number of rows of each. A directory that
doubles until no bucket is overfull says how many bits of the hash each bucket has, and the keys are written to
their buckets. What the index says of more than one row is then decided by the owners of the buckets: an owner task
holds the key ranges of some buckets, compares the texts of each key byte by byte, and chains the different ones
with their smallest doc_id and their number of rows. The result is read from these chains.

Only DataFrame and SQL functions run on the executors. Copies collapse twice before an owner sees them, in the task
that reads them and by one of ``SALTS`` parts of each text, so a text that makes up a third of all rows reaches its
owner as ``SALTS`` rows at most. The join that gives rows their chain is a left join on the chains, which
adaptive execution broadcasts when small and splits when one key is hot.

Cases: null and empty texts are equal to each other and form one group. Rows that repeat a doc_id are
rows of their own in ``group_size`` and share one decision where their texts are equal. A null doc_id loses every tie
and is kept only where no row of the group has an id. Very long texts are hashed and compared whole. Extra columns
are ignored, and pass through ``first_copies``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.storage import staged

MIN_CAPACITY = 512
#: Buckets hold more than ``MIN_CAPACITY`` keys where the directory would exceed about this many bits otherwise.
DIRECTORY_BITS = 14
STEP = 16
SALTS = 16
#: Hashes of repeated texts are broadcast up to this many (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 1 << 20


def normalised(text: Column) -> Column:
    """White-space runs to one space. The pattern skips single spaces, which already have that form."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def entries_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, sha) of every row."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"))


def leading_bits(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def split_buckets(cells: dict[int, int], depth: int, deeper: int, capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(buckets as (prefix, depth), overfull prefixes of ``deeper`` bits) from one overfull bucket of ``depth`` bits.

    ``cells`` counts its keys by their first ``deeper`` bits. A bucket over capacity splits in two, bit by bit.
    """
    done, level = [], {next(iter(cells)) >> (deeper - depth): cells}
    for d in range(depth, deeper):
        halves: dict[int, dict[int, int]] = {}
        for prefix, inside in level.items():
            if sum(inside.values()) <= capacity:
                done.append((prefix, d))
                continue
            for half in (2 * prefix, 2 * prefix + 1):
                halves[half] = {}
            for cell, n in inside.items():
                halves[cell >> (deeper - d - 1)][cell] = n
        level = halves
    overfull = [p for p, inside in level.items() if sum(inside.values()) > capacity and deeper < 64]
    return done + [(p, deeper) for p in level if p not in set(overfull)], overfull


def grow_directory(keys: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """(prefix, depth) of every bucket. Keys are counted by ``STEP`` more bits a round, in overfull buckets only."""
    buckets, open_, depth = [], [0], 0
    while open_:
        deeper = depth + STEP
        inside = keys
        if depth:
            rows = keys.sparkSession.createDataFrame([(p,) for p in open_], "_open long")
            inside = keys.join(F.broadcast(rows), leading_bits(F.col("h"), depth) == F.col("_open"), "left_semi")
        counted = inside.groupBy(leading_bits(F.col("h"), deeper).alias("cell")).count().collect()  # 2 ** STEP a bucket at most
        by: dict[int, dict[int, int]] = {}
        for r in counted:
            cell = r["cell"] & (1 << deeper) - 1
            by.setdefault(cell >> STEP, {})[cell] = r["count"]
        open_ = []
        for cells in by.values():
            done, overfull = split_buckets(cells, depth, deeper, capacity)
            buckets += done
            open_ += overfull
        depth = deeper
    return sorted(buckets, key=lambda b: b[0] << (64 - b[1]))


def build_index(entries: DataFrame, capacity: int | None = None) -> DataFrame:
    """The keys in their buckets, read back from the index: bucket, h, rows."""
    spark = entries.sparkSession
    keys = staged(entries.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "dedup-keys")
    capacity = capacity or max(MIN_CAPACITY, keys.count() >> DIRECTORY_BITS)
    directory = grow_directory(keys, capacity)
    # Buckets of up to STEP bits are looked up by STEP bits, and only where these were not enough by STEP more.
    placed, found = keys, []
    for bits in range(STEP, STEP + max((d for _, d in directory), default=0), STEP):
        here = [(k, p << bits - d, (p + 1) << bits - d) for k, (p, d) in enumerate(directory) if bits - STEP < max(d, 1) <= bits]
        slots = spark.createDataFrame([(k, i - (1 << 64) if i >> 63 else i, n - i) for k, i, n in here], "_bucket int, low long, n long")
        slots = slots.select(F.col("_bucket").alias(f"_b{bits}"), F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias(f"_s{bits}"))
        placed = placed.join(F.broadcast(slots), leading_bits(F.col("h"), bits) == F.col(f"_s{bits}"), "left")
        found.append(F.col(f"_b{bits}"))
    bucket = F.coalesce(*found) if found else F.lit(0)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select(bucket.alias("bucket"), "h", "rows").repartition(owners, "bucket").sortWithinPartitions("bucket", "h")
    return staged(placed, "dedup-index")


def chains(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the owners of the buckets find for keys of several rows: bucket, h, link, sha, keep_id, n."""
    several = staged(index.filter("rows > 1").select("bucket", F.col("h").alias("key")), "dedup-several")
    known = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", F.xxhash64("norm"))
    mine = rows.join(known, F.col("h") == F.col("key")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    fewer = mine.groupBy("bucket", "h", "norm", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = fewer.repartition(owners, "bucket").groupBy("bucket", "h", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"))
    link = F.struct(F.sha2("norm", 256).alias("sha"), "keep_id", "n")
    chained = owned.groupBy("bucket", "h").agg(F.sort_array(F.collect_list(link)).alias("chain"))
    return staged(chained.select("bucket", "h", F.posexplode("chain").alias("link", "x")).select("bucket", "h", "link", "x.*"), "dedup-chains")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = staged(entries_of(docs, id_col, text_col), "dedup-entries")
    found = chains(docs, build_index(entries, capacity), id_col, text_col)
    joined = entries.join(found.select("h", "sha", "keep_id", "n"), ["h", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_dedup(docs, id_col, text_col).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(normalised(docs[text_col]), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
