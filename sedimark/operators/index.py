"""Relational code index: lookups, joins, counts and maintenance of files, symbols and references.

Limits stand behind a total order (every ORDER BY ends in an id). Upserts and deletes return the new
table; a caller writes it beside the old one and swaps the paths, which is the transaction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged


def find_callers(references: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    """Symbols that refer to ``symbol_id``, with the reference's kind and place."""
    hits = references.filter(F.col("to_id") == symbol_id).withColumnRenamed("kind", "reference_kind").drop("to_id")
    callers = symbols.select(F.col("id").alias("from_id"), "name", F.col("kind").alias("symbol_kind"))
    return hits.join(callers, "from_id")


def find_callees(references: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    """Symbols that ``symbol_id`` refers to."""
    hits = references.filter(F.col("from_id") == symbol_id).withColumnRenamed("kind", "reference_kind").drop("from_id")
    return hits.join(symbols.select(F.col("id").alias("to_id"), "name", F.col("kind").alias("symbol_kind")), "to_id")


def symbols_by_name(symbols: DataFrame, name: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols whose name contains ``name``, ignoring case; % and _ in it are wildcards."""
    found = symbols.filter(F.col("name").ilike(f"%{name}%"))
    found = found.filter(F.col("kind") == kind) if kind is not None else found
    return found.orderBy("name", "id").limit(limit)


def symbols_exact(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = symbols.filter(F.col("name") == name)
    return found.filter(F.col("kind") == kind) if kind is not None else found


def search_symbols(
    symbols: DataFrame, query: str | None = None, kinds: list[str] = (), namespaces: list[str] = (), limit: int = 100
) -> DataFrame:
    """All given criteria hold; an empty list is no criterion."""
    wanted = []
    if query:
        wanted.append(F.col("name").ilike(f"%{query}%"))
    if kinds:
        wanted.append(F.col("kind").isin(list(kinds)))
    if namespaces:
        wanted.append(F.col("namespace").isin(list(namespaces)))
    found = symbols.filter(reduce(lambda a, b: a & b, wanted)) if wanted else symbols
    return found.orderBy("name", "id").limit(limit)


def references_to(references: DataFrame, symbol_id: int) -> DataFrame:
    return references.filter(F.col("to_id") == symbol_id)


def count_by(table: DataFrame, column: str) -> DataFrame:
    """How many rows each value of ``column`` has, as ``n``."""
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n; counted in one job."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def schema_version(versions: DataFrame) -> DataFrame:
    """The largest version, 0 where there is none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files whose hash differs from the current one or whose path is gone."""
    now = current.select("path", F.col("content_hash").alias("current_hash"))
    return stored.join(now, "path", "left").filter(F.col("current_hash").isNull() | (F.col("current_hash") != F.col("content_hash")))


def deleted_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current.select("path"), "path", "left_anti")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` from 1 in an order without ties, counted within ranges of the order and shifted by the ranges before."""
    parts = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    # One row a range: as many as the shuffle has partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_rank", local).join(F.broadcast(shifts), "_part").withColumn("_rank", F.col("_rank") + F.col("_shift")).drop("_part", "_shift")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], id_col: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``incoming`` put in by ``key``; ids stay on update and continue on insert."""
    values = [c for c in stored.columns if c not in key and c != id_col]
    new = incoming.select(*key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_new"))
    met = stored.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    changed = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    if id_col is None:
        return met.select(*key, *changed)
    # New ids follow the largest: ranks of inserted keys only, and of those just the ones of this batch.
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    ranks = ranked(incoming.join(stored, key, "left_anti").select(*key).distinct(), key)
    met = met.join(ranks, key, "left").join(F.broadcast(top))
    return met.select(F.coalesce(F.col(id_col), F.col("_top") + F.col("_rank")).alias(id_col), *key, *changed)


def append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Plain insert: repeats stay."""
    return stored.unionByName(incoming)


def touch_or_create(projects: DataFrame, root: str, opened_at: str) -> DataFrame:
    """The project of ``root`` with ``opened_at`` set, made where absent. The key is a hash of the lower-cased path."""
    spark = projects.sparkSession
    new = spark.createDataFrame([(root, opened_at)], "root_path string, opened_at string")
    new = new.withColumn("root_path_hash", path_key(F.col("root_path")))
    return upsert(projects, new, ["root_path_hash"])


def path_key(path) -> F.Column:
    """The first 16 hex digits of the SHA-256 of the lower-cased path."""
    return F.substring(F.sha2(F.lower(path), 256), 1, 16)


def last_values(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Key-value store: the last write of each key wins."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def partial_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of ``changes`` replace those of ``stored``; nulls leave them."""
    values = [c for c in stored.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in values))
    return stored.join(new, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in values))


def delete_files(files: DataFrame, symbols: DataFrame, references: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and references without those of the files ``gone`` (id): references go with either end."""
    gone = gone.select(F.col("id").alias("file_id")).distinct()
    dead = symbols.join(gone, "file_id", "left_semi").select("id")
    left = references.join(dead.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    left = left.join(dead.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return (
        files.join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti"),
        symbols.join(gone, "file_id", "left_anti"),
        left.select(*references.columns),
    )


def reindex(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols after the files in ``changed`` were read anew: old rows of these files go, new rows come."""
    return symbols.join(changed.select("file_id").distinct(), "file_id", "left_anti").unionByName(changed)


def key_lookup(symbols: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """One symbol id per composite key, the first by name and id; ``limit`` bounds the rows looked at, by name."""
    rows = symbols.orderBy("name", "id").limit(limit) if limit else symbols
    text = F.concat_ws("::", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).alias("lookup_key")
    return rows.groupBy(text).agg(F.min_by("id", F.struct("name", "id")).alias("id"))


def resolve_edges(edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """Edges given by keys (from_key, to_key) as edges between ids; ends that no symbol has drop the edge."""
    ends = [lookup.select(F.col("lookup_key").alias(f"{e}_key"), F.col("id").alias(f"{e}_id")) for e in ("from", "to")]
    return edges.join(ends[0], "from_key").join(ends[1], "to_key")


def distinct_sketches(rows: DataFrame, by: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """(by..., sketch): mergeable sketches of the distinct values of each group; null values do not count."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def replace_sketches(kept: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """``kept`` with the groups that were counted anew in the place of their old sketches: what a reindex of some files does."""
    return kept.join(again.select(*by), by, "left_anti").unionByName(again)


def merged_sketches(sketches: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by..., name): distinct values of coarser groups, by union of the sketches, without a look at the rows again."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias(name))


def distinct_bitmaps(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., bucket, bitmap): the distinct values of each group, exactly, as bitmaps of 32,768 neighbouring integers each; nulls do not count.

    A bitmap takes 4 KB whatever it holds, so values should be numbered without wide gaps, as ids are.
    """
    return rows.groupBy(*by, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap"))


def merged_bitmaps(bitmaps: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by..., name): distinct values of coarser groups, by union of the bitmaps; exact at any size."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
