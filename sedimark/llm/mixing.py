"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: the sources share ``epochs`` times all words by weight, no
target exceeds ``max_repeat`` times its source's words, and what is above goes to the others by weight
until none is above. Every document of a source has the same expected number of copies, target over
source size. Documents stand in order of size, expected copies are prefix-summed along that order, one
offset drawn from the source's name is added, and a document is emitted once for each integer that its
interval crosses. Size order makes the words taken come within about one largest document of the target.

No task holds a source: rows are range-partitioned by (source, size, doc_id) and written to the shared
folder with the number of their part; ranks are counted within parts and shifted by the counts of the
parts before, so a source with a third of all rows is spread over as many tasks as its rows fill.

Cases: null or empty texts have size 0 and are taken 0 words. Null sources form one source, ordered last.
Rows that repeat a doc_id are documents of their own. Sources without words have target 0. An empty table
gives an empty result. Very long texts are counted whole. Extra columns are ignored by ``mix`` and pass through ``mixed``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, max_repeat: float = MAX_REPEAT
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources fill up in order of cap over weight, so the level at which the rest stand is found with
    running sums over the sources (one row each: the only unpartitioned window).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("k", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k").cast("int") + 1)
    capped = weighed.select("source", "source_size", weight.alias("w"), (F.lit(max_repeat) * F.col("source_size")).alias("cap"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("full_w"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
    ).withColumn("level", (F.lit(epochs) * F.col("all_size") - F.col("full")) / (F.col("all_w") - F.col("full_w")))
    held = F.col("level") * F.col("w") <= F.col("cap")
    first = F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("source").isNull().alias("last"), "source", "level")
    at = F.min(F.when(held, first)).over(everything)["level"]
    return levels.withColumn("at", at).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target")
    )


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the source's name."""
    name = F.concat(F.coalesce(source, F.lit("")), F.when(source.isNull(), F.lit("/null/")).otherwise(F.lit("/")), F.lit(seed))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    epochs: float = EPOCHS,
    max_repeat: float = MAX_REPEAT,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and ``carry`` if given."""
    kept = [F.col(carry).alias("_carry")] if carry else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *kept
    )
    ordered = sized.repartitionByRange("source", "size", "doc_id").withColumn("part", F.spark_partition_id())
    parts = staged(ordered, "mix-parts")
    counts = parts.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "mix-counts")
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, epochs, max_repeat)
    # One row per (source, part): as many as tasks wrote, plus one per source.
    starts = counts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("c.source").alias("_s"), F.col("c.part").alias("_p"), "shift", "source_size", "target")
    local = Window.partitionBy("part", "source").orderBy("size", "doc_id")
    ranked = parts.withColumn("row", F.row_number().over(local))
    met = ranked.join(starts, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = F.col("shift") + F.col("row"), offset_of(F.col("source"), seed)
    crossed = F.floor(rank * F.col("rate") + u) - F.floor((rank - 1) * F.col("rate") + u)
    return (
        met.withColumn("rate", rate)
        .withColumn("copies", crossed.cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
            *([F.col("_carry").alias(carry)] if carry else []),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it was emitted, and ``copy_no`` from 1.

    A column ``copy_no`` of ``docs`` is replaced. Rows are known by two hashes of all their columns but maps and variants; rows equal in
    all of these are one row that is emitted as often as all of them.
    """
    docs = docs.drop("copy_no")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    keys = [F.xxhash64(*hashed), F.xxhash64(F.lit("second"), *reversed(hashed))]
    names = {"id": id_col, "text": text_col, "source": source_col}
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(k.alias(f"k{i}") for i, k in enumerate(keys, 1)))
    slim = rows.select(*(F.col("row").getField(c).alias(name) for name, c in names.items()), F.struct("k1", "k2").alias("key"))
    taken = mix(slim, id_col="id", text_col="text", source_col="source", carry="key", **options)
    counts = taken.groupBy("key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    counts = staged(counts.select("key.k1", "key.k2", "copies", "rows"), "mix-taken")
    once = rows.join(counts.filter("rows = 1"), ["k1", "k2"])
    several = rows.join(counts.filter("rows > 1"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no")
    return once.unionByName(several).select("row", copies).select("row.*", "copy_no")
