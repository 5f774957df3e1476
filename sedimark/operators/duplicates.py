"""Exact and near duplicates of code blocks, their metrics and hotspots.

Blocks are (id, path, group_key, n_lines, complexity, text): ``group_key`` and ``n_lines`` block the near
pass, so only blocks of one kind and length are compared, and equal hashes are collapsed before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.scoring import duplication_impact, impact_tier
from sedimark.functions.text import similarity, structural_similarity
from sedimark.operators.components import connected_components
from sedimark.storage import staged


def with_hash(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("hash", F.sha2("text", 256))


def exact_groups(blocks: DataFrame) -> DataFrame:
    """One row per text that occurs at least twice; lines and complexity are those of its first block."""
    return (
        with_hash(blocks)
        .groupBy("hash")
        .agg(
            F.min("id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.min_by("n_lines", "id").alias("n_lines"),
            F.min_by("complexity", "id").alias("complexity"),
            F.countDistinct("path").alias("files"),
        )
        .filter("copies >= 2")
    )


def near_pairs(blocks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of different texts of one group and line count with enough equal lines at equal places.

    Pairs meet on equal lines at equal places, not by crossing whole groups: a pair that shares no line has
    similarity 0. Each text takes part once, by its smallest id. ``threshold`` is above 0.
    """
    one = with_hash(blocks).groupBy("hash").agg(F.min_by(F.struct("id", "group_key", "n_lines", "text"), "id").alias("x"))
    one = one.select("x.*")
    cut = staged(one.select("id", "group_key", "n_lines", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")), "near-lines")
    a = cut.select(F.col("id").alias("a"), "group_key", "n_lines", "at", F.xxhash64("line").alias("h"))
    b = a.withColumnRenamed("a", "b")
    # Of n lines a pair shares at least the threshold's part, so each block may leave out its most frequent lines but
    # for one more than it may miss: a pair that meets must share one of the others. Counts are taken on what meets there.
    order = staged(a.groupBy("group_key", "n_lines", "at", "h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "near-frequent")
    places = a.join(order, ["group_key", "n_lines", "at", "h"])
    rare = places.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("k", "at")))
    shared = places.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    least = F.ceil(F.lit(threshold) * F.col("n_lines") - F.lit(1e-9))
    rare = rare.join(shared, "a").filter((F.col("m") >= least) & (F.col("rank") <= F.col("m") - least + 1)).select("a", "group_key", "n_lines", "at", "h")
    found = rare.join(rare.withColumnRenamed("a", "b"), ["group_key", "n_lines", "at", "h"]).filter("a < b").select("a", "b", "n_lines").distinct()
    met = found.join(places.select("a", "at", "h"), "a").join(places.select(F.col("a").alias("b"), "at", "h"), ["b", "at", "h"])
    met = met.groupBy("a", "b", "n_lines").agg(F.count(F.lit(1)).alias("equal"))
    return met.select("a", "b", (F.col("equal") / F.col("n_lines")).alias("similarity")).filter(F.col("similarity") >= threshold)


def similar_names(names: DataFrame) -> DataFrame:
    """(a, b, similarity) of different names (name) with 1 - edit distance / longer length of at least 0.8, a before b.

    The longer name has at least five characters an edit, so the shorter one of ``l`` characters takes at most ``l div 4``
    edits. Cut into one segment more than that, it has a segment that no edit touches. Names meet on a segment of the
    shorter one and an equal string of the longer one near the same place: with ``k = L div 5`` edits and lengths that
    differ by ``g``, it has moved by ``-(k - g) / 2`` to ``(k + g) / 2``. No pair is lost.
    """
    one = names.select("name").filter("length(name) > 0").distinct()
    short = one.withColumn("l", F.length("name")).withColumn("i", F.explode(F.expr("sequence(0, cast(l div 4 as int))")))
    cut = {"s": F.expr("cast(i * l div (l div 4 + 1) as int)"), "e": F.expr("cast((i + 1) * l div (l div 4 + 1) as int)")}
    short = short.withColumns(cut).select("l", "i", F.expr("substring(name, s + 1, e - s)").alias("piece"), F.col("name").alias("x"))
    long = one.withColumns({"n": F.length("name"), "k": F.expr("cast(length(name) div 5 as int)")})
    long = long.withColumn("l", F.explode(F.expr("sequence(n - k, n)"))).withColumn("i", F.explode(F.expr("sequence(0, cast(l div 4 as int))")))
    moved = F.expr("sequence(cast(-((k - n + l) div 2) as int), cast((k + n - l) div 2 as int))")
    long = long.withColumns(cut).withColumn("by", F.explode(moved)).filter("s + by >= 0 and e + by <= n")
    long = long.select("l", "i", F.expr("substring(name, s + by + 1, e - s)").alias("piece"), F.col("name").alias("y"))
    met = short.join(long, ["l", "i", "piece"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.select("a", "b", similarity(F.col("a"), F.col("b")).alias("similarity")).filter("similarity >= 0.8")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks ``a`` against ``b`` by (pair_id, text): structural and combined similarity."""
    met = a.select("pair_id", F.col("text").alias("x")).join(b.select("pair_id", F.col("text").alias("y")), "pair_id")
    s = structural_similarity(F.split("x", "\n", -1), F.split("y", "\n", -1))
    t = structural_similarity(F.split("x", r"\s+", -1), F.split("y", r"\s+", -1))
    return met.select("pair_id", s.alias("structural"), (0.7 * s + 0.3 * t).alias("combined"))


def near_groups(pairs: DataFrame) -> DataFrame:
    """(component, members): groups of near duplicates, through links."""
    return connected_components(pairs, "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("members"))


def metrics(groups: DataFrame, total_lines: DataFrame) -> DataFrame:
    """One row: groups, duplicate blocks and lines, percent of all lines, cost (half a minute a line) and savings (0.3)."""
    extra = (F.col("copies") - 1) * F.col("n_lines")
    out = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_lines"),
        F.max("copies").alias("largest"),
    )
    out = out.join(F.broadcast(total_lines.select(F.col("n").alias("all_lines"))))
    return out.select(
        "*",
        F.round(100.0 * F.col("duplicate_lines") / F.col("all_lines"), 4).alias("percent"),
        (F.col("duplicate_lines") * 0.5).alias("cost"),
        F.round(F.col("duplicate_lines") * 0.3, 4).alias("savings"),
    )


def similarity_bands(pairs: DataFrame) -> DataFrame:
    """How many pairs fall into each tenth of similarity from 0.5 up."""
    band = F.floor(F.col("similarity") * 10).cast("int")
    return pairs.groupBy(F.least(band, F.lit(9)).alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean"))


def hotspots(blocks: DataFrame, groups: DataFrame, by: str, top: int = 10) -> DataFrame:
    """The places with most duplication: sum of complexity over duplicated blocks, block count."""
    hit = with_hash(blocks).join(groups.select("hash"), "hash", "left_semi")
    scored = hit.groupBy(by).agg(F.sum("complexity").alias("score"), F.count(F.lit(1)).alias("blocks"), F.sum("n_lines").alias("lines"))
    return scored.orderBy(F.desc("score"), by).limit(top)


def hotspots_by_level(blocks: DataFrame, groups: DataFrame, levels: list[str], top: int = 10) -> DataFrame:
    """(level, place, score, blocks, lines): the ``top`` places with most duplication of every column in ``levels``, in one pass by grouping sets."""
    hit = with_hash(blocks).join(groups.select("hash"), "hash", "left_semi")
    columns = [F.col(c) for c in levels]
    summed = hit.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("complexity").alias("score"), F.count(F.lit(1)).alias("blocks"), F.sum("n_lines").alias("lines"), *(F.grouping(c).alias(f"no_{c}") for c in levels)
    )
    level, place = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in levels:
        level, place = F.when(F.col(f"no_{c}") == 0, c).otherwise(level), F.when(F.col(f"no_{c}") == 0, F.col(c).cast("string")).otherwise(place)
    scored = summed.select(level.alias("level"), place.alias("place"), "score", "blocks", "lines")
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), "place"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")


def impact(groups: DataFrame) -> DataFrame:
    score = duplication_impact(F.col("n_lines"), F.col("copies"), F.col("complexity"), F.lit(1.0))
    return groups.select("first_id", F.round(score, 6).alias("impact"), impact_tier(score).alias("tier"))
