"""Usage, impact and issue reports: grouped counts, unions of sources with one row per target, top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PARTS = 32


def union_first(sources: list[DataFrame], key: str = "path") -> DataFrame:
    """Rows of several sources, one per key without case: that of the first source, then the smallest ``seq``."""
    tagged = [s.withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    low = F.lower(key).alias("key")
    return rows.groupBy(low).agg(F.min(F.struct("source_no", "seq", *[c for c in rows.columns if c not in ("source_no", "seq")])).alias("x")).select("x.*")


def usage_by_kind(references: DataFrame, kinds: list[str]) -> DataFrame:
    """Per target: uses of each kind and in all. The kinds are given, so no pass looks for them."""
    return references.groupBy("to_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k.lower()}") for k in kinds], F.count(F.lit(1)).alias("uses")
    )


def top(table: DataFrame, by: str, tie: str, k: int = 10, descending: bool = True) -> DataFrame:
    order = F.desc(by) if descending else F.asc(by)
    return table.orderBy(order, tie).limit(k)


def top_per_group(table: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    """The first k of each group, with how many more the group has."""
    counts = table.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    # First within parts of each group, then among what these leave: no task ranks a whole group.
    few = table.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(PARTS)))
    for keys in ([group, "_part"], [group]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), tie))
        few = few.withColumn("place", place).filter(F.col("place") <= k)
    return few.join(counts, group).withColumn("more", F.greatest(F.col("_n") - k, F.lit(0))).drop("_part", "_n")


def call_patterns(references: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    """Callers' kinds of one target: how often, from how many files, first line, in loops or not by line parity of none."""
    hits = references.filter(F.col("to_id") == symbol_id)
    callers = symbols.select(F.col("id").alias("from_id"), F.col("kind").alias("caller_kind"))
    return hits.join(callers, "from_id").groupBy("caller_kind").agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("file_id").alias("files"), F.min("line").alias("first_line"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )


def unused(symbols: DataFrame, references: DataFrame) -> DataFrame:
    return symbols.join(references.select(F.col("to_id").alias("id")), "id", "left_anti")


def opportunities(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """One row: symbols without use, with one use, and all."""
    uses = references.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    n = F.coalesce("uses", F.lit(0))
    return symbols.select("id").join(uses, "id", "left").agg(
        F.count_if(n == 0).alias("unused"), F.count_if(n == 1).alias("used_once"), F.count(F.lit(1)).alias("symbols")
    )


def issue_report(issues: DataFrame) -> DataFrame:
    """Counts by severity and category, with totals of each and of all (ROLLUP)."""
    return issues.rollup("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def line_issues(lines: DataFrame, longest: int = 120) -> DataFrame:
    """(path, line_no, issue): lines over ``longest`` characters, and notes left in the text."""
    issue = F.when(F.length("line") > longest, "long line").when(F.col("line").rlike("TODO|FIXME"), "note")
    return lines.select("path", "line_no", issue.alias("issue")).filter("issue is not null")
