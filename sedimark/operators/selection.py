"""Choosing one symbol among candidates, and one search strategy among several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(candidates: DataFrame, by: str, filters: list[Column]) -> DataFrame:
    """Candidates of each ``by`` after filters in turn; a filter that would leave none of them is not applied.

    Each filter is a grouped ``or`` that says whether it leaves anything, joined back; the groups' flags are small.
    """
    left = candidates
    for condition in filters:
        held = F.coalesce(condition, F.lit(False))
        flags = left.groupBy(by).agg(F.bool_or(held).alias("_any"))
        left = left.join(flags, by).filter(held | ~F.col("_any")).drop("_any")
    return left


def score(points: list[tuple[Column, int]]) -> Column:
    """The sum of the points of the conditions that hold."""
    return sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in points), F.lit(0))


def best(candidates: DataFrame, by: str, score_col: str, tie: str) -> DataFrame:
    """The candidate of each ``by`` with the highest score, then the least ``tie``."""
    rest = [c for c in candidates.columns if c not in (by, tie)]
    order = F.struct((-F.col(score_col)).alias("_order"), F.col(tie), *rest)
    return candidates.groupBy(by).agg(F.min(order).alias("_best")).select(by, f"_best.{tie}", *(f"_best.{c}" for c in rest))


CONFIDENCE = ("high", "medium", "low")


def fallback(strategies: list[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Rows of the first strategy (name, search) that finds any, with ``strategy`` and ``confidence`` by its place."""
    for place, (name, search) in enumerate(strategies):
        found = search()
        if place == len(strategies) - 1 or not found.isEmpty():
            return found.withColumns({"strategy": F.lit(name), "confidence": F.lit(CONFIDENCE[min(place, len(CONFIDENCE) - 1)])})
    raise ValueError("no strategy given")


# Parts of the paths of generated files and of tests.
GENERATED = ("Generated", "TemporaryGeneratedFile", ".g.cs", ".designer.cs")
TESTS = ("Test", ".Tests.", "Spec", "UnitTest")


def path_has(path: Column, parts: tuple[str, ...]) -> Column:
    """Whether a path contains one of ``parts``, case counting."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(path, p))
