"""Scores and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column, bounds: list[tuple[float, str]], top: str, inclusive: bool = True) -> Column:
    """The first label whose bound ``value`` does not exceed (or stays under), else ``top``."""
    out = F.lit(top)
    for bound, label in reversed(bounds):
        out = F.when(value <= bound if inclusive else value < bound, label).otherwise(out)
    return out


def size_bucket(lines: Column) -> Column:
    return tier(lines, [(200, "Small"), (500, "Medium"), (1000, "Large"), (2000, "VeryLarge")], "Enormous", inclusive=False)


def complexity_level(value: Column) -> Column:
    return tier(value, [(10, "Simple"), (20, "Moderate"), (50, "Complex")], "VeryComplex")


def mean_excess(measures: list[tuple[Column, float]]) -> Column:
    """Mean of the measures over their thresholds, each capped at 1."""
    return sum((F.least(F.lit(1.0), m / F.lit(float(t))) for m, t in measures), F.lit(0.0)) / len(measures)


def severity(score: Column) -> Column:
    return tier(score, [(0.3, "None"), (0.5, "Low"), (0.7, "Medium"), (0.9, "High")], "Critical")


def excess_severity(value: Column, threshold: float) -> Column:
    """How far over a threshold: up to 20 %, 50 %, 100 %, beyond."""
    return tier((value - threshold) / F.lit(float(threshold)), [(0.2, "Minor"), (0.5, "Major"), (1.0, "Critical")], "Blocker")


def maintainability(volume: Column, cyclomatic: Column, length: Column) -> Column:
    """171 - 5.2 ln V - 0.23 C - 16.2 ln L, held to 0..100."""
    raw = 171.0 - 5.2 * F.log(volume) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(length, F.lit(1)))
    return F.when(volume == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def refactoring_priority(copies: Column, lines: Column, complexity: Column) -> Column:
    """Points for copies, lines and complexity, each up to a bound, as a tier."""
    points = F.least(copies * 10, F.lit(50)) + F.least(lines * 2, F.lit(30)) + F.least(complexity * 5, F.lit(20))
    return tier(points, [(40, "Low"), (60, "Medium"), (80, "High")], "Critical", inclusive=False)


def refactoring_risk(copies: Column, public: Column, complexity: Column, files: Column) -> Column:
    """Points for many copies, public use, complexity and spread over files, as a tier."""
    points = sum((F.when(c, p).otherwise(0) for c, p in ((copies > 5, 20), (public, 15), (complexity > 10, 15), (files > 3, 10))), F.lit(0))
    return tier(points, [(20, "Low"), (30, "Medium"), (40, "High")], "VeryHigh", inclusive=False)


def duplication_impact(lines: Column, copies: Column, complexity: Column, similarity: Column) -> Column:
    """Mean of four scores held to 1: upkeep, reading, running and testing."""
    upkeep = copies * complexity * similarity / 50.0
    reading = (copies * 0.3 + lines * 0.01) * similarity
    return mean_excess([(upkeep, 1.0), (reading, 1.0), (complexity * 0.05 * similarity, 1.0), (copies * 0.2 * similarity, 1.0)])


def halstead_volume(operators: Column, operands: Column, length: Column) -> Column:
    """Length times log2 of all operators and operands, cut to a whole number."""
    words = operators + operands
    return F.when(words > 0, F.floor(length * F.log2(words))).otherwise(0).cast("long")


def priority(score: Column) -> Column:
    return tier(score, [(0.4, "Low"), (0.6, "Medium"), (0.8, "High")], "Critical")


def file_priority(lines: Column, classes: Column, methods: Column, smells: Column) -> Column:
    return tier(lines / 1000.0 + classes * 0.2 + methods * 0.1 + smells * 0.05, [(0.4, "Low"), (0.7, "Medium"), (1.0, "High")], "Critical")


def hotspot_risk(score: Column, count: Column) -> Column:
    out = F.lit("Low")
    for least, copies, label in ((20, 3, "Medium"), (50, 5, "High"), (100, 10, "Critical")):
        out = F.when((score >= least) | (count >= copies), label).otherwise(out)
    return out


def impact_tier(score: Column) -> Column:
    return tier(score, [(0.2, "Negligible"), (0.4, "Minor"), (0.6, "Moderate"), (0.8, "Significant")], "Critical", inclusive=False)


def overall_risk(critical: Column, high: Column, operations: Column) -> Column:
    """Critical if any is; High over 2 high ones or 5 operations; Medium over none or 2; else Low."""
    return (
        F.when(critical > 0, "Critical")
        .when((high > 2) | (operations > 5), "High")
        .when((high > 0) | (operations > 2), "Medium")
        .otherwise("Low")
    )
