"""Relations between types and members: inheritance, implementations, overrides, signatures.

Inheritance is an edge table (child, parent, kind), kind being ``base`` or ``interface``; members are
(type, name, parameters, returns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.graph import reachable


def ancestors(inherits: DataFrame, types: DataFrame, max_depth: int = 32) -> DataFrame:
    """(node, depth): what ``types`` (node) derive from, the nearest at depth 1."""
    edges = inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return reachable(edges, types, "forward", max_depth).filter("depth > 0")


def derived_types(inherits: DataFrame, types: DataFrame, max_depth: int = 32) -> DataFrame:
    """(node, depth): what derives from ``types``, to ``max_depth`` generations."""
    edges = inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return reachable(edges, types, "backward", max_depth).filter("depth > 0")


def implementations(inherits: DataFrame, interfaces: DataFrame, max_depth: int = 32) -> DataFrame:
    """(node): types that implement one of ``interfaces`` (node) themselves or through a type that they derive from."""
    direct = inherits.filter("kind = 'interface'").join(interfaces.select(F.col("node").alias("parent")), "parent", "left_semi")
    direct = direct.select(F.col("child").alias("node")).distinct()
    bases = inherits.filter("kind = 'base'").select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return reachable(bases, direct, "backward", max_depth).select("node").distinct()


def overrides(inherits: DataFrame, members: DataFrame) -> DataFrame:
    """(base, derived, name): members that a type has anew with the name and parameters of its base's."""
    base = members.select(F.col("type").alias("base"), "name", "parameters")
    derived = members.select(F.col("type").alias("derived"), "name", "parameters")
    met = inherits.filter("kind = 'base'").select(F.col("child").alias("derived"), F.col("parent").alias("base"))
    return met.join(base, "base").join(derived, ["derived", "name", "parameters"]).select("base", "derived", "name")


def overloads(members: DataFrame) -> DataFrame:
    """(type, name, n): names that a type has with several lists of parameters."""
    return members.groupBy("type", "name").agg(F.countDistinct("parameters").alias("n")).filter("n > 1")


def type_complexity(members: Column, methods: Column, properties: Column) -> Column:
    """Members, methods twice more, properties once more."""
    return members + 2 * methods + properties


def signature(name: Column, returns: Column, parameters: Column) -> Column:
    """``returns name(type, type)`` from an array of parameter types."""
    return F.concat(returns, F.lit(" "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def signatures_match(name_a: Column, a: Column, name_b: Column, b: Column, compatible) -> Column:
    """Equal names and as many parameters, each of a type that ``compatible`` takes for the other's."""
    each = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(compatible(x, y), F.lit(False))), lambda ok: ok)
    return (name_a == name_b) & (F.size(a) == F.size(b)) & each
