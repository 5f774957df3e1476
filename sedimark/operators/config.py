"""Hierarchical configuration: flattening, schema, last-wins merge, conflicts and checks.

JSON goes through VARIANT: a document is flattened level by level with ``variant_explode``, each level
one pass over what is still nested, down to ``max_depth``. Empty objects and arrays are leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged

# Parts of a key that mark it as sensitive.
SENSITIVE = (
    "password", "secret", "token", "key", "connectionstring", "apikey", "api_key", "privatekey", "private_key", "certificate",
    "credentials", "auth",
)
_KINDS = {"VOID": "null", "STRING": "string", "BIGINT": "integer", "DOUBLE": "number", "BOOLEAN": "boolean"}


def flatten(documents: DataFrame, max_depth: int = 8) -> DataFrame:
    """(doc, key, value, kind) of every leaf of ``documents`` (doc, content JSON); keys are joined by colons."""
    spark = documents.sparkSession
    level = documents.select("doc", F.lit(None).cast("string").alias("key"), F.try_parse_json("content").alias("v")).filter("v is not null")
    leaves = []
    for depth in range(max_depth + 1):
        # Each level is written once, so documents are parsed once however deep they are.
        kinds = staged(level.withColumn("kind", F.schema_of_variant("v")), "config-level")
        if depth and kinds.isEmpty():
            break
        nested = F.col("kind").rlike("^(OBJECT|ARRAY)<[^>]")
        if depth < max_depth:
            leaves.append(kinds.filter(~nested))
            level = kinds.filter(nested).lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "k", "child"))
            level = level.select("doc", F.concat_ws(":", "key", F.coalesce("k", F.col("pos").cast("string"))).alias("key"), F.col("child").alias("v"))
        else:
            leaves.append(kinds)
    out = reduce(DataFrame.unionByName, leaves)
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    named = F.coalesce(names[F.col("kind")], F.when(F.col("kind").startswith("DECIMAL(") & F.col("kind").endswith(",0)"), "integer")
                       .when(F.col("kind").startswith("DECIMAL"), "number").when(F.col("kind").isNull() | F.col("kind").startswith("ARRAY"), "array").otherwise("object"))
    return out.select("doc", F.coalesce("key", F.lit("")).alias("key"), F.col("v").cast("string").alias("value"), named.alias("kind"))


def infer_schema(flat: DataFrame) -> DataFrame:
    """key, kinds (distinct, sorted), documents it is in."""
    return flat.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.countDistinct("doc").alias("documents"))


def merge(flat: DataFrame, order: str = "seq") -> DataFrame:
    """(key, value): the value of the last document, keys compared without case."""
    return flat.groupBy(F.lower("key").alias("key")).agg(F.max_by("value", order).alias("value"))


def merge_conflicts(flat: DataFrame, order: str = "seq") -> DataFrame:
    """(key, seq, before, after): where a document changes a key's value, strings compared without case."""
    w = Window.partitionBy("low").orderBy(order)
    seen = flat.withColumn("low", F.lower("key")).withColumn("before", F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    changed = seen.filter((F.col("n") > 1) & ~F.lower("before").eqNullSafe(F.lower("value")))
    return changed.select(F.col("low").alias("key"), order, "before", F.col("value").alias("after"))


def sensitive(key) -> F.Column:
    """Whether any part of a key names something secret."""
    return F.exists(F.split(F.lower(key), ":"), lambda p: p.rlike("|".join(SENSITIVE)))


def check(flat: DataFrame) -> DataFrame:
    """(doc, key, issue): empty values, secrets in the clear, keys of several kinds."""
    several = flat.groupBy("key").agg(F.countDistinct("kind").alias("k")).filter("k > 1").select("key")
    return reduce(
        DataFrame.unionByName,
        [
            flat.filter(F.coalesce(F.trim("value"), F.lit("")) == "").select("doc", "key", F.lit("empty").alias("issue")),
            flat.filter(sensitive(F.col("key")) & (F.length("value") > 0)).select("doc", "key", F.lit("secret").alias("issue")),
            flat.join(several, "key", "left_semi").select("doc", "key", F.lit("mixed kinds").alias("issue")),
        ],
    )
