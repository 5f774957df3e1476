"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round begins with each task replacing the edges it reads by stars, which shortens long chains and drops what
dense groups have in excess. Then it rewrites the edges so that nodes point at smaller nodes; it ends when each
component is a star around its smallest node. A round is two grouped minima and two joins on the node; minima are combined
before the shuffle and a join whose node is hot is split by adaptive execution. Each round's edges are
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage import staged

MAX_ROUNDS = 60


def _forest(edges: DataFrame) -> DataFrame:
    """The edges (u, v) with those of each task replaced by stars around the least nodes that they connect.

    Never more edges than before; where a task has many edges among few nodes, as many as it has nodes.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        schema = None
        for b in batches:
            schema = b.schema
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                x, y = root(u), root(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        for k in range(0, len(rows), 100_000):
            part = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], schema.field(c).type) for c in (0, 1)], ["u", "v"])

    return edges.mapInArrow(contract, edges.schema)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).collect()[0]
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is its smallest node.

    Edges count in both directions; loops, repeats and null ends are ignored.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = staged(_forest(now).distinct(), "components")
    before = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        now = staged(_star(staged(_star(_forest(now), True), "components"), False), "components")
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
