"""Path lengths over all pairs: what moves between tasks, and components that are larger than a block."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sedimark.operators import graph, hops
from tests.test_whole_tables import path_lengths


def shuffled(spark, run):
    """What ``run`` returns, and the bytes of shuffles that it has written where no join broadcasts."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        return run(), written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_sketches_do_not_move_along_every_edge(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(3000), rng.randrange(3000)) for _ in range(40_000)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    row, moved = shuffled(spark, lambda: graph.approximate_path_length(e).collect()[0])
    assert row["pairs"] == pytest.approx(3000 * 2999, rel=0.03) and row["longest"] == 5
    assert moved < 25_000_000


def test_bits_move_within_components(spark):
    rng = random.Random(5)
    pairs = {(1000 * c + rng.randrange(80), 1000 * c + rng.randrange(80)) for c in range(40) for _ in range(500)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    row, moved = shuffled(spark, lambda: graph.mean_path_length(e, e.select(F.col("src").alias("node"))).collect()[0])
    assert (row["pairs"], round(row["mean_length"], 6), row["longest"]) == path_lengths(pairs)
    assert moved < 2_500_000


def test_sketches_of_whole_components_do_not_move(spark):
    rng = random.Random(9)
    pairs = {(rng.randrange(1500), rng.randrange(1500)) for _ in range(9000)} | {(5, k) for k in range(300)} | {(9000, 9001), (9001, 9002)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    found, moved = shuffled(spark, lambda: hops.sketched(e))
    exact, mean, longest = path_lengths(pairs)
    assert sum(n for _, n in found) == pytest.approx(exact, rel=0.03) and sum(d * n for d, n in found) / sum(n for _, n in found) == pytest.approx(mean, rel=0.03)
    assert found[-1][0] == longest and dict(hops.sketched(e, 2)) == pytest.approx(dict(found[:2]))
    assert moved < 1_000_000


def test_bits_of_whole_components_do_not_move(spark):
    rng = random.Random(10)
    pairs = {(3000 * c + rng.randrange(1500), 3000 * c + rng.randrange(1500)) for c in range(2) for _ in range(9000)} | {(3000, 3000 + k) for k in range(300)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    row, moved = shuffled(spark, lambda: graph.mean_path_length(e, e.select(F.col("src").alias("node"))).collect()[0])
    assert (row["pairs"], round(row["mean_length"], 6), row["longest"]) == path_lengths(pairs)
    assert moved < 1_000_000


def test_components_larger_than_a_block(spark):
    block = 8
    rng = random.Random(6)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(400)} | {(0, k) for k in range(100, 240)} | {(k, k + 1) for k in range(900, 912)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    found = hops.reached(e, F.lit(True), block=block, width=2)
    lengths = (sum(n for _, n in found), round(sum(d * n for d, n in found) / sum(n for _, n in found), 6), found[-1][0])
    assert lengths == path_lengths(pairs)
    odd = {(a, b) for a, b in pairs if a % 2}
    assert hops.reached(e, F.col("src") % 2 == 1, 1, block, 2) == [(1, len([1 for a, b in odd if a != b]))]
    assert dict(hops.sketched(e, block=block)) == pytest.approx(dict(hops.sketched(e)))
    words = e.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
    assert hops.reached(words, F.lit(True), block=block) == found


def test_cycles_do_not_write_paths_that_close_none(spark, monkeypatch):
    rng = random.Random(8)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    nodes = range(12)
    expected = {(a,) for a in nodes if (a, a) in pairs}
    for n in (2, 3, 4):
        expected |= {p for p in permutations(nodes, n) if p[0] == min(p) and all((p[k], p[(k + 1) % n]) in pairs for k in range(n))}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    for chunk in (2, 1024):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        got = sorted((tuple(r["path"]), r["length"]) for r in graph.cycles(e, 4).collect())
        assert got == sorted((p, len(p)) for p in expected)
    # Two layers with all edges between: 64 thousand paths of three nodes, no cycle.
    pairs = [(a, 100 + b) for a in range(40) for b in range(40)] + [(100 + b, 200 + c) for b in range(40) for c in range(40)]
    rows = []
    monkeypatch.setattr(graph, "staged", lambda df, *a: rows.append(df.count()) or df)
    assert graph.cycles(spark.createDataFrame(pairs, "src long, dst long")).count() == 0
    assert max(rows) <= len(pairs)
