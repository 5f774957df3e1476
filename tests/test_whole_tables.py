"""Operators over whole tables against brute force, where SQL would be too slow or too close to the operator."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sedimark.operators import duplicates, edits, graph
from sedimark.plans import registry
from sedimark.sources.roles import REFERENCES_SQL
from tests.conftest import SMALL
from tests.oracle import connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def path_lengths(pairs):
    step = defaultdict(set)
    for a, b in pairs:
        step[a].add(b)
    found = []
    for start in list(step):
        seen, frontier, depth = {start}, {start}, 0
        while frontier := {b for a in frontier for b in step.get(a, ())} - seen:
            depth += 1
            seen |= frontier
            found += [depth] * len(frontier)
    return len(found), round(sum(found) / len(found), 6), max(found)


def test_average_path_length_takes_all_references(spark, con):
    pairs = con.sql(f"WITH {REFERENCES_SQL} SELECT DISTINCT from_id, to_id FROM refs").fetchall()
    row = registry.queries()["average_path_length"](spark, SMALL).collect()[0]
    assert (row["pairs"], row["mean_length"], row["longest"]) == path_lengths(pairs)


def test_mean_path_length_has_no_depth_bound_and_takes_many_sources(spark):
    pairs = [(k, k + 1) for k in range(1, 15)] + [(1000 + k, 1000 + k // 3) for k in range(700)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    row = graph.mean_path_length(e, e.select(F.col("src").alias("node"))).collect()[0]
    assert (row["pairs"], round(row["mean_length"], 6), row["longest"]) == path_lengths(pairs)
    none = graph.mean_path_length(e, e.filter("src < 0").select(F.col("src").alias("node"))).collect()[0]
    assert tuple(none) == (0, None, None)


def test_similar_names_against_all_pairs(spark, con):
    rng = random.Random(1)
    names = ["cold widget", "old widget", "cold plate", "old plate", "a", "b", "", None]
    for _ in range(60):
        base = [rng.choice("ab c") for _ in range(rng.randint(1, 30))]
        names.append("".join(base))
        for _ in range(3):
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(base) + 1)
                base[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
            names.append("".join(base))
    made = duplicates.similar_names(spark.createDataFrame([(n,) for n in names], "name string"))
    got = sorted((r["a"], r["b"]) for r in made.collect())
    listed = ", ".join(f"('{n}')" for n in sorted({n for n in names if n}))
    sql = f"SELECT a.n, b.n FROM (VALUES {listed}) a(n), (VALUES {listed}) b(n) WHERE a.n < b.n AND 5 * levenshtein(a.n, b.n) <= greatest(length(a.n), length(b.n))"
    assert ("cold widget", "old widget") in got and got == sorted(con.sql(sql).fetchall())


def test_conflicts_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["p", "q", None]), s := rng.randint(-50, 200), s + rng.choice([0, 1, 5, 40, 300, -3])) for k in range(120)]
    rows += [(200 + k, "p", 7, 9) for k in range(5)]
    e = spark.createDataFrame(rows, "id long, path string, start int, end int")
    pairs = sorted((p, i, j) for i, p, s, t in rows for j, q, u, v in rows if p is not None and p == q and i < j and s <= v and u <= t)
    assert sorted(tuple(r) for r in edits.conflicts(e).collect()) == pairs
    counts = {p: sum(x[0] == p for x in pairs) for p in ("p", "q")}
    assert {r["path"]: r["pairs"] for r in edits.conflict_counts(e).collect()} == counts
