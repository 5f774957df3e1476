"""Source code, diffs, runs of fixes, graphs with cycles, analyzers, sketches and operation lives on small fixtures."""

import difflib
import random
from itertools import product

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sedimark.operators import analyzers, code, diff, edits, graph, index
from sedimark.streaming import lifecycle, windows

SOURCE = """using System;
namespace Shop.Core
{
    // class Fake { }
    public class Cart<T> : Base, IThing where T : class
    {
        private int count = 3;
        public string Name { get; set; }
        public int Size => count;
        public Cart(int a, string b) : base(a) { count = a; }
        /* multi
        line { */
        public int[] Find(Func test, int[] xs)
        {
            var s = "not { a brace";
            if (xs.Length > 0 && test(1))
            {
                foreach (var x in xs) { if (x > 1) Log(x); else return null; }
            }
            else if (count == 2) { return null; }
            do { count++; } while (count < 3);
            try { Run(() => { if (a) b(); }); } catch (Exception e) { throw; }
            return new Cart(1, s).Pick();
        }
        public abstract void Nothing();
        enum Kind { A, B }
        interface IInner { void Go(int q); }
    }
    record Point(int X, int Y);
}
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, text string")


def test_declarations_and_scopes(spark):
    rows = code.declarations(files(spark, SOURCE, "namespace N; class Q { void M() { } }", "", None)).collect()
    assert {(r["path"], r["kind"], r["name"], r["line"], r["end_line"], r["parameters"], r["container"], r["namespace"]) for r in rows} == {
        ("f0", "namespace", "Shop.Core", 2, 30, None, None, None), ("f0", "class", "Cart", 5, 28, None, "Shop.Core", "Shop.Core"),
        ("f0", "field", "count", 7, 7, None, "Cart", "Shop.Core"), ("f0", "property", "Name", 8, 8, None, "Cart", "Shop.Core"),
        ("f0", "property", "Size", 9, 9, None, "Cart", "Shop.Core"), ("f0", "constructor", "Cart", 10, 10, 2, "Cart", "Shop.Core"),
        ("f0", "method", "Find", 13, 24, 2, "Cart", "Shop.Core"), ("f0", "method", "Nothing", 25, 25, 0, "Cart", "Shop.Core"),
        ("f0", "enum", "Kind", 26, 26, None, "Cart", "Shop.Core"), ("f0", "interface", "IInner", 27, 27, None, "Cart", "Shop.Core"),
        ("f0", "method", "Go", 27, 27, 1, "IInner", "Shop.Core"), ("f0", "record", "Point", 29, 29, None, "Shop.Core", "Shop.Core"),
        ("f1", "namespace", "N", 1, 1, None, None, None), ("f1", "class", "Q", 1, 1, None, None, "N"), ("f1", "method", "M", 1, 1, 0, "Q", "N"),
    }


def test_method_complexity(spark):
    made = {r["name"]: (r["cyclomatic"], r["cognitive"], r["nesting"], r["overall"]) for r in code.method_complexity(files(spark, SOURCE)).collect()}
    # if 1, foreach 2, inner if 3, else-if 1, handler 1, if of the lambda 1.
    assert made["Find"] == (9, 9, 3, 7.1) and made["Nothing"] == (1, 0, 0, 0.4)


def statement(rng, left, nest, depth):
    """A random statement with its cognitive cost and the deepest nesting in it."""
    k = rng.random()
    if left == 0 or k < 0.3:
        return rng.choice(["a();", "x = 1;", "return;", "f(() => 1);", ";", "g(x => { if0 = 1; });"]), 0, depth

    def body(n, d):
        if rng.random() < 0.5:
            return statement(rng, left - 1, n, d)
        parts = [statement(rng, left - 1, n, d) for _ in range(rng.randint(0, 3))]
        return "{ " + " ".join(p[0] for p in parts) + " }", sum(p[1] for p in parts), max([d] + [p[2] for p in parts])

    if k < 0.6:
        text, cost, most = body(nest + 1, depth + 1)
        out, cost, most = f"if (a(b) > (c)) {text}", cost + 1 + nest, max(most, depth + 1)
        if rng.random() < 0.5:
            if not text.startswith("{"):
                out = f"if (a(b) > (c)) {{ {text} }}"
            other, more, high = body(nest, depth + 1)
            out, cost, most = f"{out} else {other}", cost + more, max(most, high)
        return out, cost, most
    if k < 0.8:
        text, cost, most = body(nest + 1, depth + 1)
        return f"{rng.choice(['while (x)', 'for (;;)', 'foreach (var a in b)'])} {text}", 1 + nest + cost, max(most, depth + 1)
    if k < 0.9:
        (a, c, m), (b, d, n) = statement(rng, left - 1, nest, depth + 1), statement(rng, left - 1, nest, depth + 1)
        return f"try {{ {a} }} catch (E e) {{ {b} }}", c + 1 + d, max(m, n, depth + 1)
    text, cost, most = body(nest, depth)
    return f"do {text} while (x);", cost, most


def test_nesting_fold_on_random_statements(spark):
    rng = random.Random(4)
    made = spark.createDataFrame([statement(rng, 4, 0, 0) for _ in range(150)], "t string, cost int, most int")
    folded = made.withColumn("f", code.nesting_fold(F.regexp_extract_all("t", F.lit(code.TOKEN), F.lit(0))))
    assert folded.filter("f.cognitive <> cost or f.nesting <> most").collect() == []


def test_text_references(spark):
    names = spark.createDataFrame([("Cart",), ("count",), ("Pick",), ("System",)], "name string")
    found = code.text_references(files(spark, SOURCE, None), names).collect()
    assert {(r["name"], r["line_no"]) for r in found} == {("Cart", 10), ("Cart", 23), ("Pick", 23), ("count", 7), ("count", 9), ("count", 10), ("count", 20), ("count", 21)}


def patched(spark, before, after):
    pairs, old, new = diff.aligned_lines(files(spark, *before), files(spark, *after))
    return {(r["path"], r["old_no"], r["new_no"]) for r in pairs.collect()}, {(r["path"], r["old_no"]) for r in old.collect()}, {(r["path"], r["new_no"]) for r in new.collect()}


def test_inserted_first_line_is_one_added_line(spark):
    text = "\n".join(f"line {k % 3}" for k in range(50))
    rows = diff.aligned_diff(files(spark, text), files(spark, "new\n" + text)).collect()
    assert [(r["op"], r["new_no"], r["line"]) for r in rows] == [("+", 1, "new")]


def test_diff_of_random_versions_is_sound_and_small(spark):
    rng = random.Random(8)
    before, after = [], []
    for _ in range(25):
        own = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        now = list(own)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(now))
            now[at : at + rng.randint(0, 2)] = [f"new {rng.random()}"] * rng.randint(0, 2)
        before.append("\n".join(own))
        after.append("\n".join(now))
    pairs, gone, made = patched(spark, before + ["only old", None], after + [None, "only new"])
    extra = 0
    for k, (a, b) in enumerate(zip(before, after)):
        a, b = a.split("\n"), b.split("\n")
        own = sorted((i, j) for p, i, j in pairs if p == f"f{k}")
        assert all(a[i - 1] == b[j - 1] for i, j in own) and all(x < y and u < v for (x, u), (y, v) in zip(own, own[1:]))
        assert len(own) + sum(p == f"f{k}" for p, _ in gone) == len(a) and len(own) + sum(p == f"f{k}" for p, _ in made) == len(b)
        best = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        extra += max(0, best - len(own))
    assert extra <= 6
    assert ("f25", 1) in gone and ("f26", 1) in made


def test_hunks(spark):
    before, after = "a\nb\nc\nd\ne", "x\na\nb\nC1\nC2\nd\ne\nz"
    rows = diff.hunks(files(spark, before), files(spark, after)).orderBy("hunk").collect()
    assert [tuple(r)[2:] for r in rows] == [(1, 0, 1, 1, "+x"), (3, 1, 4, 2, "-c\n+C1\n+C2"), (6, 0, 8, 1, "+z")]


def test_overlapping_edits_are_refused(spark):
    e = spark.createDataFrame([("f0", 1, 4, "x"), ("f0", 3, 5, "y")], "path string, start int, end int, new string")
    with pytest.raises(Exception, match="overlapping edits of f0"):
        edits.apply_edits(files(spark, "0123456789"), e).collect()


def test_fix_run_rolls_back_and_takes_later_edits(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef") for _ in range(40)) for _ in range(20)]
    rows = [(f"{k}-{j}", f"f{k}", a := rng.randint(0, 38), a + rng.randint(1, 4), "XYZ"[: rng.randint(0, 3)], j) for k in range(20) for j in range(6)]
    fixes = spark.createDataFrame([r for r in rows if r[3] <= 40], "id string, path string, start int, end int, new string, made_at int")
    after, done, back = edits.apply_fixes(files(spark, *texts), fixes)
    now = {r["path"]: r["new_text"] for r in after.collect()}
    applied = [r for r in done.collect() if r["applied"]]
    assert applied and all(now[r["path"]][r["new_start"] : r["new_end"]] == r["new"] for r in applied)
    restored = edits.apply_edits(after.select("path", F.col("new_text").alias("text")), back.drop("id")).collect()
    assert {r["path"]: r["new_text"] for r in restored} == {f"f{k}": t for k, t in enumerate(texts)}
    asked = spark.createDataFrame([(str(k), f"f{k}", p, p + 1, "#") for k in range(20) for p in (0, 20, 39)], "id string, path string, start int, end int, new string")
    for r in edits.rebase_over(asked, done).collect():
        old_start = next(p for p in (0, 20, 39) if all(not (f["start"] < p + 1 and p < f["end"]) for f in applied if f["path"] == r["path"]) and r["start"] == p + sum(f["new_end"] - f["new_start"] - f["end"] + f["start"] for f in applied if f["path"] == r["path"] and f["start"] <= p))
        assert now[r["path"]][r["start"] : r["end"]] == texts[int(r["id"])][old_start]


def closure(edges):
    reach = {a: {b for x, b in edges if x == a} for a in {n for e in edges for n in e}}
    while True:
        more = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
        if more == reach:
            return reach
        reach = more


def test_depths_and_ways_with_cycles(spark):
    rng = random.Random(6)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (6, 4), (7, 8)] + [(a, b) for a, b in ((rng.randint(20, 45), rng.randint(20, 45)) for _ in range(28))]
    reach = closure(edges)
    part = {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in reach}
    size = {c: sum(p == c for p in part.values()) for c in part.values()}
    arcs = {(part[a], part[b]) for a, b in edges if part[a] != part[b]}

    def depth(c):
        return size[c] - 1 + max([1 + depth(d) for s, d in arcs if s == c], default=0)

    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: (r["depth"], r["recursive"]) for r in graph.longest_depths(df).collect()}
    assert got == {n: (depth(part[n]), n in reach[n]) for n in reach}
    top = max(map(depth, size))
    tight = {(a, b) for a, b in arcs if depth(a) == size[a] + depth(b)}
    on, todo = set(), [c for c in size if depth(c) == top]
    while todo:
        c = todo.pop()
        for a, b in tight:
            if a == c and (a, b) not in on:
                on.add((a, b))
                todo.append(b)
    assert {(r["src"], r["dst"]) for r in graph.longest_ways(df).collect()} == on


def test_patterns_of_several_edges(spark):
    rng = random.Random(7)
    edges = {(rng.randint(0, 12), rng.randint(0, 12), rng.choice("xyz")) for _ in range(120)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long, kind string")
    pattern = [("a", "x", "b"), ("b", "y", "c"), ("c", "z", "a"), ("c", "x", "d")]
    nodes = {n for s, d, _ in edges for n in (s, d)}
    expected = {(a, b, c, d) for a, b, c, d in product(nodes, repeat=4) if len({a, b, c, d}) == 4 and all(e in edges for e in ((a, b, "x"), (b, c, "y"), (c, a, "z"), (c, d, "x")))}
    assert {tuple(r) for r in graph.match_pattern(df, pattern).select("a", "b", "c", "d").collect()} == expected
    with pytest.raises(ValueError):
        graph.match_pattern(df, [("a", "x", "b"), ("c", "y", "d")])


def test_approximate_path_length(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(150)]
    df = spark.createDataFrame(edges, "src long, dst long")
    exact = graph.mean_path_length(df, df.select(F.col("src").alias("node")).union(df.select("dst"))).collect()[0]
    near = graph.approximate_path_length(df).collect()[0]
    assert near["pairs"] == pytest.approx(exact["pairs"], rel=0.03) and near["mean_length"] == pytest.approx(exact["mean_length"], rel=0.03)


def test_analyzers(spark):
    analyzers.register(spark, "upgrade_test", analyzers.rule_analyzer(analyzers.UPGRADE_RULES, (".cs",)))
    text = "using NUnit.Framework;\n[TestFixture]\nclass A {\n  [SetUp] void S() {}\n  void T() { Assert.True(string.IsNullOrEmpty(s)); Assert.AreEqual(1, x); }\n}"
    f = spark.createDataFrame([("a.cs", text), ("b.txt", text), ("c.cs", None)], "path string, text string")
    rows = {(r["path"], r["rule"], r["line"], r["column"], r["fix"]) for r in analyzers.analyze(f, "upgrade_test").collect()}
    assert rows == {
        ("a.cs", "NUNIT006", 1, 1, None), ("a.cs", "NUNIT001", 2, 1, "[Test]"), ("a.cs", "NUNIT003", 4, 3, None),
        ("a.cs", "NUNIT005", 5, 14, None), ("a.cs", "NUNIT002", 5, 52, "Assert.That(x, Is.EqualTo(1))"),
    }
    assert analyzers.analyze(f, "upgrade_test", ["NUNIT001"]).count() == 1
    with pytest.raises(AnalysisException, match="no such rules"):
        analyzers.analyze(f, "upgrade_test", ["NUNIT999"]).collect()
    f.createOrReplaceTempView("analyzed")
    assert spark.sql("SELECT rule FROM upgrade_test(TABLE(SELECT path, text FROM analyzed) PARTITION BY path)").count() == 5


def test_sketches_replace_and_merge(spark):
    e = spark.range(400).selectExpr("id % 4 as file", "id % 90 as value")
    kept = index.distinct_sketches(e, ["file"], "value")
    again = index.distinct_sketches(e.filter("file = 2 and value < 10"), ["file"], "value")
    merged = index.merged_sketches(index.replace_sketches(kept, again, ["file"]), [], "n").collect()[0]["n"]
    left = {(k % 90) for k in range(400) if k % 4 != 2 or k % 90 < 10}
    assert merged == len(left)


def test_operation_lives_resume_from_the_checkpoint(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "key long, at string, event string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("key long, at timestamp, event string").parquet(str(tmp_path / "in"))
        lives = lifecycle.operation_lives(stream, ["done"], ["broken"], ["pause"], "1 hour", "10 minutes")
        windows.run_once(lives, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {(r["key"], r["events"], r["paused_ms"], r["status"]) for r in spark.read.schema(lives.schema).parquet(str(tmp_path / "out")).collect()}

    put([(1, "2024-01-01 10:00:00", "start"), (1, "2024-01-01 10:10:00", "pause"), (2, "2024-01-01 10:00:00", "start"), (2, "2024-01-01 10:20:00", "broken"), (3, "2024-01-01 10:05:00", "start")])
    assert run() == {(2, 2, 0, "failed")}
    put([(1, "2024-01-01 10:40:00", "go"), (1, "2024-01-01 10:41:00", "done"), (4, "2024-01-01 12:00:00", "start")])
    assert run() == {(2, 2, 0, "failed"), (1, 4, 1_800_000, "finished"), (3, 1, 0, "abandoned")}


def test_tokens_that_declare_or_bound_nothing_end_before_the_scopes(spark):
    body = "if (a > 1) { x = a + b * c - d / e; }\n" * 200
    f = files(spark, "namespace A.B { class C { void M(int q) {\n" + body + "} } }")
    assert code._candidates(code.tokens(f)).count() < code.tokens(f).count() / 3
    assert {(r["kind"], r["name"], r["end_line"], r["parameters"]) for r in code.declarations(f).collect()} == {
        ("namespace", "A.B", 202, None), ("class", "C", 202, None), ("method", "M", 202, 1),
    }


def test_the_fold_of_a_method_skips_tokens_without_effect(spark):
    words = "if ( a ) b ( ) ; else c ; x . y = z ; while ( q && r ) { s ; }".split()
    df = spark.createDataFrame([(words,)], "words array<string>").select(code.nesting_fold(F.col("words")).alias("m"))
    assert tuple(df.collect()[0]["m"]) == (2, 1, 4) and not {"a", "x", ".", "="} & set(code.FOLDED)


def test_text_references_deal_files_out_however_few_parts_they_come_in(spark):
    f = spark.createDataFrame([(f"f{k}", f"x = new Cart{k} (1); 1st ; Cart{k}.Go, Cart{k};") for k in range(40)], "path string, text string").coalesce(1)
    names = spark.createDataFrame([("Cart7",), ("1st",), ("Go",)], "name string")
    found = code.text_references(f, names)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["name"], r["path"]) for r in found.collect() if r["name"] != "1st") == [("Cart7", "f7"), *sorted(("Go", f"f{k}") for k in range(40))]
    assert found.filter("name = '1st'").count() == 40


def test_text_references_do_not_pass_names_through_the_driver(spark):
    f = spark.createDataFrame([(f"f{k}", f"x = new Cart{k} (1);") for k in range(40)], "path string, text string")
    found = code.text_references(f, spark.createDataFrame([("Cart7",), ("Cart7",), (None,)], "name string"))
    assert [tuple(r) for r in found.collect()] == [("Cart7", "f7", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_diffs_move_hashes_and_bring_texts_back(spark):
    old, new = files(spark, "a\n\nb " * 3 + "\nold end", "same", "gone\n"), files(spark, "first\n" + "a\n\nb " * 3, "same", None)
    assert [t for c, t in diff._hashed(old, "old").dtypes if t == "string"] == ["string"]  # the path alone
    rows = {(r["path"], r["op"], r["old_no"] or r["new_no"], r["line"]) for r in diff.aligned_diff(old, new).collect()}
    assert {r for r in rows if r[0] == "f0"} == {("f0", "+", 1, "first"), ("f0", "-", 8, "old end")}
    assert {r for r in rows if r[0] != "f0"} == {("f2", "-", 1, "gone"), ("f2", "-", 2, "")}
