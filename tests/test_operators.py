"""Small fixtures: what the operators do on graphs, texts and edits that fit on a page."""

import pytest
from pyspark.sql import functions as F

from sedimark.functions import text
from sedimark.operators import config, duplicates, edits, evolution, graph, index, search, transform
from sedimark.operators.components import connected_components
from sedimark.sources import files as sources


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_chain_is_bounded_by_depth(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    assert found(graph.reachable(e, nodes(spark, [1]), "forward", 2), "node", "depth") == [(1, 0), (2, 1), (3, 2)]
    assert found(graph.reachable(e, nodes(spark, [3]), "backward"), "node") == [(1,), (2,), (3,)]


def test_shortest_path_is_shortest_through_a_diamond(spark):
    e = edges(spark, [(1, 2), (2, 4), (1, 3), (3, 5), (5, 4), (4, 1)])
    paths = graph.shortest_paths(e, nodes(spark, [1]), nodes(spark, [4]), 5)
    assert [r["path"] for r in paths.collect()] == [[1, 2, 4]]


def test_cycles_and_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6)])
    assert sorted(r["path"] for r in graph.cycles(e, 3).collect()) == [[1, 2, 3], [5], [6, 7]]
    assert found(graph.strong_components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
    assert found(connected_components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)]


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(k, k + 1) for k in range(1, 60)] + [(100, None), (None, 3)])
    assert {r["component"] for r in connected_components(e).collect()} == {1}
    assert connected_components(edges(spark, [])).count() == 0


def test_entry_points_leaves_and_isolated(spark):
    e, n = edges(spark, [(1, 2), (1, 2)]), nodes(spark, [1, 2, 3])
    assert found(graph.entry_points(e, n), "node") == [(1,), (3,)]
    assert found(graph.leaves(e, n), "node") == [(2,), (3,)]
    row = graph.graph_metrics(e, n).collect()[0]
    assert (row["edges"], row["isolated"]) == (1, 1)


def symbols(spark):
    rows = [(1, 1, "TestClass", "Class", "A"), (2, 1, "TestMethod", "Method", "A"), (3, 2, "AnotherClass", "Class", None), (4, 2, "50%_off", "Method", "B")]
    return spark.createDataFrame(rows, "id long, file_id long, name string, kind string, namespace string")


def test_symbol_lookups(spark):
    s = symbols(spark)
    assert index.symbols_by_name(s, "test").count() == 2
    assert index.symbols_by_name(s, "test", "Class").count() == 1
    assert index.symbols_by_name(s, "%_").count() == 4  # wildcards stay wildcards
    assert index.search_symbols(s, "Test", ["Class"], ["A"]).count() == 1
    assert index.search_symbols(s).count() == 4


def test_upsert_keeps_ids_and_updates_nulls(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, path string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "path string, v string")
    assert sorted(map(str, found(index.upsert(stored, new, ["path"], "id"), "id", "path", "v"))) == ["(1, 'a', 'x')", "(2, 'b', None)", "(3, 'c', 'z')"]
    kept = index.partial_update(stored.drop("id"), new, "path")
    assert found(kept, "path", "v") == [("a", "x"), ("b", "y")]


def test_delete_cascades_over_both_ends(spark):
    s = symbols(spark)
    r = spark.createDataFrame([(1, 3), (3, 4), (1, 2)], "from_id long, to_id long")
    f = spark.createDataFrame([(1,), (2,)], "id long")
    left = index.delete_files(f, s, r, f.filter("id = 1"))
    assert [d.count() for d in left] == [1, 2, 1]


def texts(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_search_takes_the_first_match_of_a_line(spark):
    f = texts(spark, [("a.txt", "test test test\nnone\nTEST"), ("b.txt", "")])
    hits = search.matches(f, "test")
    assert found(hits, "path", "line_no", "column_no") == [("a.txt", 1, 1)]
    assert search.matches(f, "test", case_sensitive=False).count() == 2
    row = search.with_context(f, hits).collect()[0]
    assert (row["context_before"], row["context_after"]) == ([], ["none", "TEST"])
    assert search.matches(f, r"t(es)t$", regex=True).collect()[0]["column_no"] in (1, 11)


def test_file_selection(spark):
    f = texts(spark, [("src/A.cs", ""), ("bin/B.cs", ""), ("src/c.txt", "")])
    assert found(search.select_files(f, "*.CS"), "path") == [("src/A.cs",)]
    assert found(search.select_files(f, exclude="*.cs"), "path") == [("src/c.txt",)]


def test_binary_sniff(spark):
    rows = [("a.PNG", b"x"), ("b", b"\x10\x01"), ("c", b"a\x00"), ("d", None), ("e", b"x" * 600 + b"\x00"), ("f", b"")]
    f = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    assert found(f.filter(search.looks_binary(F.col("path"), F.col("content"))), "path") == [("a.PNG",), ("c",), ("d",)]


def test_edits(spark):
    f = texts(spark, [("a", "0123456789"), ("b", "x")])
    e = spark.createDataFrame([("a", 0, 1, "A"), ("a", 5, 5, "+")], "path string, start int, end int, new string")
    assert found(edits.apply_edits(f, e), "path", "new_text") == [("a", "A1234+56789"), ("b", "x")]
    r = spark.createDataFrame([(1, "a", 0, 5), (2, "a", 5, 6), (3, "a", 7, 9), (4, "a", 7, 8)], "id int, path string, start int, end int")
    assert found(edits.conflicts(r), "a_id", "b_id") == [(1, 2), (3, 4)]
    done = edits.bulk_replace(texts(spark, [("a", "x\nx"), ("b", "y")]), "^x", "z")
    assert found(done, "path", "new_text", "n_matches", "changed") == [("a", "z\nz", 2, True), ("b", "y", 0, False)]


def test_custom_condition_never_holds(spark):
    f = texts(spark, [("a", "t")])
    assert f.filter(edits.condition("custom")).count() == 0
    assert f.filter(edits.condition("custom", negate=True)).count() == 1


def test_config_flatten_and_conflicts(spark):
    d = spark.createDataFrame([(1, '{"A": {"B": 1, "C": [true, null]}}'), (2, '{"a": {"b": 2}, "E": {}}'), (3, "no json")], "doc int, content string")
    flat = config.flatten(d)
    assert found(flat, "doc", "key", "kind") == [(1, "A:B", "integer"), (1, "A:C:0", "boolean"), (1, "A:C:1", "null"), (2, "E", "object"), (2, "a:b", "integer")]
    flat = flat.withColumn("seq", F.col("doc"))
    assert found(config.merge_conflicts(flat), "key", "before", "after") == [("a:b", "1", "2")]
    assert dict(found(config.merge(flat), "key", "value"))["a:b"] == "2"


def test_schema_evolution(spark):
    log = spark.createDataFrame(
        [(1, "m1", "CreateTable", "T"), (2, "m2", "CreateTable", "U"), (3, "m3", "DropTable", "T")], "seq int, name string, op string, table_name string"
    )
    assert found(evolution.schema_difference(evolution.schema_at(log, 2), evolution.schema_at(log, 3)), "table_name", "change") == [("T", "Drop")]
    assert found(evolution.breaking_changes(log), "name", "severity", "previous") == [("m3", "Critical", "m1")]
    assert found(evolution.dependencies(log), "name", "depends_on") == [("m3", "m1")]


def test_near_duplicates_need_equal_lines_in_place(spark):
    rows = [(1, "a", "k", 3, 1, "x\ny\nz"), (2, "b", "k", 3, 1, "x\ny\nw"), (3, "c", "k", 3, 1, "y\nx\nz"), (4, "d", "k", 3, 1, "x\ny\nz")]
    b = spark.createDataFrame(rows, "id long, path string, group_key string, n_lines int, complexity int, text string")
    assert found(duplicates.exact_groups(b), "first_id", "copies") == [(1, 2)]
    assert [(r["a"], r["b"]) for r in duplicates.near_pairs(b, 0.6).collect()] == [(1, 2)]


def test_transforms(spark):
    d = spark.createDataFrame([("a", 1, ' "x, y" ,b')], "path string, line_no int, line string").withColumn("line", F.trim("line"))
    assert transform.process_csv(d, [1, 0], 2).collect()[0]["line"] in ("b,x, y",)
    b = spark.createDataFrame([("a", bytearray(b"\x00\x01\x00\x01")), ("n", None)], "path string, content binary")
    rows = {r["path"]: (bytes(r["content"]), r["replaced"]) for r in transform.replace_bytes(b, b"\x01\x00", b"!").collect()}
    assert rows == {"a": (b"\x00!\x01", 1), "n": (b"", 0)}


def test_text_functions(spark):
    d = spark.createDataFrame([("// c\nint foo = 1; /* x */ bar",)], "t string")
    assert d.select(text.normalise_code(F.col("t"))).collect()[0][0] == "IDENTIFIER IDENTIFIER = 1; IDENTIFIER"
    assert spark.range(1).select(text.truncate(F.lit("a" * 50), 30)).collect()[0][0] == "a" * 15 + "... [truncated]"
    assert spark.range(1).select(text.similarity(F.lit(""), F.lit(""))).collect()[0][0] == 1.0


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "app.json").write_text("{}")
    (tmp_path / ".hidden").write_text("x")
    listing = sources.list_files(spark, f"file://{tmp_path}")
    assert [r["path"].rpartition("/")[2] for r in listing.collect()] == ["app.json"]
    assert sources.discover(listing).count() == 1
    assert sources.read_text(spark, f"file://{tmp_path}", "*.json").collect()[0]["text"] == "{}"


def test_workflows(spark):
    good = "name: CI\non: [push, pull_request]\njobs:\n  build:\n    steps:\n      - uses: actions/setup\n        with: {v: 6.0}\n      - run: echo ${{ secrets.KEY }} 6.0\n"
    f = texts(spark, [("w.yml", good), ("bad.yml", "a: [")])
    row = sources.parse_workflows(f).collect()
    assert len(row) == 1 and row[0]["triggers"] == ["push", "pull_request"] and row[0]["secrets"] == ["KEY"]
    assert row[0]["jobs"][0]["runs_on"] == "ubuntu-latest"
    p = spark.createDataFrame([("p", "net8.0")], "path string, framework string")
    assert sources.workflow_issues(sources.parse_workflows(f), p).count() == 1


def test_file_stream_resumes(spark, tmp_path):
    from sedimark.streaming import file_stream

    inputs = tmp_path / "in"
    inputs.mkdir()
    (inputs / "a.txt").write_text("one\ntwo\n")
    run = lambda: file_stream.process(
        spark, f"file://{inputs}", f"file://{tmp_path}/out", f"file://{tmp_path}/state", lambda d: d.withColumn("line", F.upper("line"))
    )
    q = run()
    q.awaitTermination()
    (inputs / "b.txt").write_text("three\n")
    q = run()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["ONE", "THREE", "TWO"]
    assert file_stream.statistics(q)["rows"] == 1


@pytest.mark.parametrize("pattern", ["CreateTable(\n name: \"T\", x)", "createtable( name: 'T')"])
def test_parse_steps(spark, pattern):
    f = spark.createDataFrame([(1, "m", pattern)], "seq int, name string, text string")
    assert found(evolution.parse_steps(f), "op", "table_name") == [("CreateTable", "T")]


def test_merged_bitmaps_are_exact_beyond_what_sketches_are(spark):
    e = spark.range(60_000).selectExpr("id % 4 as file", "case when id % 7 = 0 then null else id * 5 - 70000 end as value")
    again = index.distinct_bitmaps(e.filter("file = 2 and value < 10000"), ["file"], "value")
    kept = index.replace_sketches(index.distinct_bitmaps(e, ["file"], "value"), again, ["file"])
    left = [k for k in range(60_000) if k % 7 and (k % 4 != 2 or k * 5 - 70000 < 10000)]
    assert index.merged_bitmaps(kept, [], "n").collect()[0]["n"] == len(left)
    assert {r["file"]: r["n"] for r in index.merged_bitmaps(kept, ["file"], "n").collect()} == {f: sum(k % 4 == f for k in left) for f in range(4)}


def test_two_hop_with_sources_of_many_targets(spark, monkeypatch):
    pairs = [(a, b) for a in range(12) for b in range(12) if (a * 7 + b * 3) % 5 < 2] + [(3, b) for b in range(12)] + [(1, 1)]
    kept = {(a, v, b) for a, v in pairs for w, b in pairs if w == v and a != b and (a, b) not in set(pairs)}
    for chunk in (1024, 4, 1):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        assert {tuple(r) for r in graph.two_hop(edges(spark, pairs).union(edges(spark, [(None, 2), (2, None)]))).collect()} == kept
