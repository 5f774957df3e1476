"""Relations of types, versions of tables, selection, reports and streams in cases that the tables do not have."""

import pytest
from pyspark.sql import functions as F

from sedimark.operators import edits, evolution, graph, history, reports, selection, types
from sedimark.streaming import windows


def test_a_failed_transaction_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    history.create(spark.range(5), folder)
    with pytest.raises(Exception, match="no such column|UNRESOLVED"):
        history.transaction(spark, folder, lambda t: t.select("missing"))
    assert history.current(spark, folder).count() == 5
    assert history.transaction(spark, folder, lambda t: t.filter("id > 2")) == 1
    assert history.current(spark, folder).count() == 2 and history.current(spark, folder, 0).count() == 5


def test_restore_brings_back_lost_and_changed_files_and_checks_digests(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, text string")
    saved = history.backup(f, F.lit("2024-01-01").cast("timestamp"))
    now = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, text string")
    rows = {r["path"]: (r["text"], r["restored"]) for r in history.restore(now, saved).collect()}
    assert rows == {"a": ("1", False), "b": ("2", True), "c": ("3", True), "d": ("4", False)}
    with pytest.raises(Exception, match="backup is damaged"):
        history.restore(now, saved.withColumn("text", F.lit("other"))).collect()
    assert history.unexpired(saved, F.lit("2024-01-08").cast("timestamp")).count() == 3
    assert history.unexpired(saved, F.lit("2024-01-09").cast("timestamp")).count() == 0


def test_cascade_skips_filters_that_leave_nothing(spark):
    c = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 3, "b"), ("y", 4, None)], "name string, id long, kind string")
    left = selection.cascade(c, "name", [F.col("kind") == "a", F.col("id") > 3])
    assert sorted(r["id"] for r in left.collect()) == [1, 4]
    assert [r["id"] for r in selection.best(c.withColumn("score", F.lit(1)), "name", "score", "id").orderBy("id").collect()] == [1, 3]


def test_fallback_takes_the_first_strategy_that_finds(spark):
    some, none = spark.range(2), spark.range(0)
    rows = selection.fallback([("a", lambda: none), ("b", lambda: some), ("c", lambda: some)]).collect()
    assert {(r["strategy"], r["confidence"]) for r in rows} == {("b", "medium")} and len(rows) == 2


def test_longest_depths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3), (5, 1)], "src long, dst long")
    assert {r["node"]: r["depth"] for r in graph.longest_depths(e).collect()} == {3: 0, 2: 1, 4: 1, 1: 2, 5: 3}
    cycle = graph.longest_depths(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")).collect()
    assert {(r["node"], r["depth"], r["recursive"]) for r in cycle} == {(1, 2, True), (2, 2, True), (3, 0, False)}


def test_implementations_through_bases(spark):
    i = spark.createDataFrame([(1, 100, "interface"), (2, 1, "base"), (3, 2, "base"), (4, 200, "interface")], "child long, parent long, kind string")
    assert sorted(r["node"] for r in types.implementations(i, spark.createDataFrame([(100,)], "node long")).collect()) == [1, 2, 3]


def test_three_steps_on_one_table_depend_on_all_before(spark):
    log = spark.createDataFrame([(1, "a", "CreateTable", "t"), (2, "b", "AddColumn", "t"), (3, "c", "DropColumn", "t"), (3, "c", "AddColumn", "u")], "seq long, name string, op string, table_name string")
    assert sorted(tuple(r) for r in evolution.dependencies(log).collect()) == [("b", "a"), ("c", "a"), ("c", "b")]
    assert sorted(r["name"] for r in evolution.implicit_dependencies(log).collect()) == ["b", "c"]


def test_steps_are_parsed_in_any_order_of_arguments(spark):
    text = """protected override void Up(M b) { b.CreateTable( name: "users", c => x); b.AddColumn<string>(name: "mail", table: "users");
    b.dropcolumn(table: 'users', name: 'age'); b.AddColumn("nick", "users"); b.Other("x"); }
    protected override void Down(M b) { b.Sql("DELETE"); b.DropTable(name: "users"); }"""
    rows = evolution.parse_steps(spark.createDataFrame([(1, "s", text)], "seq long, name string, text string")).collect()
    assert {tuple(r)[2:] for r in rows} == {
        ("Up", "CreateTable", "users", None), ("Up", "AddColumn", "users", "mail"), ("Up", "DropColumn", "users", "age"), ("Up", "AddColumn", "users", "nick"),
        ("Down", "Sql", "DELETE", None), ("Down", "DropTable", "users", None),
    }


def test_conflicts_are_resolved_by_age(spark):
    rows = [(1, "p", 0, 10, 5), (2, "p", 5, 15, 3), (3, "p", 20, 30, 9), (4, "q", 0, 10, 1)]
    e = spark.createDataFrame(rows, "id long, path string, start long, end long, made_at long")
    kept = {p: sorted(r["id"] for r in edits.resolve_conflicts(e, p).collect()) for p in ("older", "newer", "none")}
    assert kept == {"older": [2, 3, 4], "newer": [1, 3, 4], "none": [3, 4]}


def test_truncation_to_a_budget(spark):
    one = spark.range(1)
    m = F.create_map(*[F.lit(x) for kv in (("k", "v"), ("long", "x" * 400)) for x in kv])
    got = one.select(reports.truncate_object(m, 20).alias("o"), reports.truncate_object(m, 1000).alias("all"), reports.truncate_array(F.array(F.lit("y" * 400)), 5).alias("a")).collect()[0]
    assert got["o"] == {"k": "v", "__truncated__": "Original had 2 properties"} and len(got["all"]) == 2 and got["a"] == ["y" * 400]


@pytest.mark.parametrize("form", ["json", "csv", "markdown", "html"])
def test_reports_are_written(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, "a|b<c"), (2, None)], "id long, text string")
    reports.export(rows, f"{tmp_path}/{form}", form)
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/{form}").collect())
    assert {"json": '"text":"a|b<c"', "csv": "a|b<c", "markdown": "a\\|b", "html": "a|b&lt;c"}[form] in text


def test_windows_on_a_stream_drop_late_events(spark, tmp_path):
    for k, at in enumerate(["2024-01-01 00:10", "2024-01-01 08:00", "2024-01-01 00:20"]):
        spark.createDataFrame([(at, 1.0)], "at string, value double").selectExpr("cast(at as timestamp) ts", "value").write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/in/*")
        windows.run_once(windows.window_counts(stream, "ts", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = [(str(r["start"]), r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert rows == [("2024-01-01 00:00:00", 1)]
