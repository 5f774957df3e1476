"""Queries over file sources, project and workflow texts, and streams of files, made from the sample tables.

File texts come from rows of the tables; queries that need files write them to the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.sources import files as sources
from sedimark.storage import new_path, table
from sedimark.streaming import file_stream, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nation_files(spark, sf):
    """One text file a nation, in a folder by its key."""
    folder = new_path(spark, "files")
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return folder


def _key(path="path"):
    return F.regexp_extract(path, r"n_nationkey=(\d+)", 1).cast("long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, length(n_name) + length(CAST(n_regionkey AS VARCHAR)) + 2 AS size FROM nation")
def file_list(spark, sf):
    found = sources.list_files(spark, _nation_files(spark, sf), "*.txt")
    return found.select(_key().alias("n_nationkey"), "size")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || chr(10) || n_regionkey || chr(10) AS text FROM nation")
def file_read(spark, sf):
    found = sources.read_text(spark, _nation_files(spark, sf), "*.txt")
    return found.select(_key().alias("n_nationkey"), "text")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, sha256(n_name || chr(10) || n_regionkey || chr(10)) AS hash FROM nation WHERE length(n_name) + length(CAST(n_regionkey AS VARCHAR)) + 2 <= 11")
def file_read_binary(spark, sf):
    found = sources.read_binary(spark, _nation_files(spark, sf), "*.txt", largest=11)
    return found.select(_key().alias("n_nationkey"), F.sha2("content", 256).alias("hash"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 7")
def bulk_file_resolve(spark, sf):
    folder = _nation_files(spark, sf)
    found = sources.resolve_inputs(spark, [f"{folder}/n_nationkey=[0-9]", f"{folder}/n_nationkey=3"], exclude="n_nationkey=7/")
    return found.select(_key().alias("n_nationkey"))


PATHS = """l AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '/app/obj/' WHEN 1 THEN '/app/Migrations/' ELSE '/app/' END || c_name || CASE c_custkey % 3 WHEN 0 THEN '.JSON' WHEN 1 THEN '.yml' ELSE '.cs' END AS path FROM customer)"""


def _listing(spark, sf):
    k = F.col("c_custkey")
    folder = F.when(k % 5 == 0, "/app/obj/").when(k % 5 == 1, "/app/Migrations/").otherwise("/app/")
    ending = F.when(k % 3 == 0, ".JSON").when(k % 3 == 1, ".yml").otherwise(".cs")
    return table(spark, sf, "customer").select(F.concat(folder, "c_name", ending).alias("path"))


@query(f"WITH {PATHS} SELECT path FROM l WHERE c_custkey % 3 <> 2 AND c_custkey % 5 <> 0")
def config_discovery(spark, sf):
    return sources.discover(_listing(spark, sf))


@query(f"WITH {PATHS} SELECT path FROM l WHERE c_custkey % 3 = 2 AND c_custkey % 5 = 1")
def migration_discovery(spark, sf):
    return sources.discover_migrations(_listing(spark, sf))


@query("SELECT 'p' || p_partkey || '.csproj' AS path, unnest(['../p' || (p_partkey // 3) || '.csproj', '../p' || p_size || '.csproj']) AS target FROM part")
def project_reference_parse(spark, sf):
    text = F.format_string('<Project><ProjectReference Include="../p%d.csproj" />\n<ProjectReference Include="../p%d.csproj"/></Project>', F.expr("p_partkey div 3"), "p_size")
    return sources.project_references(table(spark, sf, "part").select(F.format_string("p%d.csproj", "p_partkey").alias("path"), text.alias("text")))


PROJECTS = """d AS (SELECT 'p' || p_partkey || '.csproj' AS path, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN ['net8.0', 'net9.0'] ELSE ['net8.0'] END AS frameworks,
replace(p_brand, '#', '') AS package, (p_size % 3) || '.0.1' AS version FROM part)"""


def _project_details(spark, sf):
    """A project a part: one or two frameworks, a package of its brand by attribute, every other one Central without a version, one in a comment."""
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    frameworks = F.when(F.col("p_partkey") % 3 == 0, "<TargetFrameworks>net8.0; net9.0</TargetFrameworks>").otherwise("<TargetFramework>net8.0</TargetFramework>")
    version = F.concat((F.col("p_size") % 3).cast("string"), F.lit(".0.1"))
    inner = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' Version="'), version, F.lit('" />'))).otherwise(F.concat(F.lit(">\n  <Version>"), version, F.lit("</Version>\n</PackageReference>")))
    text = F.concat(
        F.lit('<Project Sdk="Sdk.Web"><PropertyGroup><OutputType>Exe</OutputType>'), frameworks, F.lit('</PropertyGroup>\n<!-- <PackageReference Include="Gone" Version="1.0" /> -->\n<PackageReference Include="'),
        brand, F.lit('"'), inner, F.when(F.col("p_partkey") % 2 == 0, '\n<PackageReference Include="Central" />').otherwise(""), F.lit("</Project>"),
    )
    return sources.project_details(table(spark, sf, "part").select(F.format_string("p%d.csproj", "p_partkey").alias("path"), text.alias("text")))


@query(f"""WITH {PROJECTS} SELECT path, 'Sdk.Web' AS sdk, 'Exe' AS output_type, array_to_string(frameworks, ',') AS frameworks,
package || '=' || version || CASE WHEN k % 2 = 0 THEN ',Central=' ELSE '' END AS packages FROM d""")
def project_details(spark, sf):
    each = F.transform("packages", lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["version"], F.lit(""))))
    return _project_details(spark, sf).select("path", "sdk", "output_type", F.array_join("frameworks", ",").alias("frameworks"), F.array_join(each, ",").alias("packages"))


@query(f"""WITH {PROJECTS}, e AS (SELECT unnest(frameworks) AS framework, path, package, k FROM d)
SELECT framework, count(DISTINCT path) AS projects, count(DISTINCT package) + CASE WHEN bool_or(k % 2 = 0) THEN 1 ELSE 0 END AS packages FROM e GROUP BY framework""")
def framework_usage(spark, sf):
    return sources.framework_usage(_project_details(spark, sf))


@query(f"""WITH {PROJECTS} SELECT package, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, count(DISTINCT path) AS projects FROM d GROUP BY package HAVING count(DISTINCT version) > 1""")
def package_conflicts(spark, sf):
    return sources.package_conflicts(_project_details(spark, sf)).withColumn("versions", F.array_join("versions", ","))


def _solutions(spark, sf):
    """A solution a brand, listing the parts of even key."""
    line = F.format_string('Project("{F}") = "%s", "p%d.csproj", "{G}"', "p_name", "p_partkey")
    rows = table(spark, sf, "part").filter("p_partkey % 2 = 0").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(line)), "\nEndProject\n").alias("text"))
    return sources.solution_projects(rows.select(F.concat("p_brand", F.lit(".sln")).alias("path"), "text"))


@query("SELECT p_brand || '.sln' AS path, p_name AS name, 'p' || p_partkey || '.csproj' AS project FROM part WHERE p_partkey % 2 = 0")
def solution_parse(spark, sf):
    return _solutions(spark, sf)


@query("SELECT 'p' || p_partkey || '.csproj' AS path FROM part WHERE p_partkey % 2 = 1")
def standalone_projects(spark, sf):
    projects = table(spark, sf, "part").select(F.format_string("p%d.csproj", "p_partkey").alias("path"))
    return sources.standalone(projects, _solutions(spark, sf))


@query("""SELECT path, projects, CASE WHEN path LIKE '/app/%/%' THEN 0 ELSE 100 END + CASE WHEN path LIKE '%/Brand#3.sln' THEN 50 ELSE 0 END + projects AS score
FROM (SELECT CASE WHEN p_size > 25 THEN '/app/' ELSE '/app/sub/' END || p_brand || '.sln' AS path, count(*) AS projects FROM part GROUP BY 1)""")
def solution_ranking(spark, sf):
    path = F.concat(F.when(F.col("p_size") > 25, "/app/").otherwise("/app/sub/"), "p_brand", F.lit(".sln"))
    return sources.rank_solutions(table(spark, sf, "part").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("projects")), "/app", "brand#3")


def _workflows(spark, sf):
    text = F.format_string(
        "name: build %d\non: [push, %s]\nenv:\n  MODE: %s\njobs:\n  test:\n    runs-on: ubuntu\n    steps:\n      - uses: setup-dotnet@%d.0\n      - name: run\n        run: echo ${{ secrets.KEY }}\n",
        "o_orderkey", F.lower("o_orderstatus"), "o_orderpriority", F.expr("6 + o_orderkey % 3"),
    )
    return sources.parse_workflows(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'build ' || o_orderkey AS name, 'push,' || lower(o_orderstatus) AS triggers, o_orderpriority AS mode, 'setup-dotnet@' || (6 + o_orderkey % 3) || '.0' AS step, 'KEY' AS secrets FROM orders")
def workflow_parse(spark, sf):
    w = _workflows(spark, sf)
    step = F.col("jobs")[0]["steps"][0]["name"]
    return w.select("path", "name", F.array_join("triggers", ",").alias("triggers"), F.col("env")["MODE"].alias("mode"), step.alias("step"), F.array_join("secrets", ",").alias("secrets"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'test' AS job, CAST(6 + o_orderkey % 3 AS VARCHAR) AS version, 'net8.0' AS framework FROM orders WHERE o_orderkey % 3 <> 2")
def workflow_check(spark, sf):
    projects = spark.createDataFrame([("a.csproj", "net8.0")], "path string, framework string")
    return sources.workflow_issues(_workflows(spark, sf), projects)


# ---------------------------------------------------------------- streams


@query("SELECT upper(n_name) AS line FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation")
def stream_file_transform(spark, sf):
    folder = _nation_files(spark, sf)
    output, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-check")
    for _ in range(2):  # the second run finds nothing new
        file_stream.process(spark, f"{folder}/*", output, checkpoint, lambda lines: lines.withColumn("line", F.upper("line")), max_files=10).awaitTermination()
    return spark.read.text(output).select(F.col("value").alias("line"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark, sf):
    output, checkpoint, folder = (new_path(spark, f"windows-{k}") for k in ("out", "check", "in"))
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    windows.run_once(windows.window_counts(stream, "ts", "1 hour"), output, checkpoint).awaitTermination()
    return spark.read.parquet(output).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})
