"""Queries over configuration documents and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.operators import config, evolution
from sedimark.storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- configuration

# Each event becomes a nested document: {"App": {"Level": type, "Auth": {"k": n}}, "List": [n, type]}
DOCUMENTS = """d AS (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k, ts FROM events)"""
FLAT = f"""{DOCUMENTS}, flat AS (
SELECT event_id AS doc, 'App:Level' AS key, event_type AS value, 'string' AS kind, ts FROM d UNION ALL SELECT event_id, 'App:Auth:k', CAST(k AS VARCHAR), 'integer', ts FROM d
UNION ALL SELECT event_id, 'List:0', CAST(k AS VARCHAR), 'integer', ts FROM d UNION ALL SELECT event_id, 'List:1', event_type, 'string', ts FROM d)"""


def _documents(spark, sf):
    e = table(spark, sf, "events")
    content = F.format_string('{"App": {"Level": "%s", "Auth": %s}, "List": [%s, "%s"]}', "event_type", "props", F.get_json_object("props", "$.k"), "event_type")
    return e.select(F.col("event_id").alias("doc"), content.alias("content"), F.struct("ts", "event_id").alias("seq"), "user_id")


def _flat(spark, sf):
    return config.flatten(_documents(spark, sf), 4)


@query(f"WITH {FLAT} SELECT doc, key, value, kind FROM flat")
def config_flatten(spark, sf):
    return _flat(spark, sf)


@query(f"WITH {FLAT} SELECT key, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(DISTINCT doc) AS documents FROM flat GROUP BY key")
def config_schema(spark, sf):
    return config.infer_schema(_flat(spark, sf)).withColumn("kinds", F.array_join("kinds", ","))


@query(f"WITH {FLAT} SELECT lower(key) AS key, arg_max(value, (ts, doc)) AS value FROM flat GROUP BY 1")
def config_merge(spark, sf):
    flat = _flat(spark, sf).join(_documents(spark, sf).select("doc", "seq"), "doc")
    return config.merge(flat)


@query(f"""WITH {FLAT}, w AS (SELECT f.doc, f.key, f.value, e.user_id, lag(f.value) OVER (PARTITION BY e.user_id, lower(key) ORDER BY f.ts, doc) AS before, row_number() OVER (PARTITION BY e.user_id, lower(key) ORDER BY f.ts, doc) AS n FROM flat f JOIN events e ON e.event_id = f.doc)
SELECT user_id || '/' || lower(key) AS key, doc AS seq, before, value AS after FROM w WHERE n > 1 AND lower(before) IS DISTINCT FROM lower(value)""")
def config_conflicts(spark, sf):
    d = _documents(spark, sf).select("doc", "seq", "user_id")
    flat = _flat(spark, sf).join(d, "doc").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "key"))
    return config.merge_conflicts(flat).withColumn("seq", F.col("seq.event_id"))


@query(f"WITH {FLAT} SELECT key, count(*) AS n FROM flat WHERE lower(key) LIKE '%auth%' GROUP BY key")
def config_sensitive_keys(spark, sf):
    flat = _flat(spark, sf)
    return flat.filter(config.sensitive(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FLAT} SELECT 'secret' AS issue, count(*) AS n FROM flat WHERE key = 'App:Auth:k' UNION ALL SELECT 'mixed kinds', 0 WHERE false")
def config_checks(spark, sf):
    return config.check(_flat(spark, sf)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- change log

OPS = "['CreateTable', 'AddColumn', 'AlterColumn', 'DropColumn', 'RenameTable', 'CreateIndex', 'DropTable']"
LOG = f"""log AS (SELECT o_orderkey AS seq, 'step' || (o_orderkey - o_orderkey % 3) AS name, ({OPS})[1 + CAST(CAST(o_totalprice AS BIGINT) % 7 AS INT)] AS op, 'T' || o_custkey AS table_name FROM orders)"""
TABLE_OPS = "CASE op WHEN 'DropTable' THEN 'Critical' WHEN 'DropColumn' THEN 'High' WHEN 'AlterColumn' THEN 'Medium' WHEN 'RenameTable' THEN 'High' END"


def _log(spark, sf):
    ops = F.array(*map(F.lit, ("CreateTable", "AddColumn", "AlterColumn", "DropColumn", "RenameTable", "CreateIndex", "DropTable")))
    price = F.round("o_totalprice", 0).cast("long") % 7
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("step"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).cast("string")).alias("name"),
        F.element_at(ops, (price + 1).cast("int")).alias("op"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("table_name"),
    )


LOG = LOG.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice, 0) AS BIGINT)")


@query(f"""WITH {LOG}, b AS (SELECT *, {TABLE_OPS} AS severity, lag(name) OVER (PARTITION BY table_name ORDER BY seq, name) AS previous FROM log)
SELECT seq, name, op, table_name, severity, previous FROM b WHERE severity IS NOT NULL""")
def breaking_changes(spark, sf):
    return evolution.breaking_changes(_log(spark, sf))


@query(f"WITH {LOG} SELECT DISTINCT a.name, b.name AS depends_on FROM log a JOIN log b ON a.table_name = b.table_name AND (b.seq, b.name) < (a.seq, a.name) AND a.name <> b.name")
def migration_dependencies(spark, sf):
    return evolution.dependencies(_log(spark, sf))


@query(f"WITH {LOG} SELECT seq, name, op FROM log WHERE seq BETWEEN 100 AND 300")
def migration_range(spark, sf):
    return evolution.step_range(_log(spark, sf), 100, 300).select("seq", "name", "op")


@query(f"""WITH {LOG}, x AS (SELECT table_name FROM log WHERE seq <= 500 AND op IN ('CreateTable', 'DropTable') GROUP BY 1 HAVING arg_max(op, (seq, name)) = 'CreateTable'),
y AS (SELECT table_name FROM log WHERE seq <= 1200 AND op IN ('CreateTable', 'DropTable') GROUP BY 1 HAVING arg_max(op, (seq, name)) = 'CreateTable')
SELECT coalesce(x.table_name, y.table_name) AS table_name, CASE WHEN x.table_name IS NULL THEN 'Create' ELSE 'Drop' END AS change FROM x FULL JOIN y ON x.table_name = y.table_name WHERE x.table_name IS NULL OR y.table_name IS NULL""")
def schema_evolution(spark, sf):
    log = _log(spark, sf)
    return evolution.schema_difference(evolution.schema_at(log, 500), evolution.schema_at(log, 1200))


@query("""WITH s AS (SELECT CAST(year(o_orderdate) AS INT) AS seq, count(*) AS size FROM orders GROUP BY 1), e AS (SELECT arg_min(size, seq) AS f, arg_max(size, seq) AS l FROM s)
SELECT f AS first, l AS last, l - f AS change, round(100.0 * (l - f) / f, 4) AS percent, CASE WHEN l > f THEN 'Growing' WHEN l < f THEN 'Shrinking' ELSE 'Stable' END AS trend FROM e""")
def schema_growth(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("seq")).agg(F.count(F.lit(1)).alias("size"))
    return evolution.growth(s)


@query(f"WITH {LOG} SELECT name, count(*) AS n FROM log GROUP BY name HAVING count(*) > 1")
def duplicate_migration_names(spark, sf):
    return evolution.repeated_names(_log(spark, sf))


@query(f"""WITH {LOG}, s AS (SELECT count(DISTINCT name) AS steps, count(*) AS operations, count(*) FILTER (op = 'DropTable') AS critical, count(*) FILTER (op IN ('DropColumn', 'RenameTable')) AS high,
count(*) FILTER (op IN ('DropTable', 'DropColumn', 'RenameTable', 'AlterColumn')) AS breaking FROM log)
SELECT *, CASE WHEN critical > 0 THEN 'Critical' WHEN high > 2 OR breaking > 5 THEN 'High' WHEN high > 0 OR breaking > 2 THEN 'Medium' ELSE 'Low' END AS risk FROM s""")
def migration_summary(spark, sf):
    return evolution.summary(_log(spark, sf))


@query(f"""WITH {LOG} SELECT seq, name, CAST(1 + sum(CASE WHEN op IN ('CreateTable', 'Sql') THEN 2.5 ELSE 0.5 END) AS DOUBLE) AS seconds,
CAST(sum(CASE op WHEN 'CreateTable' THEN 1048576 WHEN 'AddColumn' THEN 102400 ELSE 0 END) AS BIGINT) AS bytes, bool_or(op IN ('DropTable', 'AlterColumn')) AS downtime FROM log GROUP BY 1, 2""")
def migration_estimate(spark, sf):
    return evolution.effort(_log(spark, sf)).withColumn("seconds", F.col("seconds").cast("double"))


@query(f"WITH {LOG} SELECT op, count(*) AS n FROM log GROUP BY op")
def operations_by_type(spark, sf):
    return _log(spark, sf).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, back AS (SELECT seq, name, 'Down' AS direction, 'Sql' AS op, 'undo ' || seq AS table_name, NULL AS column_name FROM log)
SELECT seq, name, 'Up' AS direction, op, table_name, CASE WHEN op LIKE '%Column' THEN 'c' || seq END AS column_name FROM log UNION ALL SELECT * FROM back""")
def parse_migrations(spark, sf):
    log = _log(spark, sf)
    up = F.when(F.col("op").endswith("Table"), F.format_string('b.%s( name: "%s", x: "y");', "op", "table_name"))
    up = up.when(F.col("seq") % 2 == 0, F.format_string('b.%s(name: "c%d", table: \'%s\');', "op", "seq", "table_name"))
    up = up.otherwise(F.format_string('b.%s( table: "%s", name: "c%d");', "op", "table_name", "seq"))
    text = F.format_string('void Up(b) {\n%s }\nvoid Down(b) { b.Sql("undo %d"); }', up, "seq")
    return evolution.parse_steps(log.select("seq", "name", text.alias("text")))


@query(f"WITH {LOG}, m AS (SELECT table_name, min(seq) AS made FROM log WHERE op = 'CreateTable' GROUP BY 1) SELECT seq, name, op, table_name, made FROM log JOIN m USING (table_name) WHERE op <> 'CreateTable' AND made < seq")
def implicit_dependencies(spark, sf):
    return evolution.implicit_dependencies(_log(spark, sf))
