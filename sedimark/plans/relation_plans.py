"""Queries over relations of types, versions of tables, selection, reports and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import scoring, text
from sedimark.operators import duplicates, edits, graph, history, reports, selection, types, usage
from sedimark.plans.code_index import E, _edges
from sedimark.plans.text_plans import GROUPS, PAIRS, _blocks
from sedimark.sources.roles import FILES_SQL, SYMBOLS_SQL, files, symbols
from sedimark.storage import new_path, table
from sedimark.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- types

# Each part but the first derives from the part of a third of its key, and every fifth one implements interface -size.
INHERITS = """inherits AS (SELECT p_partkey AS child, p_partkey // 3 AS parent, 'base' AS kind FROM part WHERE p_partkey > 0
UNION ALL SELECT p_partkey, -CAST(p_size AS BIGINT), 'interface' FROM part WHERE p_partkey % 5 = 0)"""
MEMBERS = "members AS (SELECT p_partkey AS type, split_part(p_name, ' ', 2) AS name, p_brand AS parameters, p_type AS returns FROM part)"


def _inherits(spark, sf):
    p = table(spark, sf, "part")
    base = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"), F.lit("base").alias("kind"))
    made = p.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("child"), (-F.col("p_size").cast("long")).alias("parent"), F.lit("interface").alias("kind"))
    return base.unionByName(made)


def _members(spark, sf):
    name = F.split_part("p_name", F.lit(" "), F.lit(2))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("type"), name.alias("name"), F.col("p_brand").alias("parameters"), F.col("p_type").alias("returns"))


def _node(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


@query(f"""WITH RECURSIVE {INHERITS}, c AS (SELECT CAST(150 AS BIGINT) AS node, 0 AS depth UNION SELECT i.parent, c.depth + 1 FROM c JOIN inherits i ON i.child = c.node)
SELECT node, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY node""")
def inheritance_chain(spark, sf):
    return types.ancestors(_inherits(spark, sf), _node(spark, 150))


@query(f"""WITH RECURSIVE {INHERITS}, c AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS depth UNION SELECT i.child, c.depth + 1 FROM c JOIN inherits i ON i.parent = c.node WHERE c.depth < 6)
SELECT node, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY node""")
def derived_types(spark, sf):
    return types.derived_types(_inherits(spark, sf), _node(spark, 2), 6)


@query(f"""WITH RECURSIVE {INHERITS}, c AS (SELECT child AS node FROM inherits WHERE kind = 'interface' AND parent = -7 UNION SELECT i.child FROM c JOIN inherits i ON i.parent = c.node AND i.kind = 'base')
SELECT node FROM c""")
def implementations(spark, sf):
    return types.implementations(_inherits(spark, sf), _node(spark, -7))


@query(f"""WITH {INHERITS}, {MEMBERS} SELECT b.type AS base, d.type AS derived, b.name FROM inherits i JOIN members b ON b.type = i.parent JOIN members d ON d.type = i.child
WHERE i.kind = 'base' AND b.name = d.name AND b.parameters = d.parameters""")
def method_overrides(spark, sf):
    return types.overrides(_inherits(spark, sf), _members(spark, sf))


@query(f"WITH {MEMBERS} SELECT returns AS type, name, count(DISTINCT parameters) AS n FROM members GROUP BY 1, 2 HAVING count(DISTINCT parameters) > 1")
def method_overloads(spark, sf):
    return types.overloads(_members(spark, sf).withColumn("type", F.col("returns")))


@query(f"WITH {MEMBERS} SELECT type, returns || ' ' || name || '(' || parameters || ', ' || returns || ')' AS signature, CASE WHEN name = 'widget' THEN parameters IN ('Brand#1', returns) ELSE false END AS matches FROM members")
def method_signatures(spark, sf):
    a = F.array("parameters", "returns")
    same = types.signatures_match(F.col("name"), a, F.lit("widget"), F.array(F.lit("Brand#1"), F.col("returns")), text.type_compatible)
    return _members(spark, sf).select("type", types.signature(F.col("name"), F.col("returns"), a).alias("signature"), same.alias("matches"))


@query(f"WITH {MEMBERS} SELECT returns AS type, count(*) + 2 * count(*) FILTER (name = 'widget') + count(*) FILTER (name <> 'widget') AS complexity FROM members GROUP BY 1")
def type_complexity(spark, sf):
    m = _members(spark, sf).groupBy(F.col("returns").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == "widget").alias("m"))
    return m.select("type", types.type_complexity(F.col("n"), F.col("m"), F.col("n") - F.col("m")).alias("complexity"))


# ---------------------------------------------------------------- paths


@query(f"""WITH {E} SELECT concat_ws('>', 1, a.dst) AS path, 1 AS steps FROM e a WHERE a.src = 1 AND a.dst <> 1
UNION ALL SELECT concat_ws('>', 1, a.dst, b.dst), 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 1 AND a.dst <> 1 AND b.dst NOT IN (1, a.dst)""")
def call_chain_paths(spark, sf):
    found = graph.simple_paths(_edges(spark, sf), _node(spark, 1), 2)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "steps")


@query(f"""WITH {E}, p AS (SELECT a.dst AS x, CAST(NULL AS BIGINT) AS y, 1 AS steps FROM e a WHERE a.src = 3 AND a.dst <> 3
UNION ALL SELECT a.dst, b.dst, 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 3 AND a.dst <> 3 AND b.dst NOT IN (3, a.dst))
SELECT max(steps) AS longest, count(*) FILTER (steps = 2) AS paths, round(avg(steps), 6) AS mean FROM p""")
def longest_call_paths(spark, sf):
    found = graph.simple_paths(_edges(spark, sf), _node(spark, 3), 2)
    return found.agg(F.max("steps").alias("longest"), F.count_if(F.col("steps") == 2).alias("paths"), F.round(F.avg("steps"), 6).alias("mean"))


@query(f"""WITH RECURSIVE {INHERITS}, c AS (SELECT child AS node, parent AS up, 1 AS depth FROM inherits WHERE kind = 'base' UNION ALL SELECT c.node, i.parent, c.depth + 1 FROM c JOIN inherits i ON i.child = c.up AND i.kind = 'base')
SELECT max(depth) AS deepest, round(avg(depth), 6) AS mean FROM (SELECT node, max(depth) AS depth FROM c GROUP BY node)""")
def call_depth(spark, sf):
    e = _inherits(spark, sf).filter("kind = 'base'").select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    d = graph.longest_depths(e).filter("depth > 0")
    return d.agg(F.max("depth").alias("deepest"), F.round(F.avg("depth"), 6).alias("mean"))


@query(f"""WITH {E} SELECT a.src AS node, a.dst AS first, unnest([a.src, a.dst]) AS start, unnest([a.dst, a.src]) AS "end" FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst""")
def cycle_steps(spark, sf):
    found = graph.cycles(_edges(spark, sf), 2).filter("length = 2")
    steps = found.select(F.col("path")[0].alias("node"), F.col("path")[1].alias("first"), F.explode(reports.cycle_steps(F.col("path"))).alias("s"))
    return steps.select("node", "first", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(f"""WITH {E}, d AS (SELECT node, sum(n) AS total FROM (SELECT src AS node, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT dst, count(*) FROM e GROUP BY 1) GROUP BY node ORDER BY total DESC, node LIMIT 5),
n AS (SELECT d.node, x.neighbour, row_number() OVER (PARTITION BY d.node ORDER BY x.neighbour) AS k FROM d JOIN (SELECT src AS node, dst AS neighbour FROM e UNION SELECT dst, src FROM e) x ON x.node = d.node)
SELECT node, neighbour FROM n WHERE k <= 3""")
def critical_neighbours(spark, sf):
    return graph.critical_neighbours(_edges(spark, sf))


# ---------------------------------------------------------------- sets


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#7' AND p_size > 40")
def internal_usings(spark, sf):
    p = table(spark, sf, "part")
    return p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name")).subtract(p.filter("p_brand = 'Brand#7' and p_size > 40").select(F.col("p_name").alias("name")))


@query("SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def recreated_tables(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderkey % 2 = 0").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT n_name AS path FROM nation UNION SELECT upper(n_name) FROM nation UNION SELECT r_name FROM region")
def project_list(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    listed = n.select(F.col("n_name").alias("path")).unionByName(n.select(F.upper("n_name").alias("path"))).unionByName(r.select(F.col("r_name").alias("path")))
    return listed.distinct().orderBy("path")


@query(f"WITH {PAIRS}, {GROUPS.split(', ', 1)[1].split('), groups AS', 1)[1].join(['groups AS', ''])} SELECT first_id, copies, 'exact' AS kind FROM groups UNION ALL SELECT a, 2, 'near' FROM pairs")
def duplicate_groups(spark, sf):
    b = _blocks(spark, sf)
    exact = duplicates.exact_groups(b).select("first_id", "copies", F.lit("exact").alias("kind"))
    return exact.unionByName(duplicates.near_pairs(b, 0.5).select(F.col("a").alias("first_id"), F.lit(2).cast("long").alias("copies"), F.lit("near").alias("kind")))


# ---------------------------------------------------------------- similarity and priority


PAIRED = "p AS (SELECT a.item_id AS pair_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE a.item_id % 2 = 0)"
TOKENS = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\"[^\"]*\"', chr(1), 'g'), '[A-Za-z_\\x{{80}}-\\x{{10FFFF}}][A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]*', 'i', 'g'), '[0-9]+', '0', 'g'), '[ \\t\\n\\v\\f\\r]+', '', 'g'), chr(1), 'q')"


@query(f"""WITH {PAIRED}, t AS (SELECT pair_id, {TOKENS.format('x')} AS u, {TOKENS.format('y')} AS v FROM p)
SELECT pair_id, CASE WHEN greatest(length(u), length(v)) = 0 THEN 1.0 ELSE round(1 - levenshtein(u, v) / greatest(length(u), length(v)), 6) END AS similarity FROM t""")
def token_type_similarity(spark, sf):
    b = table(spark, sf, "benchmark")
    x, y = b.filter("item_id % 2 = 0").select(F.col("item_id").alias("pair_id"), F.col("text").alias("x")), b.select((F.col("item_id") - 1).alias("pair_id"), F.col("text").alias("y"))
    return x.join(y, "pair_id").select("pair_id", F.round(text.token_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(CASE WHEN a.p_type <> b.p_type THEN 0.0 WHEN a.p_brand = b.p_brand THEN 0.9 WHEN a.p_size = b.p_size THEN 0.7 ELSE 0.5 END AS DOUBLE) AS similarity
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def semantic_similarity(spark, sf):
    p = table(spark, sf, "part")
    q = p.select(*(F.col(c).alias(f"{c}_b") for c in ("p_partkey", "p_type", "p_brand", "p_size")))
    met = p.join(q, F.col("p_partkey_b") == F.col("p_partkey") + 1)
    both = [(F.col(c), F.col(f"{c}_b")) for c in ("p_type", "p_brand", "p_size")]
    return met.select(F.col("p_partkey").alias("a"), F.col("p_partkey_b").alias("b"), text.semantic_similarity(*both).alias("similarity"))


@query(f"""WITH {GROUPS}, s AS (SELECT *, least(copies * 10, 50) + least(n_lines * 2, 30) + least(complexity * 5, 20) AS p, CASE WHEN copies > 5 THEN 20 ELSE 0 END + CASE WHEN first_id % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN complexity > 10 THEN 15 ELSE 0 END + CASE WHEN files > 3 THEN 10 ELSE 0 END AS r FROM groups)
SELECT first_id, CASE WHEN p >= 80 THEN 'Critical' WHEN p >= 60 THEN 'High' WHEN p >= 40 THEN 'Medium' ELSE 'Low' END AS priority, CASE WHEN r >= 40 THEN 'VeryHigh' WHEN r >= 30 THEN 'High' WHEN r >= 20 THEN 'Medium' ELSE 'Low' END AS risk FROM s""")
def refactoring_priority(spark, sf):
    g = duplicates.exact_groups(_blocks(spark, sf))
    copies, lines, complexity, n = (F.col(c) for c in ("copies", "n_lines", "complexity", "files"))
    risk = scoring.refactoring_risk(copies, F.col("first_id") % 2 == 0, complexity, n)
    return g.select("first_id", scoring.refactoring_priority(copies, lines, complexity).alias("priority"), risk.alias("risk"))


# ---------------------------------------------------------------- selection


@query(f"""WITH {SYMBOLS_SQL}, k AS (SELECT *, bool_or(kind = 'Brand#1') OVER (PARTITION BY name) AS f FROM symbols), n AS (SELECT * FROM k WHERE kind = 'Brand#1' OR NOT f),
m AS (SELECT *, bool_or(file_id > 40) OVER (PARTITION BY name) AS g FROM n), c AS (SELECT *, CASE WHEN name = 'cold widget' THEN 100 ELSE 0 END + CASE WHEN namespace = 'PROMO' THEN 75 ELSE 0 END + CASE WHEN file_id > 45 THEN 50 ELSE 0 END AS score FROM m WHERE file_id > 40 OR NOT g)
SELECT name, id, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS place FROM c) WHERE place = 1""")
def select_candidates(spark, sf):
    left = selection.cascade(symbols(spark, sf), "name", [F.col("kind") == "Brand#1", F.col("file_id") > 40])
    points = selection.score([(F.col("name") == "cold widget", 100), (F.col("namespace") == "PROMO", 75), (F.col("file_id") > 45, 50)])
    return selection.best(left.select("name", "id", points.alias("score")), "name", "score", "id")


@query(f"WITH {SYMBOLS_SQL} SELECT id, name, 'text' AS strategy, 'low' AS confidence FROM symbols WHERE contains(name, 'dget')")
def search_fallback(spark, sf):
    s = symbols(spark, sf).select("id", "name")
    strategies = [("exact", lambda: s.filter("name = 'dget'")), ("prefix", lambda: s.filter("startswith(name, 'dget')")), ("text", lambda: s.filter("contains(name, 'dget')"))]
    return selection.fallback(strategies)


@query("SELECT count(*) FILTER (contains(url, 'Generated') OR contains(url, '.g.cs') OR contains(url, '.designer.cs')) AS generated, count(*) FILTER (contains(url, 'Test') OR contains(url, 'Spec')) AS tests, count(*) FILTER (contains(url, '/es/')) AS spanish, count(*) AS n FROM pages")
def code_predicates(spark, sf):
    has = {"generated": selection.GENERATED, "tests": selection.TESTS, "spanish": ("/es/",)}
    return table(spark, sf, "pages").agg(*(F.count_if(selection.path_has(F.col("url"), parts)).alias(c) for c, parts in has.items()), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- versions


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 9 <> 0")
def transaction_commit(spark, sf):
    folder = new_path(spark, "versions")
    history.create(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), folder)
    history.transaction(spark, folder, lambda t: t.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))))
    history.transaction(spark, folder, lambda t: t.filter("c_custkey % 9 <> 0"))
    return history.current(spark, folder)


@query(f"WITH {FILES_SQL} SELECT path, sha256(text) AS hash, id % 13 = 0 OR id % 17 = 0 AS restored FROM files")
def backup_restore(spark, sf):
    f = files(spark, sf)
    saved = history.backup(f, F.lit("2024-01-01").cast("timestamp"))
    now = f.filter("id % 17 <> 0").withColumn("text", F.when(F.col("id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return history.restore(now, saved).select("path", F.sha2("text", 256).alias("hash"), "restored")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def unexpired_backups(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("made_at"))
    last = e.agg(F.max("made_at").alias("now"))
    return history.unexpired(e.join(F.broadcast(last)), F.col("now"), 7).select("event_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_operations(spark, sf):
    return history.newest(table(spark, sf, "events"), "ts", "event_id").select("event_id", "event_type")


# ---------------------------------------------------------------- reports


@query("SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def report_export(spark, sf):
    path = new_path(spark, "report")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("long").alias("o_custkey"))
    reports.export(rows, path, "csv")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT lower(regexp_extract(url, '(\\.[^./?#]*)(?:[?#].*)?$', 1)) AS extension, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, extension LIMIT 15")
def extension_histogram(spark, sf):
    return reports.extension_histogram(table(spark, sf, "pages"), "url")


@query("SELECT props AS context, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, context LIMIT 5")
def top_contexts(spark, sf):
    return reports.top_contexts(table(spark, sf, "events"), "props")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders), k AS (SELECT *, 2 + 1 + CAST(ceil(length(a) * 0.25) AS INT) + 3 AS u, CAST(ceil(length(b) * 0.25) AS INT) + 4 AS v FROM o)
SELECT o_orderkey, CASE WHEN u + v <= 13 THEN 'a=' || a || ',b=' || b ELSE '__truncated__=Original had 2 properties,a=' || a END AS fields FROM k""")
def object_truncation(spark, sf):
    fields = F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("a"), F.col("o_orderstatus"))
    kept = F.array_sort(F.transform(F.map_entries(reports.truncate_object(fields, 13)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(kept, ",").alias("fields"))


@query("""WITH c AS (SELECT c_custkey, 2 + CAST(ceil(length(c_name) * 0.25) AS INT) + 1 AS u, CAST(ceil(length(c_mktsegment) * 0.25) AS INT) + 1 AS v, c_name, c_mktsegment FROM customer)
SELECT c_custkey, CASE WHEN u + v > 10 THEN c_name || ';... [2 items truncated]' WHEN u + 2 * v > 10 THEN c_name || ';' || c_mktsegment || ';... [1 items truncated]' ELSE c_name || ';' || c_mktsegment || ';' || c_mktsegment END AS items FROM c""")
def array_truncation(spark, sf):
    items = reports.truncate_array(F.array("c_name", "c_mktsegment", "c_mktsegment"), 10)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(items, ";").alias("items"))


EDITS = "e AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS path, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS s FROM orders)"


@query(f"""WITH {EDITS}, x AS (SELECT DISTINCT b.id FROM e a JOIN e b ON a.path = b.path AND a.id < b.id AND a.s <= b.s + 40 AND b.s <= a.s + 40)
SELECT path, count(*) AS proposed, count(*) FILTER (id NOT IN (SELECT id FROM x)) AS kept, count(*) FILTER (id IN (SELECT id FROM x)) AS dropped FROM e GROUP BY path""")
def resolve_conflicts(spark, sf):
    start = F.unix_date(F.to_date("o_orderdate")).cast("long")
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("path"), start.alias("start"), (start + 40).alias("end"), F.col("o_orderkey").alias("made_at"))
    return edits.fix_statistics(e, edits.resolve_conflicts(e))


# ---------------------------------------------------------------- event time


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    return windows.window_counts(table(spark, sf, "events"), "ts", "1 day", by="event_type").withColumn("total", F.round("total", 4))


@query("SELECT b - INTERVAL (12 * k) HOUR AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, value FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def sliding_windows(spark, sf):
    return windows.window_counts(table(spark, sf, "events"), "ts", "1 day", "12 hours").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "6 hours", "user_id")
