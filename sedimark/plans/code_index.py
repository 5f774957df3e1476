"""Queries over the relational index, the reference graph and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.operators import graph, index, usage
from sedimark.sources.roles import FILES_SQL, REFERENCES_SQL, SYMBOLS_SQL, files, references, symbols
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


S, R, FI = SYMBOLS_SQL, REFERENCES_SQL, FILES_SQL


def _edges(spark, sf):
    return references(spark, sf).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def _nodes(spark, sf):
    return symbols(spark, sf).select(F.col("id").alias("node"))


@query(f"WITH {S}, {R} SELECT r.from_id, r.kind AS reference_kind, r.file_id, r.line, s.name, s.kind AS symbol_kind FROM refs r JOIN symbols s ON s.id = r.from_id WHERE r.to_id = 7")
def find_callers(spark, sf):
    return index.find_callers(references(spark, sf), symbols(spark, sf), 7)


@query(f"WITH {S}, {R} SELECT r.to_id, r.kind AS reference_kind, r.file_id, r.line, s.name, s.kind AS symbol_kind FROM refs r JOIN symbols s ON s.id = r.to_id WHERE r.from_id = 7")
def find_callees(spark, sf):
    return index.find_callees(references(spark, sf), symbols(spark, sf), 7)


@query(f"WITH {S} SELECT * FROM symbols WHERE name ILIKE '%WIDGET%' AND kind = 'Brand#5' ORDER BY name, id LIMIT 100")
def symbols_by_name(spark, sf):
    return index.symbols_by_name(symbols(spark, sf), "WIDGET", "Brand#5")


@query(f"WITH {S} SELECT * FROM symbols WHERE name = 'cold widget'")
def symbols_exact(spark, sf):
    return index.symbols_exact(symbols(spark, sf), "cold widget")


@query(f"WITH {S} SELECT * FROM symbols WHERE file_id = 10")
def symbols_in_file(spark, sf):
    return symbols(spark, sf).filter("file_id = 10").orderBy("name", "id")


@query(f"WITH {S} SELECT * FROM symbols WHERE id = 42")
def symbol_by_id(spark, sf):
    return symbols(spark, sf).filter("id = 42")


@query(f"WITH {S} SELECT * FROM symbols WHERE name ILIKE '%s%' AND kind IN ('Brand#1', 'Brand#2') AND namespace IN ('ECONOMY', 'STANDARD') ORDER BY name, id LIMIT 50")
def search_symbols(spark, sf):
    return index.search_symbols(symbols(spark, sf), "s", ["Brand#1", "Brand#2"], ["ECONOMY", "STANDARD"], 50)


@query(f"WITH {R} SELECT * FROM refs WHERE to_id = 11")
def references_to_symbol(spark, sf):
    return index.references_to(references(spark, sf), 11)


@query(f"WITH {S} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def symbols_by_kind(spark, sf):
    return index.count_by(symbols(spark, sf), "kind")


@query(f"WITH {R} SELECT kind, count(*) AS n FROM refs GROUP BY kind")
def references_by_kind(spark, sf):
    return index.count_by(references(spark, sf), "kind")


@query(f"WITH {S}, {R} SELECT 'symbols' AS table_name, count(*) AS n FROM symbols UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'files', count(*) FROM documents")
def table_counts(spark, sf):
    return index.table_counts({"symbols": symbols(spark, sf), "references": references(spark, sf), "files": table(spark, sf, "documents")})


@query("SELECT coalesce(max(r_regionkey), 0) AS version FROM region")
def schema_version(spark, sf):
    return index.schema_version(table(spark, sf, "region").select(F.col("r_regionkey").alias("version")))


@query(f"WITH {FI} SELECT id, path, size_bytes FROM files WHERE language = 'de'")
def files_of_project(spark, sf):
    return files(spark, sf).filter("language = 'de'").select("id", "path", "size_bytes").orderBy("path")


def _current(spark, sf):
    """The files as they are now: some changed, some gone."""
    now = files(spark, sf).filter("id % 11 <> 0")
    return now.withColumn("content_hash", F.when(F.col("id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")))


CURRENT = "cur AS (SELECT id, path, CASE WHEN id % 7 = 0 THEN sha256(text || 'x') ELSE content_hash END AS h FROM files WHERE id % 11 <> 0)"


@query(f"WITH {FI}, {CURRENT} SELECT f.id, f.path FROM files f LEFT JOIN cur c ON c.path = f.path WHERE c.h IS NULL OR c.h <> f.content_hash")
def stale_files(spark, sf):
    return index.stale_files(files(spark, sf).drop("text"), _current(spark, sf)).select("id", "path")


@query(f"WITH {FI}, {CURRENT} SELECT id, path FROM files WHERE path NOT IN (SELECT path FROM cur)")
def deleted_files(spark, sf):
    return index.deleted_files(files(spark, sf), _current(spark, sf)).select("id", "path")


@query(f"""WITH {FI}, new AS (SELECT concat_ws('/', 'new', path) AS path, size_bytes FROM files WHERE id % 9 = 0 UNION ALL SELECT path, size_bytes + 1 FROM files WHERE id % 10 = 0),
top AS (SELECT max(id) AS t FROM files)
SELECT f.id, f.path, coalesce(n.size_bytes, f.size_bytes) AS size_bytes FROM files f LEFT JOIN new n ON n.path = f.path
UNION ALL SELECT t + row_number() OVER (ORDER BY path), path, size_bytes FROM new, top WHERE path NOT IN (SELECT path FROM files)""")
def upsert_files(spark, sf):
    stored = files(spark, sf).select("id", "path", "size_bytes")
    made = stored.filter("id % 9 = 0").select(F.concat_ws("/", F.lit("new"), "path").alias("path"), "size_bytes")
    changed = stored.filter("id % 10 = 0").select("path", (F.col("size_bytes") + 1).alias("size_bytes"))
    return index.upsert(stored, made.unionByName(changed), ["path"], "id")


@query(f"WITH {S} SELECT * FROM symbols UNION ALL SELECT * FROM symbols WHERE id % 5 = 0")
def append_symbols(spark, sf):
    s = symbols(spark, sf)
    return index.append(s, s.filter("id % 5 = 0"))


@query("""SELECT root_path, substr(sha256(lower(root_path)), 1, 16) AS root_path_hash, CASE WHEN root_path = 'NATION_3' THEN '2025-01-01' ELSE '2024-01-01' END AS opened_at
FROM (SELECT n_name AS root_path FROM nation)""")
def get_or_create_project(spark, sf):
    name = F.col("n_name")
    projects = table(spark, sf, "nation").select(name.alias("root_path"), index.path_key(name).alias("root_path_hash"), F.lit("2024-01-01").alias("opened_at"))
    return index.touch_or_create(projects, "NATION_3", "2025-01-01")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def key_value_upsert(spark, sf):
    return index.last_values(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def partial_update(spark, sf):
    stored = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = stored.filter("c_custkey % 3 = 0").select(
        "c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 6 == 0, "MOVED").alias("c_mktsegment")
    )
    return index.partial_update(stored, new, "c_custkey")


@query(f"""WITH {S}, {R}, dead AS (SELECT id FROM symbols WHERE file_id IN (3, 8))
SELECT from_id, to_id, kind, file_id, line FROM refs WHERE from_id NOT IN (SELECT id FROM dead) AND to_id NOT IN (SELECT id FROM dead)""")
def delete_cascade(spark, sf):
    f = symbols(spark, sf).select(F.col("file_id").alias("id")).distinct()
    return index.delete_files(f, symbols(spark, sf), references(spark, sf), f.filter("id in (3, 8)"))[2]


@query(f"WITH {S} SELECT * FROM symbols WHERE file_id <> 5 UNION ALL SELECT id + 1000000, file_id, upper(name), kind, namespace FROM symbols WHERE file_id = 5")
def incremental_reindex(spark, sf):
    s = symbols(spark, sf)
    new = s.filter("file_id = 5").withColumns({"id": F.col("id") + 1000000, "name": F.upper("name")})
    return index.reindex(s, new)


@query(f"WITH {S} SELECT concat_ws('::', namespace, name, kind) AS lookup_key, arg_min(id, (name, id)) AS id FROM symbols GROUP BY 1")
def symbol_key_lookup(spark, sf):
    return index.key_lookup(symbols(spark, sf), ["namespace", "name", "kind"])


@query(f"""WITH {S}, {R}, k AS (SELECT id, concat_ws('::', namespace, name, kind) AS k FROM symbols), l AS (SELECT k, min(id) AS id FROM k GROUP BY k)
SELECT x.id AS from_id, y.id AS to_id, count(*) AS n FROM refs r JOIN k a ON a.id = r.from_id JOIN k b ON b.id = r.to_id JOIN l x ON x.k = a.k JOIN l y ON y.k = b.k GROUP BY 1, 2""")
def resolve_references(spark, sf):
    s = symbols(spark, sf)
    key = F.concat_ws("::", "namespace", "name", "kind")
    ends = [s.select(F.col("id").alias(f"{e}_id"), key.alias(f"{e}_key")) for e in ("from", "to")]
    edges = references(spark, sf).select("from_id", "to_id").join(ends[0], "from_id").join(ends[1], "to_id").select("from_key", "to_key")
    found = index.resolve_edges(edges, index.key_lookup(s, ["namespace", "name", "kind"]))
    return found.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- graph

E = f"{R}, e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM refs)"


@query(f"""WITH RECURSIVE {E}, c AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 2)
SELECT node, min(depth) AS depth FROM c GROUP BY node""")
def call_chain_forward(spark, sf):
    start = spark.createDataFrame([(1,)], "node long")
    return graph.reachable(_edges(spark, sf), start, "forward", 2)


@query(f"""WITH RECURSIVE {E}, c AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, c.depth + 1 FROM c JOIN e ON e.dst = c.node WHERE c.depth < 2)
SELECT node, min(depth) AS depth FROM c GROUP BY node""")
def call_chain_backward(spark, sf):
    return graph.reachable(_edges(spark, sf), spark.createDataFrame([(5,)], "node long"), "backward", 2)


@query(f"""WITH RECURSIVE {E}, c AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 2)
SELECT DISTINCT node FROM c WHERE node <> 1""")
def call_chain_recursive_sql(spark, sf):
    _edges(spark, sf).distinct().createOrReplaceTempView("chain_edges")
    return spark.sql(graph.call_chain_sql("chain_edges", 1, 2))


@query(f"""WITH RECURSIVE {E}, c AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 3)
SELECT depth, count(*) AS nodes FROM (SELECT node, min(depth) AS depth FROM c GROUP BY node) GROUP BY depth""")
def depth_histogram(spark, sf):
    found = graph.reachable(_edges(spark, sf), spark.createDataFrame([(1,)], "node long"), "forward", 3)
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {E} SELECT concat_ws('>', 1, a.dst) AS path, 1 AS steps FROM e a WHERE a.src = 1 AND a.dst = 34
UNION ALL SELECT concat_ws('>', 1, a.dst, b.dst), 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 1 AND b.dst = 34 AND a.dst NOT IN (1, 34)""")
def paths_between(spark, sf):
    a, b = (spark.createDataFrame([(k,)], "node long") for k in (1, 34))
    found = graph.simple_paths(_edges(spark, sf), a, 2, b)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "steps")


@query(f"""WITH {E}, p AS (SELECT concat_ws('>', 2, a.dst) AS path, 1 AS steps FROM e a WHERE a.src = 2 AND a.dst = 40
UNION ALL SELECT concat_ws('>', 2, a.dst, b.dst), 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 2 AND b.dst = 40 AND a.dst NOT IN (2, 40)
UNION ALL SELECT concat_ws('>', 2, a.dst, b.dst, c.dst), 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst
WHERE a.src = 2 AND c.dst = 40 AND a.dst NOT IN (2, 40) AND b.dst NOT IN (2, 40) AND a.dst <> b.dst)
SELECT path, steps FROM p WHERE steps = (SELECT min(steps) FROM p)""")
def shortest_call_paths(spark, sf):
    a, b = (spark.createDataFrame([(k,)], "node long") for k in (2, 40))
    found = graph.shortest_paths(_edges(spark, sf), a, b, 3)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "steps")


@query(f"""WITH {E} SELECT concat_ws('>', src) AS path, 1 AS length FROM e WHERE src = dst
UNION ALL SELECT concat_ws('>', a.src, a.dst), 2 FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT concat_ws('>', a.src, a.dst, b.dst), 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src
WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def circular_dependencies(spark, sf):
    found = graph.cycles(_edges(spark, sf), 3)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query(f"WITH {E} SELECT src AS node FROM e WHERE src = dst")
def recursive_calls(spark, sf):
    return graph.cycles(_edges(spark, sf), 1).select(F.col("path")[0].alias("node"))


# The component of the busiest node is what it reaches and what reaches it; the closure is needed for the other nodes only.
@query(f"""WITH RECURSIVE {E}, top AS (SELECT src AS node FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
f AS (SELECT node FROM top UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b AS (SELECT node FROM top UNION SELECT e.src FROM b JOIN e ON e.dst = b.node),
main AS (SELECT node FROM f INTERSECT SELECT node FROM b), o AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM main) AND dst NOT IN (SELECT node FROM main)),
r AS (SELECT src AS a, dst AS b FROM o UNION SELECT r.a, o.dst FROM r JOIN o ON o.src = r.b)
SELECT node, (SELECT min(node) FROM main) AS component FROM main WHERE (SELECT count(*) FROM main) > 1
UNION ALL SELECT x.a, min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING max(x.b) <> min(x.b)""")
def strongly_connected(spark, sf):
    return graph.strong_components(_edges(spark, sf))


@query(f"""WITH RECURSIVE {E}, u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
f AS (SELECT min(a) AS node FROM u UNION SELECT u.b FROM f JOIN u ON u.a = f.node), o AS (SELECT a, b FROM u WHERE a NOT IN (SELECT node FROM f)),
r AS (SELECT a, a AS b FROM o UNION SELECT r.a, o.b FROM r JOIN o ON o.a = r.b)
SELECT node, (SELECT min(node) FROM f) AS component FROM f UNION ALL SELECT a, min(b) FROM r GROUP BY a""")
def dependency_components(spark, sf):
    from sedimark.operators.components import connected_components

    return connected_components(_edges(spark, sf))


@query(f"""WITH {S}, {E}, d AS (SELECT s.id AS node, (SELECT count(*) FROM e WHERE dst = s.id) AS i, (SELECT count(*) FROM e WHERE src = s.id) AS o FROM symbols s)
SELECT node, i AS in_degree, o AS out_degree, round((i + o) / (2.0 * ((SELECT count(*) FROM symbols) - 1)), 8) AS centrality FROM d""")
def degree_centrality(spark, sf):
    return graph.degrees(_edges(spark, sf), _nodes(spark, sf)).withColumn("centrality", F.round("centrality", 8))


@query(f"""WITH {S}, {E}, d AS (SELECT s.id, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM symbols s LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = s.id
LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = s.id)
SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, round(sum(o) / (count(*) * (count(*) - 1.0)), 8) AS density, max(o) AS max_out, round(avg(o), 6) AS mean_out,
count(*) FILTER (i = 0 AND o > 0) AS entry_points, count(*) FILTER (o = 0 AND i > 0) AS leaves, count(*) FILTER (o = 0 AND i = 0) AS isolated FROM d""")
def call_graph_metrics(spark, sf):
    m = graph.graph_metrics(_edges(spark, sf), _nodes(spark, sf))
    return m.withColumns({"density": F.round("density", 8), "mean_out": F.round("mean_out", 6)})


@query(f"WITH {S}, {E} SELECT id AS node FROM symbols WHERE id NOT IN (SELECT dst FROM e)")
def entry_points(spark, sf):
    return graph.entry_points(_edges(spark, sf), _nodes(spark, sf))


@query(f"WITH {S}, {E} SELECT id AS node FROM symbols WHERE id NOT IN (SELECT src FROM e)")
def leaf_methods(spark, sf):
    return graph.leaves(_edges(spark, sf), _nodes(spark, sf))


@query(f"""WITH RECURSIVE {S}, {E}, r AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT id AS node FROM symbols WHERE id NOT IN (SELECT node FROM r)""")
def unreachable_methods(spark, sf):
    start = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    found = graph.reachable(_edges(spark, sf), start, "forward", 100_000)
    return _nodes(spark, sf).join(found.select("node"), "node", "left_anti")


@query(f"WITH {S}, {E} SELECT dst AS node, count(*) AS uses FROM e JOIN symbols s ON s.id = e.src GROUP BY dst HAVING bool_and(s.namespace IN ('PROMO', 'ECONOMY', 'STANDARD'))")
def test_only_methods(spark, sf):
    tests = symbols(spark, sf).filter("namespace in ('PROMO', 'ECONOMY', 'STANDARD')").select(F.col("id").alias("node"))
    return graph.only_used_by(_edges(spark, sf).distinct(), tests)


@query(f"""WITH {E} SELECT a.src, a.dst AS via, b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = a.src AND x.dst = b.dst)""")
def indirect_callers(spark, sf):
    return graph.two_hop(_edges(spark, sf)).select("src", "via", "dst")


@query()  # SQL would walk the graph once from every node; tests compare it with a search in Python
def average_path_length(spark, sf):
    found = graph.mean_path_length(_edges(spark, sf))
    return found.withColumn("mean_length", F.round("mean_length", 6))


@query(f"""WITH {E}, d AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
SELECT node, in_degree, out_degree FROM d ORDER BY in_degree + out_degree DESC, node LIMIT 5""")
def critical_nodes(spark, sf):
    e = _edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    d = graph.degrees(e, nodes).select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total"))
    return usage.top(d, "total", "node", 5).drop("total")


LAYERS = [("UI", 0, "econ*"), ("Service", 1, "st?ndard"), ("Data", 2, "promo*")]
LEVELS = {name: level for name, level, _ in LAYERS}
LAYER = "CASE WHEN namespace ILIKE 'econ%' THEN 'UI' WHEN namespace ILIKE 'st_ndard' THEN 'Service' WHEN namespace ILIKE 'promo%' THEN 'Data' ELSE 'Unknown' END"
LEVEL = "CASE {} WHEN 'UI' THEN 0 WHEN 'Service' THEN 1 WHEN 'Data' THEN 2 END"
LAYERED = f"""{S}, {R}, p AS (SELECT id, {LAYER} AS layer FROM symbols),
l AS (SELECT r.from_id AS src, r.to_id AS dst, a.layer AS src_layer, b.layer AS dst_layer, {LEVEL.format('a.layer')} AS x, {LEVEL.format('b.layer')} AS y
FROM refs r JOIN p a ON a.id = r.from_id JOIN p b ON b.id = r.to_id)"""


def _placed(spark, sf):
    return symbols(spark, sf).select(F.col("id").alias("node"), graph.assign_layer(F.col("namespace"), LAYERS).alias("layer"))


@query(f"WITH {LAYERED} SELECT layer, count(*) AS n FROM p GROUP BY layer")
def layer_assignment(spark, sf):
    return index.count_by(_placed(spark, sf), "layer")


@query(f"WITH {LAYERED} SELECT src, dst, src_layer, dst_layer, CASE WHEN x - y > 1 THEN 'Major' ELSE 'Minor' END AS severity FROM l WHERE x > y")
def layer_violations(spark, sf):
    return graph.layer_violations(graph.layer_edges(_edges(spark, sf), _placed(spark, sf)), LEVELS)


@query(f"WITH {LAYERED} SELECT src_layer, count(*) AS edges, count(*) FILTER (x > y) AS violations, round(100.0 * (1 - count(*) FILTER (x > y) / count(*)), 2) AS compliance FROM l GROUP BY src_layer")
def layer_compliance(spark, sf):
    return graph.compliance(graph.layer_edges(_edges(spark, sf), _placed(spark, sf)), LEVELS)


@query(f"WITH {LAYERED} SELECT src_layer, dst_layer, count(*) AS n FROM l GROUP BY 1, 2")
def layer_dependency_graph(spark, sf):
    return graph.layer_edges(_edges(spark, sf), _placed(spark, sf)).groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- usage


@query(f"WITH {R} SELECT to_id, count(*) FILTER (kind = 'A') AS kind_a, count(*) FILTER (kind = 'N') AS kind_n, count(*) FILTER (kind = 'R') AS kind_r, count(*) AS uses FROM refs GROUP BY to_id")
def type_usages(spark, sf):
    return usage.usage_by_kind(references(spark, sf), ["A", "N", "R"])


@query(f"WITH {R} SELECT to_id, count(*) AS uses FROM refs GROUP BY to_id ORDER BY uses DESC, to_id LIMIT 10")
def most_used_types(spark, sf):
    return usage.top(references(spark, sf).groupBy("to_id").agg(F.count(F.lit(1)).alias("uses")), "uses", "to_id")


@query(f"WITH {R} SELECT to_id, count(*) AS uses FROM refs GROUP BY to_id ORDER BY uses, to_id LIMIT 10")
def least_used_types(spark, sf):
    return usage.top(references(spark, sf).groupBy("to_id").agg(F.count(F.lit(1)).alias("uses")), "uses", "to_id", descending=False)


@query(f"WITH {S}, {R} SELECT s.kind AS container, count(*) AS n FROM refs r JOIN symbols s ON s.id = r.from_id WHERE r.kind IN ('A', 'R') GROUP BY s.kind")
def dependency_frequency(spark, sf):
    containers = symbols(spark, sf).select(F.col("id").alias("from_id"), F.col("kind").alias("container"))
    return index.count_by(references(spark, sf).filter("kind in ('A', 'R')").join(containers, "from_id"), "container")


@query(f"""WITH {S}, {R} SELECT s.kind AS caller_kind, count(*) AS calls, count(DISTINCT r.file_id) AS files, min(r.line) AS first_line,
array_to_string(list_sort(list(DISTINCT r.kind)), ',') AS kinds FROM refs r JOIN symbols s ON s.id = r.from_id WHERE r.to_id = 3 GROUP BY s.kind""")
def call_patterns(spark, sf):
    return usage.call_patterns(references(spark, sf), symbols(spark, sf), 3).withColumn("kinds", F.array_join("kinds", ","))


@query(f"WITH {S}, {E} SELECT id, name, kind FROM symbols WHERE id NOT IN (SELECT dst FROM e)")
def unused_methods(spark, sf):
    used = _edges(spark, sf).select(F.col("dst").alias("to_id"))
    return usage.unused(symbols(spark, sf), used).select("id", "name", "kind")


@query(f"""WITH {S}, {E}, u AS (SELECT s.id, count(e.dst) AS n FROM symbols s LEFT JOIN e ON e.dst = s.id GROUP BY s.id)
SELECT count(*) FILTER (n = 0) AS unused, count(*) FILTER (n = 1) AS used_once, count(*) AS symbols FROM u""")
def refactoring_opportunities(spark, sf):
    return usage.opportunities(symbols(spark, sf), _edges(spark, sf).distinct().select(F.col("dst").alias("to_id")))


@query(f"""WITH {S}, t AS (SELECT kind, id, name, row_number() OVER (PARTITION BY kind ORDER BY file_id DESC, id) AS place, count(*) OVER (PARTITION BY kind) - 3 AS more FROM symbols)
SELECT kind, id, name, place, greatest(more, 0) AS more FROM t WHERE place <= 3""")
def top_symbols_per_kind(spark, sf):
    return usage.top_per_group(symbols(spark, sf), "kind", "file_id", "id", 3).select("kind", "id", "name", "place", "more")


@query("SELECT o_orderpriority AS severity, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def issue_report(spark, sf):
    o = table(spark, sf, "orders")
    return usage.issue_report(o.select(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("category")))


@query("""WITH u AS (SELECT 0 AS source_no, c_custkey AS seq, c_name AS path FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 1, c_custkey + 5, upper(c_name) FROM customer WHERE c_custkey % 3 = 0)
SELECT source_no, seq, path FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY source_no, seq) AS k FROM u) WHERE k = 1""")
def impact_union(spark, sf):
    c = table(spark, sf, "customer")
    a = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("path"))
    b = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 5).alias("seq"), F.upper("c_name").alias("path"))
    return usage.union_first([a, b])


@query("SELECT count(DISTINCT lower(c_mktsegment)) AS files FROM customer")
def impact_file_count(spark, sf):
    return table(spark, sf, "customer").agg(F.countDistinct(F.lower("c_mktsegment")).alias("files"))
