"""Queries over source code, aligned diffs, runs of fixes, graphs with cycles, analyzers, sketches and the life of operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.operators import analyzers, code, diff, duplicates, edits, graph, index, usage
from sedimark.plans.code_index import E, _edges
from sedimark.plans.relation_plans import INHERITS, _inherits
from sedimark.plans.text_plans import GROUPS, _blocks
from sedimark.sources.roles import FILES_SQL, LINES_SQL, REFERENCES_SQL, SYMBOLS_SQL, code_files, files, references, symbols
from sedimark.storage import new_path, table
from sedimark.streaming import lifecycle, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FI, LI, R, S = FILES_SQL, LINES_SQL, REFERENCES_SQL, SYMBOLS_SQL

# ---------------------------------------------------------------- source code

# Every part gives one file; what it declares follows from the part, so the SQL needs no source text.
PART = "p AS (SELECT p_partkey || '.cs' AS path, p_partkey AS k, replace(p_brand, '#', '') AS brand, p_type AS type, p_size AS size, 'Part' || p_partkey AS name, p_size % 5 AS deep FROM part)"


@query(f"""WITH {PART}, d AS (
SELECT path, 'namespace' AS kind, type || '.' || brand AS name, 2 AS line, 24 + deep * 2 AS end_line, NULL AS parameters, NULL AS container, NULL AS container_kind, NULL AS namespace FROM p
UNION ALL SELECT path, 'class', name, 5, 23 + deep * 2, NULL, type || '.' || brand, 'namespace', type || '.' || brand FROM p
UNION ALL SELECT path, 'field', 'count' || size, 7, 7, NULL, name, 'class', type || '.' || brand FROM p
UNION ALL SELECT path, 'property', 'Title', 8, 8, NULL, name, 'class', type || '.' || brand FROM p
UNION ALL SELECT path, 'constructor', name, 9, 9, 1, name, 'class', type || '.' || brand FROM p
UNION ALL SELECT path, 'method', 'Run' || brand, 10, 22 + deep * 2, 2, name, 'class', type || '.' || brand FROM p)
SELECT path, kind, name, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line, CAST(parameters AS INT) AS parameters, container, container_kind, namespace FROM d""")
def code_declarations(spark, sf):
    return code.declarations(code_files(spark, sf)).drop("pos")


@query(f"""WITH {PART}, m AS (SELECT *, deep * (deep + 1) // 2 + 4 AS cognitive, greatest(deep, 2) AS nesting, deep + 5 AS cyclomatic FROM p)
SELECT path, name AS container, 'Run' || brand AS name, CAST(10 AS INT) AS line, CAST(2 AS INT) AS parameters, CAST(cyclomatic AS INT) AS cyclomatic, CAST(cognitive AS INT) AS cognitive, CAST(nesting AS INT) AS nesting,
CAST(round(0.4 * cyclomatic + 0.3 * cognitive + 0.2 * nesting + 0.2, 6) AS DOUBLE) AS overall FROM m
UNION ALL SELECT path, name, name, 9, 1, 1, 0, 0, CAST(0.5 AS DOUBLE) FROM p""")
def method_complexity(spark, sf):
    return code.method_complexity(code_files(spark, sf))


# A new part's file makes an object of the part of a tenth of its key and reads its brand's helper.
@query(f"""WITH {PART} SELECT 'Part' || (k // 10) AS name, path, CAST(20 + deep * 2 AS INT) AS line_no FROM p
UNION SELECT name, path, 9 FROM p UNION SELECT name, path, 5 FROM p""")
def symbol_text_references(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("Part"), "p_partkey").alias("name"))
    return code.text_references(code_files(spark, sf), names)


@query(f"""WITH {PART} SELECT CAST('NUNIT002' AS VARCHAR) AS rule, 'Warning' AS severity, count(*) AS n, count(*) AS files FROM p WHERE k % 3 = 0
UNION ALL SELECT 'NUNIT006', 'Info', count(*), count(*) FROM p WHERE k % 3 = 0
UNION ALL SELECT NULL, 'Info', count(*), count(*) FROM p WHERE k % 3 = 0 UNION ALL SELECT NULL, 'Warning', count(*), count(*) FROM p WHERE k % 3 = 0
UNION ALL SELECT NULL, NULL, 2 * count(*), count(*) FROM p WHERE k % 3 = 0""")
def analyzer_issues(spark, sf):
    analyzers.register(spark, "upgrade_rules", analyzers.rule_analyzer(analyzers.UPGRADE_RULES, (".cs",)))
    return analyzers.issue_totals(analyzers.analyze(code_files(spark, sf), "upgrade_rules")).select("rule", "severity", "n", "files")


# ---------------------------------------------------------------- diffs and fixes

# Each document gets a new first line, loses its last and has the first one that holds tion replaced. Which of equal lines beside each other goes is open, so no numbers are compared.
CHANGED = f"""{FI}, {LI}, f AS (SELECT path, max(line_no) AS n, min(line_no) FILTER (contains(line, 'tion')) AS hit FROM lines GROUP BY path)"""


def _versions(spark, sf):
    f = files(spark, sf).select("path", "text")
    cut = F.split("text", "\n", -1)
    first = F.array_position(F.transform(cut, lambda x: x.contains("tion")), True)
    swapped = F.transform(cut, lambda x, k: F.when(k + 1 == first, F.concat(F.lit("changed: "), F.col("path"))).otherwise(x))
    now = F.concat(F.array(F.concat(F.lit("new: "), F.col("path"))), F.slice(swapped, 1, F.size(cut) - 1))
    return f, f.withColumn("text", F.array_join(now, "\n"))


@query(f"""WITH {CHANGED}
SELECT path, '+' AS op, 'new: ' || path AS line FROM f
UNION ALL SELECT path, '-', line FROM lines JOIN f USING (path) WHERE hit = line_no AND hit < n
UNION ALL SELECT path, '+', 'changed: ' || path FROM f WHERE hit < n
UNION ALL SELECT path, '-', line FROM lines JOIN f USING (path) WHERE line_no = n""")
def aligned_diff(spark, sf):
    return diff.aligned_diff(*_versions(spark, sf)).select("path", "op", "line")


@query(f"""WITH {CHANGED} SELECT path, CAST(1 + CASE WHEN hit < n THEN 1 ELSE 0 END AS BIGINT) AS removed, CAST(1 + CASE WHEN hit < n THEN 1 ELSE 0 END AS BIGINT) AS added FROM f""")
def diff_hunks(spark, sf):
    return diff.hunks(*_versions(spark, sf)).groupBy("path").agg(F.sum("old_lines").alias("removed"), F.sum("new_lines").alias("added"))


# Two fixes of each document: the third to fifth sign go, and from the tenth one X is put in; a third overlaps the first and is newer.
FIXES = [(2, 5, "", 1), (10, 10, "X", 2), (4, 6, "lost", 3)]
FIXED = "substr(text, 1, 2) || substr(text, 6, 5) || 'X' || substr(text, 11)"


def _fixes(spark, sf):
    f = files(spark, sf).filter(F.length("text") >= 12).select("path", "text")
    made = [f.select(F.concat_ws("#", "path", F.lit(k)).alias("id"), "path", F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new"), F.lit(at).alias("made_at")) for k, (a, b, new, at) in enumerate(FIXES)]
    return f, made[0].unionByName(made[1]).unionByName(made[2])


@query(f"""WITH {FI} SELECT path, sha256(substr(text, 1, 2) || substr(text, 6, 5) || 'X' || substr(text, 11)) AS after, sha256(text) AS back, 2 AS applied FROM files WHERE length(text) >= 12""")
def fix_run(spark, sf):
    f, fixes = _fixes(spark, sf)
    after, done, back = edits.apply_fixes(f, fixes)
    restored = edits.apply_edits(after.select("path", F.col("new_text").alias("text")), back.drop("id"))
    n = done.filter("applied").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("applied"))
    hashed = after.select("path", F.sha2("new_text", 256).alias("after")).join(restored.select("path", F.sha2("new_text", 256).alias("back")), "path")
    return hashed.join(n, "path")


@query(f"""WITH {GROUPS}, h AS (SELECT path, group_key, split_part(path, '/', 1) AS directory, CAST(sum(complexity) AS BIGINT) AS score, count(*) AS blocks, CAST(sum(n_lines) AS BIGINT) AS lines
FROM (SELECT *, split_part(path, '/', 1) FROM blocks) WHERE hash IN (SELECT hash FROM groups) GROUP BY GROUPING SETS ((path), (group_key), (split_part(path, '/', 1)))),
l AS (SELECT CASE WHEN path IS NOT NULL THEN 'path' WHEN group_key IS NOT NULL THEN 'group_key' ELSE 'directory' END AS level, coalesce(path, group_key, directory) AS place, score, blocks, lines FROM h)
SELECT level, place, score, blocks, lines FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, place) AS k FROM l) WHERE k <= 10""")
def duplicate_hotspots_by_level(spark, sf):
    b = _blocks(spark, sf).withColumn("directory", F.substring_index("path", "/", 1))
    return duplicates.hotspots_by_level(b, duplicates.exact_groups(b), ["path", "group_key", "directory"])


# ---------------------------------------------------------------- graphs

# What parts derive from, and of every fiftieth part an edge back from the ancestor three above it: cycles of four that grow together.
CYCLIC = f"""{INHERITS}, ce AS (SELECT child AS src, parent AS dst FROM inherits WHERE kind = 'base' UNION SELECT p_partkey // 27, p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_partkey >= 27),
cr AS (SELECT src AS a, dst AS b FROM ce UNION SELECT cr.a, ce.dst FROM cr JOIN ce ON ce.src = cr.b),
cc AS (SELECT x.a AS node, min(x.b) AS component FROM cr x JOIN cr y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
cn AS (SELECT node, coalesce(component, node) AS component, component IS NOT NULL AS recursive FROM (SELECT src AS node FROM ce UNION SELECT dst FROM ce) LEFT JOIN cc USING (node)),
cs AS (SELECT component, count(*) AS size FROM cn GROUP BY component),
ca AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM ce JOIN cn a ON a.node = ce.src JOIN cn b ON b.node = ce.dst WHERE a.component <> b.component),
cw AS (SELECT component AS start, component AS place, size AS total FROM cs UNION SELECT cw.start, ca.dst, cw.total + cs.size FROM cw JOIN ca ON ca.src = cw.place JOIN cs ON cs.component = ca.dst),
cd AS (SELECT start AS component, max(total) - 1 AS depth FROM cw GROUP BY start)"""


def _cyclic(spark, sf):
    base = _inherits(spark, sf).filter("kind = 'base'").select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    p = table(spark, sf, "part").filter("p_partkey % 50 = 0 and p_partkey >= 27")
    return base.unionByName(p.select(F.expr("p_partkey div 27").alias("src"), F.col("p_partkey").alias("dst")))


@query(f"WITH RECURSIVE {CYCLIC} SELECT node, CAST(depth AS BIGINT) AS depth, recursive FROM cn JOIN cd USING (component)")
def call_depths(spark, sf):
    return graph.longest_depths(_cyclic(spark, sf))


@query(f"""WITH RECURSIVE {CYCLIC}, ct AS (SELECT ca.src, ca.dst, x.depth AS depth_left FROM ca JOIN cd x ON x.component = ca.src JOIN cd y ON y.component = ca.dst JOIN cs ON cs.component = ca.src WHERE x.depth = cs.size + y.depth),
cl AS (SELECT component AS node FROM cd WHERE depth = (SELECT max(depth) FROM cd) UNION SELECT ct.dst FROM cl JOIN ct ON ct.src = cl.node)
SELECT src, dst, CAST(depth_left AS BIGINT) AS depth_left FROM ct WHERE src IN (SELECT node FROM cl)""")
def longest_call_ways(spark, sf):
    return graph.longest_ways(_cyclic(spark, sf))


# On the call graph itself: one large component and what leads to it or away from it.
@query(f"""WITH RECURSIVE {E}, top AS (SELECT src AS node FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
f AS (SELECT node FROM top UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b AS (SELECT node FROM top UNION SELECT e.src FROM b JOIN e ON e.dst = b.node),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT node FROM f INTERSECT SELECT node FROM b),
c AS (SELECT node, CASE WHEN node IN (SELECT node FROM m) THEN -1 ELSE node END AS c FROM n), s AS (SELECT c, count(*) AS size FROM c GROUP BY c),
a AS (SELECT DISTINCT x.c AS src, y.c AS dst FROM e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.c <> y.c),
w AS (SELECT c AS start, c AS place, size AS total FROM s UNION SELECT w.start, a.dst, w.total + s.size FROM w JOIN a ON a.src = w.place JOIN s ON s.c = a.dst),
d AS (SELECT start AS c, max(total) - 1 AS depth FROM w GROUP BY start)
SELECT CAST(max(depth) AS BIGINT) AS deepest, round(avg(depth), 6) AS mean, count(*) AS nodes FROM c JOIN d USING (c)""")
def call_graph_depth(spark, sf):
    d = graph.longest_depths(_edges(spark, sf))
    return d.agg(F.max("depth").alias("deepest"), F.round(F.avg("depth"), 6).alias("mean"), F.count(F.lit(1)).alias("nodes"))


# A caller returns to a part that is shipped with what it calls: a -A-> b -R-> c and a -N-> c.
@query(f"""WITH {R}, k AS (SELECT DISTINCT from_id, to_id, kind FROM refs)
SELECT x.from_id AS a, x.to_id AS b, y.to_id AS c FROM k x JOIN k y ON y.from_id = x.to_id AND y.kind = 'R' JOIN k z ON z.from_id = x.from_id AND z.to_id = y.to_id AND z.kind = 'N'
WHERE x.kind = 'A' AND x.from_id <> x.to_id AND y.to_id <> x.from_id AND y.to_id <> x.to_id""")
def pattern_matches(spark, sf):
    e = references(spark, sf).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind")
    return graph.match_pattern(e, [("a", "A", "b"), ("b", "R", "c"), ("a", "N", "c")]).select("a", "b", "c")


@query()  # an estimate; tests compare it with a search from every node
def approximate_path_length(spark, sf):
    return graph.approximate_path_length(_edges(spark, sf)).withColumn("mean_length", F.round("mean_length", 6))


# Distinct users of every day are kept as bitmaps; one day is counted anew and takes the place of its old bitmaps before all are united.
@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users_merged(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    kept = index.distinct_bitmaps(e, ["event_type", "day"], "user_id")
    again = index.distinct_bitmaps(e.filter("dayofmonth(day) = 3"), ["event_type", "day"], "user_id")
    return index.merged_bitmaps(index.replace_sketches(kept, again, ["event_type", "day"]), ["event_type"], "users")


# ---------------------------------------------------------------- nodes without callers or callees

# Types and what they derive from have roots and leaves, unlike the call graph of the sample, in which everything calls everything.
TREE = f"{INHERITS}, tree AS (SELECT child AS src, parent AS dst FROM inherits), tn AS (SELECT p_partkey AS node FROM part)"


def _tree(spark, sf):
    return _inherits(spark, sf).select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def _types(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"))


@query(f"WITH {TREE} SELECT node FROM tn WHERE node NOT IN (SELECT dst FROM tree)")
def underived_types(spark, sf):
    return graph.entry_points(_tree(spark, sf), _types(spark, sf))


@query(f"WITH {INHERITS} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT child FROM inherits WHERE kind = 'interface')")
def types_without_interface(spark, sf):
    implements = _inherits(spark, sf).filter("kind = 'interface'").select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return graph.leaves(implements, _types(spark, sf))


@query(f"""WITH RECURSIVE {TREE}, r AS (SELECT CAST(unnest([1, 5]) AS BIGINT) AS node UNION SELECT t.src FROM r JOIN tree t ON t.dst = r.node)
SELECT node FROM tn WHERE node NOT IN (SELECT node FROM r)""")
def types_not_below(spark, sf):
    found = graph.reachable(_tree(spark, sf), spark.createDataFrame([(1,), (5,)], "node long"), "backward", 100_000)
    return _types(spark, sf).join(found.select("node"), "node", "left_anti")


@query(f"WITH {TREE}, {S} SELECT dst AS node, count(*) AS uses FROM (SELECT DISTINCT src, dst FROM tree) t JOIN symbols s ON s.id = t.src GROUP BY dst HAVING bool_and(s.namespace IN ('PROMO', 'ECONOMY', 'STANDARD'))")
def test_only_types(spark, sf):
    tests = symbols(spark, sf).filter("namespace in ('PROMO', 'ECONOMY', 'STANDARD')").select(F.col("id").alias("node"))
    return graph.only_used_by(_tree(spark, sf).distinct(), tests)


@query(f"WITH {TREE}, {S} SELECT id, name, kind FROM symbols WHERE id NOT IN (SELECT dst FROM tree)")
def unused_types(spark, sf):
    used = _tree(spark, sf).select(F.col("dst").alias("to_id"))
    return usage.unused(symbols(spark, sf), used).select("id", "name", "kind")


# ---------------------------------------------------------------- streams

# An operation ends with a purchase or an error, pauses on a view, and is abandoned after four hours; the last ones may still be open.
LIVES = """o AS (SELECT user_id AS key, ts, event_type AS ev, lag(event_type) OVER w AS before, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before IN ('purchase', 'error') OR gap > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, ev ROWS UNBOUNDED PRECEDING) AS life FROM o),
h AS (SELECT *, first_value(ts) OVER l AS began, lead(ts) OVER l AS following, lead(ev) OVER l AS next_ev FROM g WINDOW l AS (PARTITION BY key, life ORDER BY ts, ev)),
i AS (SELECT key, life, min(ts) AS began, max(ts) AS ended, count(*) AS events, bool_or(ev = 'purchase') AS bought, bool_or(ev = 'error') AS failed,
CAST(floor(coalesce(sum(date_diff('microsecond', ts, following)) FILTER (ev = 'view'), 0) / 1000) AS BIGINT) AS paused_ms FROM h GROUP BY key, life)"""


@query(f"""WITH {LIVES} SELECT key, began, ended, events, paused_ms, CASE WHEN bought THEN 'finished' WHEN failed THEN 'failed' ELSE 'abandoned' END AS status
FROM i WHERE bought OR failed OR epoch_us(ended) // 1000 + 14400000 < (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events) OR EXISTS (SELECT 1 FROM i x WHERE x.key = i.key AND x.life > i.life)""")
def operation_lives(spark, sf):
    out, checkpoint, folder = (new_path(spark, f"lives-{k}") for k in ("out", "check", "in"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("event"))
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    lives = lifecycle.operation_lives(stream, ["purchase"], ["error"], ["view"], "4 hours", "10 minutes")
    windows.run_once(lives, out, checkpoint).awaitTermination()
    return spark.read.schema(lives.schema).parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})
