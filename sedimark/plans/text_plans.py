"""Queries over text: search, duplicates, edits, metrics and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import scoring, text
from sedimark.operators import duplicates, edits, search, transform, usage
from sedimark.sources.roles import FILES_SQL, LINES_SQL, files, lines
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


FI, LI = FILES_SQL, LINES_SQL

# ---------------------------------------------------------------- search

HITS = f"{FI}, {LI}, hits AS (SELECT path, line_no, CAST(instr(line, 'the ') AS INT) AS column_no, 'the ' AS match_text, line FROM lines WHERE instr(line, 'the ') > 0)"


@query(f"""WITH {HITS}, c AS (
SELECT path, line_no, array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|') AS before,
array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|') AS after FROM lines)
SELECT h.path, h.line_no, h.column_no, coalesce(c.before, '') AS before, coalesce(c.after, '') AS after FROM hits h JOIN c USING (path, line_no) ORDER BY h.path, h.line_no LIMIT 100 OFFSET 20""")
def search_text(spark, sf):
    f = files(spark, sf)
    found = search.page(search.matches(f, "the "), 20, 100)
    wide = search.with_context(f, found)
    joined = [F.array_join(f"context_{k}", "|").alias(k) for k in ("before", "after")]
    return wide.select("path", "line_no", "column_no", *joined)


@query(f"WITH {HITS} SELECT count(*) AS total_matches, count(DISTINCT path) AS files_with_matches, count(*) > 100 AS has_more FROM hits")
def search_totals(spark, sf):
    return search.totals(search.matches(files(spark, sf), "the "))


@query(f"""WITH {FI}, {LI} SELECT path, line_no, CAST(instr(line, regexp_extract(line, '(?i)[0-9]{{3}}-[0-9]{{4}}')) AS INT) AS column_no, regexp_extract(line, '(?i)[0-9]{{3}}-[0-9]{{4}}') AS match_text
FROM lines WHERE regexp_matches(line, '(?i)[0-9]{{3}}-[0-9]{{4}}')""")
def search_regex(spark, sf):
    found = search.matches(files(spark, sf), "[0-9]{3}-[0-9]{4}", regex=True, case_sensitive=False)
    return found.drop("line")


@query(f"WITH {FI}, {LI} SELECT path, line_no, CAST(instr(lower(line), 'license') AS INT) AS column_no, substr(line, instr(lower(line), 'license'), 7) AS match_text FROM lines WHERE instr(lower(line), 'license') > 0")
def search_ignoring_case(spark, sf):
    return search.matches(files(spark, sf), "License", case_sensitive=False).drop("line")


@query(f"WITH {FI} SELECT path FROM files WHERE path ILIKE 'src1%/%' AND NOT path ILIKE '%7'")
def search_file_selection(spark, sf):
    return search.select_files(files(spark, sf), "SRC1*/*", "*7").select("path")


@query(f"WITH {FI}, {LI} SELECT path, line_no, line FROM lines WHERE line_no BETWEEN 2 AND 3")
def partial_read(spark, sf):
    return search.line_range(files(spark, sf), 1, 2)


@query(f"WITH {FI} SELECT count(*) FILTER (contains(substr(text, 1, 512), chr(0))) AS binaries, count(*) AS n FROM files")
def binary_sniff(spark, sf):
    b = search.looks_binary(F.col("path"), F.col("text").cast("binary"))
    return files(spark, sf).agg(F.count_if(b).alias("binaries"), F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
SELECT count(*) FILTER (regexp_matches(line, '\\b(class|interface|struct|enum|record)\\s+body\\b')) AS types, count(*) AS n FROM l""")
def declaration_search(spark, sf):
    f = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    n = lines(f).agg(F.count(F.lit(1)).alias("n"))
    return search.declarations(f, "body").agg(F.count_if(F.col("form") == "type").alias("types")).join(F.broadcast(n))


@query("""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM u GROUP BY target""")
def using_directives(spark, sf):
    p = table(spark, sf, "pages")
    found = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"""WITH {FI}, {LI} SELECT path, line_no, CASE WHEN length(line) > 500 THEN 'long line' WHEN regexp_matches(line, 'TODO|FIXME') THEN 'note' END AS issue
FROM lines WHERE length(line) > 500 OR regexp_matches(line, 'TODO|FIXME')""")
def line_issues(spark, sf):
    return usage.line_issues(lines(files(spark, sf)), 500)


@query(f"""WITH {FI}, {LI}, t AS (SELECT path, line_no, line, CASE WHEN length(line) < 40 THEN line END AS head FROM lines)
SELECT path, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS heading FROM t""")
def nearest_heading(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line_no")
    head = F.when(F.length("line") < 40, F.col("line"))
    return lines(files(spark, sf)).select("path", "line_no", F.last(head, ignorenulls=True).over(w).alias("heading"))


# ---------------------------------------------------------------- duplicates

BLOCKS = f"""{FI}, blocks AS (SELECT id, path, language AS group_key, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '[.,]')) AS complexity, text, content_hash AS hash FROM files)"""
GROUPS = f"""{BLOCKS}, groups AS (SELECT hash, min(id) AS first_id, count(*) AS copies, arg_min(n_lines, id) AS n_lines, arg_min(complexity, id) AS complexity, count(DISTINCT path) AS files FROM blocks GROUP BY hash HAVING count(*) >= 2)"""
PAIRS = f"""{BLOCKS}, one AS (SELECT min(id) AS id, arg_min(group_key, id) AS group_key, arg_min(n_lines, id) AS n_lines, arg_min(text, id) AS text FROM blocks GROUP BY hash),
cut AS (SELECT id, group_key, n_lines, unnest(generate_series(1, n_lines)) AS at, unnest(string_split(text, chr(10))) AS line FROM one),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) / any_value(a.n_lines) AS similarity FROM cut a JOIN cut b ON a.group_key = b.group_key AND a.n_lines = b.n_lines AND a.at = b.at AND a.line = b.line AND a.id < b.id
GROUP BY a.id, b.id HAVING count(*) / any_value(a.n_lines) >= 0.5)"""


def _blocks(spark, sf):
    n, c = F.size(F.split("text", "\n", -1)), F.regexp_count("text", F.lit("[.,]"))
    return files(spark, sf).select("id", "path", F.col("language").alias("group_key"), n.alias("n_lines"), c.alias("complexity"), "text")


@query(f"WITH {GROUPS} SELECT * FROM groups")
def exact_duplicates(spark, sf):
    return duplicates.exact_groups(_blocks(spark, sf))


@query(f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_duplicates(spark, sf):
    return duplicates.near_pairs(_blocks(spark, sf), 0.5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {PAIRS}, u AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT component, count(*) AS members FROM (SELECT a, min(b) AS component FROM r GROUP BY a) GROUP BY component""")
def near_duplicate_groups(spark, sf):
    return duplicates.near_groups(duplicates.near_pairs(_blocks(spark, sf), 0.5))


@query(f"""WITH {GROUPS}, m AS (SELECT count(*) AS n_groups, CAST(sum(copies) AS BIGINT) AS blocks, CAST(sum((copies - 1) * n_lines) AS BIGINT) AS duplicate_lines, max(copies) AS largest FROM groups),
t AS (SELECT CAST(sum(n_lines) AS BIGINT) AS all_lines FROM blocks)
SELECT *, round(100.0 * duplicate_lines / all_lines, 4) AS percent, CAST(duplicate_lines * 0.5 AS DOUBLE) AS cost, CAST(round(duplicate_lines * 0.3, 4) AS DOUBLE) AS savings FROM m, t""")
def duplication_metrics(spark, sf):
    b = _blocks(spark, sf)
    return duplicates.metrics(duplicates.exact_groups(b), b.agg(F.sum("n_lines").alias("n")))


@query(f"WITH {PAIRS} SELECT CAST(least(floor(similarity * 10), 9) AS INT) AS band, count(*) AS pairs, round(avg(similarity), 6) AS mean FROM pairs GROUP BY 1")
def similarity_bands(spark, sf):
    return duplicates.similarity_bands(duplicates.near_pairs(_blocks(spark, sf), 0.5))


@query(f"""WITH {GROUPS}, h AS (SELECT split_part(path, '/', 1) AS directory, CAST(sum(complexity) AS BIGINT) AS score, count(*) AS blocks, CAST(sum(n_lines) AS BIGINT) AS lines FROM blocks WHERE hash IN (SELECT hash FROM groups) GROUP BY 1)
SELECT *, CASE WHEN score >= 100 OR blocks >= 10 THEN 'Critical' WHEN score >= 50 OR blocks >= 5 THEN 'High' WHEN score >= 20 OR blocks >= 3 THEN 'Medium' ELSE 'Low' END AS risk FROM h ORDER BY score DESC, directory LIMIT 10""")
def duplicate_hotspots(spark, sf):
    b = _blocks(spark, sf).withColumn("directory", F.substring_index("path", "/", 1))
    found = duplicates.hotspots(b, duplicates.exact_groups(b), "directory")
    return found.withColumn("risk", scoring.hotspot_risk(F.col("score"), F.col("blocks")))


@query(f"""WITH {GROUPS}, s AS (SELECT first_id, (least(1.0, copies * complexity / 50.0) + least(1.0, copies * 0.3 + n_lines * 0.01) + least(1.0, complexity * 0.05) + least(1.0, copies * 0.2)) / 4 AS s FROM groups)
SELECT first_id, CAST(round(s, 6) AS DOUBLE) AS impact, CASE WHEN s < 0.2 THEN 'Negligible' WHEN s < 0.4 THEN 'Minor' WHEN s < 0.6 THEN 'Moderate' WHEN s < 0.8 THEN 'Significant' ELSE 'Critical' END AS tier FROM s""")
def duplication_impact(spark, sf):
    return duplicates.impact(duplicates.exact_groups(_blocks(spark, sf)))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT a.name AS a, b.name AS b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS similarity FROM n a JOIN n b ON a.name < b.name)
SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.8""")
def similar_methods(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return duplicates.similar_names(names).withColumn("similarity", F.round("similarity", 6))


@query("""WITH p AS (SELECT doc_id AS k, text FROM documents WHERE doc_id % 2 = 0), q AS (SELECT doc_id - 1 AS k, text FROM documents WHERE doc_id % 2 = 1),
c AS (SELECT p.k, string_split(p.text, chr(10)) AS x, string_split(q.text, chr(10)) AS y, regexp_split_to_array(p.text, '\\s+') AS u, regexp_split_to_array(q.text, '\\s+') AS v FROM p JOIN q USING (k)),
s AS (SELECT k, CASE WHEN len(x) <> len(y) THEN 0.0 ELSE len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) / len(x) END AS s,
CASE WHEN len(u) <> len(v) THEN 0.0 ELSE len(list_filter(list_zip(u, v), lambda z: z[1] = z[2])) / len(u) END AS t FROM c)
SELECT k AS pair_id, round(s, 6) AS structural, round(0.7 * s + 0.3 * t, 6) AS combined FROM s""")
def compare_code_blocks(spark, sf):
    d = table(spark, sf, "documents")
    a = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), "text")
    b = d.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("pair_id"), "text")
    return duplicates.compare(a, b).withColumns({c: F.round(c, 6) for c in ("structural", "combined")})


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g'), '\s+', ' ', 'g') AS code FROM pages)
SELECT page_id, sha256(trim(array_to_string(list_transform(regexp_extract_all(code, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+'), lambda t: CASE WHEN regexp_full_match(t, '[a-zA-Z_][a-zA-Z0-9_]*') THEN 'IDENTIFIER' ELSE t END), ''))) AS hash FROM c""")
def normalised_code_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.normalise_code(F.col("html")), 256).alias("hash"))


@query("""SELECT doc_id, len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'der', 'les', 'que'])) AS shared FROM documents""")
def pattern_intersection(spark, sf):
    words = F.array(*map(F.lit, ("the", "of", "der", "les", "que")))
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_intersect(F.split("text", " "), words)).cast("long").alias("shared"))


# ---------------------------------------------------------------- edits

PATTERN = "\\b(the|of)\\b"


@query(f"""WITH {FI}, r AS (SELECT path, len(regexp_extract_all(text, '{PATTERN}')) AS n, regexp_replace(text, '{PATTERN}', '<\\1>', 'g') AS t FROM files)
SELECT path, n AS n_matches, n > 0 AS changed, sha256(t) AS hash FROM r""")
def bulk_replace(spark, sf):
    done = edits.bulk_replace(files(spark, sf), PATTERN, "<$1>")
    return done.select("path", F.col("n_matches").cast("long"), "changed", F.sha2("new_text", 256).alias("hash"))


@query(f"""WITH {FI}, r AS (SELECT octet_length(encode(text)) AS b, len(regexp_extract_all(text, '{PATTERN}')) AS n, octet_length(encode(regexp_replace(text, '{PATTERN}', '<\\1>', 'g'))) AS a FROM files)
SELECT count(*) AS n_files, count(*) FILTER (n > 0) AS n_changed, count(*) FILTER (n = 0) AS n_skipped, CAST(sum(n) AS BIGINT) AS n_matches, CAST(sum(a - b) AS BIGINT) AS bytes_grown FROM r""")
def bulk_edit_summary(spark, sf):
    return edits.edit_summary(edits.bulk_replace(files(spark, sf), PATTERN, "<$1>"))


@query(f"WITH {FI}, m AS (SELECT path, regexp_extract_all(text, '{PATTERN}') AS m FROM files) SELECT path, CAST(unnest(generate_series(0, len(m) - 1)) AS INT) AS match_no, unnest(m) AS match_text FROM m")
def preview_bulk_changes(spark, sf):
    return edits.preview(files(spark, sf), PATTERN)


@query(f"""WITH {FI}, c AS (SELECT path, text, contains(text, 'License') AND octet_length(encode(text)) BETWEEN 100 AND 5000 AND NOT contains(path, 'src0/') AS e FROM files)
SELECT path, e AS edited, sha256(CASE WHEN e THEN 'checked' || chr(10) || text ELSE text END) AS hash FROM c""")
def conditional_edit(spark, sf):
    when = edits.condition("contains", value="License") & edits.condition("size", low=100, high=5000) & edits.condition("directory", negate=True, value="src0/")
    done = edits.conditional_edit(files(spark, sf), when, F.concat(F.lit("checked\n"), "text"))
    return done.select("path", "edited", F.sha2("new_text", 256).alias("hash"))


@query(f"WITH {FI}, m AS (SELECT path, text, regexp_replace(regexp_replace(text, 'tion', 'TION', 'g'), 'TION[ .]', '#', 'g') AS t FROM files) SELECT path, t <> text AS changed, sha256(t) AS hash FROM m")
def multi_file_edit(spark, sf):
    done = edits.multi_edit(files(spark, sf), [(2, "TION[ .]", "#"), (1, "tion", "TION")])
    return done.select("path", "changed", F.sha2("new_text", 256).alias("hash"))


@query(f"WITH {FI} SELECT path, sha256(substr(text, 1, 2) || 'AA' || substr(text, 6, 5) || 'B' || substr(text, 13)) AS hash FROM files")
def apply_edits(spark, sf):
    f = files(spark, sf)
    made = [f.select("path", F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new")) for a, b, n in ((2, 5, "AA"), (10, 12, "B"))]
    return edits.apply_edits(f, made[0].unionByName(made[1])).select("path", F.sha2("new_text", 256).alias("hash"))


INTERVALS = """i AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, CAST(l_suppkey AS VARCHAR) AS path,
CAST(epoch(l_shipdate) / 86400 AS INT) AS s FROM lineitem)"""


@query(f"WITH {INTERVALS} SELECT a.path, count(*) AS pairs FROM i a JOIN i b ON a.path = b.path AND a.id < b.id AND a.s <= b.s + 30 AND b.s <= a.s + 30 GROUP BY a.path")
def edit_conflicts(spark, sf):
    start = F.unix_date(F.to_date("l_shipdate"))
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), start.alias("start"), (start + 30).alias("end"))
    return edits.conflict_counts(e)


@query(f"""WITH {FI}, s AS (SELECT octet_length(encode(text)) AS b, len(string_split(text, chr(10))) AS l FROM files)
SELECT count(*) AS n_files, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(floor(avg(b)) AS BIGINT) AS mean_bytes, min(b) AS min_bytes, max(b) AS max_bytes, CAST(sum(l) AS BIGINT) AS total_lines FROM s""")
def bulk_file_statistics(spark, sf):
    return edits.file_statistics(files(spark, sf))


@query(f"WITH {FI} SELECT count(*) AS n_files, round(least(100.0, count(*) / 10 + sum(octet_length(encode(text))) / 1048576.0), 4) AS complexity FROM files")
def estimate_bulk_impact(spark, sf):
    return edits.impact_estimate(files(spark, sf))


@query(f"WITH {FI} SELECT path, id % 13 <> 0 AS intact FROM files")
def rollback_integrity(spark, sf):
    f = files(spark, sf)
    return edits.verify_backup(f, f.withColumn("text", F.when(F.col("id") % 13 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))))


@query(f"""WITH {FI}, {LI} SELECT path, line_no - 1 AS line_no, line AS old, replace(line, 'tion', 'X') AS new FROM lines WHERE contains(line, 'tion')""")
def diff_preview(spark, sf):
    f = files(spark, sf)
    return edits.line_diff(f, f.withColumn("text", F.replace("text", F.lit("tion"), F.lit("X"))))


# ---------------------------------------------------------------- metrics

# What counts as an operator; the first that matches at a place counts, so two-character ones count as two.
OPERATOR_SIGNS = ["+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "++", "--"]
OPERATORS = "|".join("".join(f"\\{c}" if c in "+*|" else c for c in sign) for sign in OPERATOR_SIGNS)
#: Word boundaries are Unicode in one engine and ASCII in the other, so the SQL takes words apart and looks at each.
CODE = rf"""w AS (SELECT page_id, html, regexp_extract_all(html, '[\p{{L}}\p{{Nd}}_]+') AS words FROM pages),
c AS (SELECT page_id, len(string_split(html, chr(10))) AS n_lines, length(html) AS n_chars, len(regexp_extract_all(html, '{OPERATORS}')) AS operators,
len(list_filter(words, lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS operands, 1 + len(list_filter(words, lambda x: x IN ('if', 'for', 'while', 'case', 'catch'))) AS cyclomatic FROM w)"""


def _code(spark, sf):
    def n(p):
        return F.regexp_count("html", F.lit(p)).cast("long")

    return table(spark, sf, "pages").select(
        "page_id", F.size(F.split("html", "\n", -1)).cast("long").alias("n_lines"), F.length("html").alias("n_chars"), n(OPERATORS).alias("operators"),
        n(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b").alias("operands"), (1 + n(r"\b(if|for|while|case|catch)\b")).alias("cyclomatic"),
    )


@query(f"""WITH {CODE} SELECT CASE WHEN n_lines < 200 THEN 'Small' WHEN n_lines < 500 THEN 'Medium' WHEN n_lines < 1000 THEN 'Large' WHEN n_lines < 2000 THEN 'VeryLarge' ELSE 'Enormous' END AS bucket,
count(*) AS files, CAST(floor(avg(n_lines)) AS BIGINT) AS mean_lines FROM c GROUP BY 1""")
def file_size_distribution(spark, sf):
    b = _code(spark, sf).withColumn("bucket", scoring.size_bucket(F.col("n_lines")))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.floor(F.avg("n_lines")).alias("mean_lines"))


@query(f"""WITH {CODE}, v AS (SELECT *, CASE WHEN operators + operands > 0 THEN CAST(floor(n_chars * log2(operators + operands)) AS BIGINT) ELSE 0 END AS volume FROM c)
SELECT page_id, cyclomatic, volume, CASE WHEN volume = 0 THEN 100.0 ELSE round(greatest(0.0, least(100.0, CAST(171 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(n_lines) AS DOUBLE))), 4) END AS maintainability,
CASE WHEN cyclomatic <= 10 THEN 'Simple' WHEN cyclomatic <= 20 THEN 'Moderate' WHEN cyclomatic <= 50 THEN 'Complex' ELSE 'VeryComplex' END AS level FROM v""")
def complexity_metrics(spark, sf):
    v = _code(spark, sf).withColumn("volume", scoring.halstead_volume(F.col("operators"), F.col("operands"), F.col("n_chars")))
    m = F.round(scoring.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("n_lines")), 4)
    return v.select("page_id", "cyclomatic", "volume", m.alias("maintainability"), scoring.complexity_level(F.col("cyclomatic")).alias("level"))


@query(f"""WITH {CODE}, s AS (SELECT page_id, (least(1.0, n_lines / 50.0) + least(1.0, operators / 700.0) + least(1.0, operands / 1000.0) + least(1.0, cyclomatic / 10.0)) / 4 AS s FROM c)
SELECT page_id, round(s, 6) AS score, CASE WHEN s <= 0.3 THEN 'None' WHEN s <= 0.5 THEN 'Low' WHEN s <= 0.7 THEN 'Medium' WHEN s <= 0.9 THEN 'High' ELSE 'Critical' END AS severity,
CASE WHEN s <= 0.4 THEN 'Low' WHEN s <= 0.6 THEN 'Medium' WHEN s <= 0.8 THEN 'High' ELSE 'Critical' END AS priority FROM s""")
def god_methods(spark, sf):
    s = scoring.mean_excess([(F.col("n_lines"), 50), (F.col("operators"), 700), (F.col("operands"), 1000), (F.col("cyclomatic"), 10)])
    scored = _code(spark, sf).select("page_id", s.alias("s"))
    return scored.select("page_id", F.round("s", 6).alias("score"), scoring.severity(F.col("s")).alias("severity"), scoring.priority(F.col("s")).alias("priority"))


@query(f"""WITH {CODE}, s AS (SELECT (operands - 300) / 300.0 AS r FROM c WHERE operands > 300)
SELECT CASE WHEN r <= 0.2 THEN 'Minor' WHEN r <= 0.5 THEN 'Major' WHEN r <= 1.0 THEN 'Critical' ELSE 'Blocker' END AS severity, count(*) AS n FROM s GROUP BY 1""")
def code_smells(spark, sf):
    over = _code(spark, sf).filter("operands > 300")
    return over.groupBy(scoring.excess_severity(F.col("operands"), 300).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CODE}, s AS (SELECT page_id, n_lines / 1000.0 + (cyclomatic > 3)::INT * 0.2 + (operands > 300)::INT * 0.1 + (operators > 200)::INT * 0.05 AS s FROM c)
SELECT page_id, CASE WHEN s <= 0.4 THEN 'Low' WHEN s <= 0.7 THEN 'Medium' WHEN s <= 1.0 THEN 'High' ELSE 'Critical' END AS priority FROM s""")
def optimisation_priority(spark, sf):
    flags = [F.col(c).cast("int") for c in ("big", "wide", "dense")]
    c = _code(spark, sf).withColumns({"big": F.col("cyclomatic") > 3, "wide": F.col("operands") > 300, "dense": F.col("operators") > 200})
    return c.select("page_id", scoring.file_priority(F.col("n_lines"), *flags).alias("priority"))


# ---------------------------------------------------------------- transforms and responses


@query(f"""WITH {FI}, {LI} SELECT path, line_no, line_no || ': > ' || replace(trim(line), 'tion', 'SION') || ' <' AS line FROM lines WHERE length(trim(line)) > 0 AND contains(line, 'e')""")
def stream_line_processor(spark, sf):
    kept = F.col("line").contains("e")
    return transform.process_lines(lines(files(spark, sf)), True, True, kept, ("tion", "SION"), "> ", " <", True)


@query(f"WITH {FI}, {LI} SELECT path, line_no, regexp_replace(line, '[0-9]+', '#', 'g') AS line FROM lines WHERE regexp_matches(line, '[0-9]')")
def stream_regex_processor(spark, sf):
    return transform.process_regex(transform.process_regex(lines(files(spark, sf)), "[0-9]"), "[0-9]+", "#")


@query("SELECT c_custkey, c_mktsegment || ',' || c_name AS line FROM customer")
def stream_csv_processor(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select("c_custkey", F.concat_ws(",", F.concat(F.lit('"'), "c_name", F.lit('"')), F.concat(F.lit(" "), "c_mktsegment"), F.lit("x")).alias("line"))
    return transform.process_csv(rows, [1, 0], 3)


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def stream_checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(text.checksum(F.col("text"), a).alias(a.lower()) for a in ("SHA256", "MD5", "SHA1")))


@query(f"WITH {FI} SELECT path, (length(text) - length(replace(text, 'tion', ''))) // 4 AS replaced, sha256(replace(text, 'tion', 'sion!')) AS hash FROM files")
def stream_binary_processor(spark, sf):
    done = transform.replace_bytes(files(spark, sf).withColumnRenamed("text", "content"), b"tion", b"sion!")
    return done.select("path", "replaced", F.sha2("content", 256).alias("hash"))


@query("""SELECT doc_id, sha256(array_to_string(list_sort(list_filter(string_split(trim(text), chr(10)), lambda x: length(trim(x)) > 0)), chr(10))) AS hash FROM documents""")
def text_transforms(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(transform.transform_text(F.col("text"), "trim", "drop_blank", "sort_lines"), 256).alias("hash"))


@query("""SELECT count(*) FILTER (event_type = 'purchase') AS completed, round(sum(value), 2) AS bytes, round(avg(value), 4) AS mean_ms, count(*) FILTER (event_type = 'click') AS running FROM events""")
def stream_statistics(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "running")
    done = transform.operation_statistics(table(spark, sf, "events").select(status.alias("status"), F.col("value").alias("bytes"), F.col("value").alias("ms")))
    return done.withColumns({"bytes": F.round("bytes", 2), "mean_ms": F.round("mean_ms", 4)})


@query(f"""WITH {FI}, {LI}, b AS (SELECT path, line_no, octet_length(encode(line)) + 1 AS n FROM lines)
SELECT path, line_no, CAST(coalesce(sum(n) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM b""")
def chunk_offsets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0))
    return lines(files(spark, sf)).select("path", "line_no", at.alias("at"))


@query(f"WITH {FI} SELECT path, size_bytes // 100 AS seconds FROM files")
def estimate_stream_processing(spark, sf):
    return files(spark, sf).select("path", transform.time_estimate(F.col("size_bytes"), 100).alias("seconds"))


@query("SELECT doc_id, CAST(ceil(length(text) * 0.25) AS BIGINT) AS tokens FROM documents")
def response_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(r"""WITH c AS (SELECT doc_id, text, substr(text, 1, 185) AS cut FROM documents), w AS (SELECT *, regexp_replace(cut, '(?s) [^ ]*$', '') AS words FROM c)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(cut, ' ') AND length(words) > 148 THEN words || '... [truncated]' ELSE cut || '... [truncated]' END AS short FROM w""")
def response_truncation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("short"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents),
s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (n <= 300 OR k = 1), '') AS short FROM s GROUP BY doc_id""")
def response_line_truncation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_units(F.col("text"), 300, "\n").alias("short"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal FROM part")
def identifier_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.valid_identifier(F.col("p_name")).alias("valid"), text.pascal_case(F.col("p_name")).alias("pascal"))


@query("""SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON substr(a.p_brand, 1, 7) = substr(b.p_brand, 1, 7) AND a.p_brand < b.p_brand""")
def type_compatibility(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_brand").alias("a")).distinct().withColumn("k", F.substring("a", 1, 7))
    met = b.join(b.withColumnRenamed("a", "b"), "k").filter("a < b")
    as_type = [F.concat("k", F.lit("<"), c, F.lit(">")) for c in ("a", "b")]
    return met.filter(text.type_compatible(*as_type)).select("a", "b")


@query("SELECT CASE WHEN n LIKE 'Get%' THEN 'Data Access' WHEN n LIKE 'Validate%' THEN 'Validation' ELSE 'Other' END AS responsibility, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'Get' WHEN 1 THEN 'Validate' ELSE 'Do' END || p_name AS n FROM part) GROUP BY 1")
def method_responsibilities(spark, sf):
    start = F.when(F.col("p_partkey") % 3 == 0, "Get").when(F.col("p_partkey") % 3 == 1, "Validate").otherwise("Do")
    n = table(spark, sf, "part").select(F.concat(start, "p_name").alias("name"))
    return n.groupBy(text.responsibility(F.col("name")).alias("responsibility")).agg(F.count(F.lit(1)).alias("n"))
