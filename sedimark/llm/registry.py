"""The queries of this subpackage and, where SQL can say the same, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import archives, decontam, exact_dedup, jaccard, langid, mixing, periodic, personal_data, quality, ranking, sampling, suffix_dedup, token_counts, toxicity
from sedimark.storage import table

QUALITY_HELD_OUT = (4, 2)
TOXIC_HELD_OUT = (3, 1)
LANGUAGE_HELD_OUT = (4, 2)


def _training(docs: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    return docs.filter(sampling.crc_mod(F.col("doc_id"), held_out[0]) != held_out[1])


def _held_out(held_out: tuple[int, int]):
    return (sampling.crc_mod(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out")


def _predicted(threshold: float):
    return (F.col("score") >= threshold).cast("int").alias("predicted")


def quality_model(docs: DataFrame, labels: DataFrame):
    """The production model: learned from the rows that are not held out."""
    return quality.fit_quality(_training(docs, QUALITY_HELD_OUT), labels)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.quality_scores(docs, quality_model(docs, labels))
    return scored.select("doc_id", _held_out(QUALITY_HELD_OUT), "score", _predicted(quality.THRESHOLD))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archives.write_packages(archives.with_roles(table(spark, sf_dir, "pages")))
    return archives.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, exceptions = toxicity.fit_lexicon(_training(docs, TOXIC_HELD_OUT), labels)
    scored = toxicity.toxicity_scores(docs, lexicon, exceptions)
    return scored.select("doc_id", _held_out(TOXIC_HELD_OUT), "score", _predicted(0.7), "n_matches")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language(_training(docs, LANGUAGE_HELD_OUT))
    return langid.detect_language(docs, model).select("doc_id", _held_out(LANGUAGE_HELD_OUT), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_summary(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = docs.select("doc_id", periodic.with_periodic_tails(docs).alias("text"))
    return periodic.run_summary(periodic.periodic_runs(given))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_quality_classifier,
        op2_jaccard_join,
        op3_exact_dedup,
        op4_token_counts,
        op5_web_archives,
        op6_toxicity,
        op7_source_mix,
        op8_suffix_dedup,
        op9_language_id,
        op10_benchmark_decontamination,
        op11_personal_data,
        op12_periodic_runs,
        op13_ranked_search,
    ]
    return {f.__name__: f for f in named}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM q
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CAST([5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w,
         CAST(2.0 AS DOUBLE) * source_size AS cap
  FROM s),
l AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS full_cap, coalesce(sum(w) OVER before, 0) AS full_w,
         sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * all_size - full_cap) / (all_w - full_w) AS level FROM l),
a AS (SELECT level AS lvl FROM v WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce(lvl * w, cap)) AS target,
         CASE WHEN source_size > 0 THEN least(cap, coalesce(lvl * w, cap)) / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5(coalesce(source, '') || CASE WHEN source IS NULL THEN '/null/' ELSE '/' END || 'mix-1'), 1, 8))
              AS UBIGINT) / CAST(4294967296.0 AS DOUBLE) AS u
  FROM v LEFT JOIN a ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d)
SELECT r.doc_id, r.size, t.source_size, t.target,
       CAST((floor(k * rate + u) - floor((k - 1) * rate + u)) * r.size AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""


#: The CRC is folded bit by bit over the decimal digits. Runs come from pairs of equal 16-grams: all words of a run but its last
#: period begin or continue one, so the pairs at one distance that follow each other give its ends.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                                     lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)), CAST(4294967295 AS BIGINT))) AS h
  FROM documents),
p AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
e AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM p),
k AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 16], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 16)) AS i FROM e WHERE len(w) >= 24)),
r AS (SELECT doc_id, g, list(i) AS places FROM k GROUP BY doc_id, g HAVING count(*) > 1),
x AS (SELECT doc_id, i, unnest(places) AS j FROM (SELECT doc_id, places, unnest(places) AS i FROM r)),
s AS (SELECT doc_id, j - i AS q, i, i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS island FROM x WHERE i < j),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
f AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM f),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM f GROUP BY doc_id),
c AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM e WHERE len(w) > 0),
t AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM c
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id AND c.i >= f.start + f.period AND c.i < f.start + f.length) GROUP BY doc_id)
SELECT e.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(t.kept, '')) AS collapsed_sha256
FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.place = 1 LEFT JOIN l ON l.doc_id = e.doc_id LEFT JOIN t ON t.doc_id = e.doc_id
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM t) GROUP BY doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), c),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op5_web_archives": OP5_SQL, "op7_source_mix": OP7_SQL,
        "op12_periodic_runs": OP12_SQL, "op13_ranked_search": OP13_SQL,
    }
