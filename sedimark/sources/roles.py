"""Logical roles bound to the sample tables: files, lines, symbols and references.

The operators take these shapes; a code index with the same columns fits as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.storage import table


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_id, name, kind, namespace."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").alias("file_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("kind"),
        F.col("p_type").alias("namespace"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, kind, file_id, line: each row of an order refers to the next one."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("from_id"),
        F.lead("l_partkey").over(in_order).alias("to_id"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").alias("line"),
    )
    return rows.filter("to_id is not null")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, content_hash, size_bytes, language, text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("lang").alias("language"),
        "text",
    )


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line of every line of every file."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a source file for each part, with a namespace of its type and brand and one class; methods nest by its size."""
    brand, key, size = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey"), F.col("p_size").cast("string")
    deep = (F.col("p_size") % 5).cast("int")
    name = F.concat(F.lit("Part"), key)
    upgrade = key % 3 == 0
    lines = [
        F.when(upgrade, "using NUnit.Framework;").otherwise("using System;"),
        F.concat(F.lit("namespace "), "p_type", F.lit("."), brand), F.lit("{"), F.lit("    // class Fake { }"),
        F.concat(F.lit("    public class "), name, F.lit(" : Base"), size, F.lit("<int>")), F.lit("    {"),
        F.concat(F.lit("        private int count"), size, F.lit(" = "), size, F.lit(";")), F.lit("        public string Title { get; set; }"),
        F.concat(F.lit("        public "), name, F.lit("(int a) { count"), size, F.lit(" = a; }")),
        F.concat(F.lit("        public int Run"), brand, F.lit("(int a, string b)")), F.lit("        {"), F.lit('            var s = "not { a brace";'),
        F.when(deep > 0, F.array_join(F.array_repeat(F.lit("            if (a > 1) {"), deep), "\n")), F.lit("            a++;"),
        F.when(deep > 0, F.array_join(F.array_repeat(F.lit("            }"), deep), "\n")),
        F.lit("            foreach (var x in b) { if (x > 1 && a > 2) a--; }"), F.lit("            try { a++; } catch (Exception e) { throw; }"),
        F.when(upgrade, "            Assert.AreEqual(1, a);").otherwise("            Check(a);"), F.lit("            /* { */"), F.lit("            a += b.Length;"), F.lit(""),
        F.concat(F.lit("            var o = new Part"), F.floor(key / 10), F.lit("(a);")), F.lit("            return a;"), F.lit("        }"), F.lit("    }"), F.lit("}"),
    ]
    return table(spark, sf_dir, "part").select(F.concat(key, F.lit(".cs")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


#: The same roles as common table expressions, for the SQL that queries are checked against.
SYMBOLS_SQL = "symbols AS (SELECT p_partkey AS id, p_size AS file_id, p_name AS name, p_brand AS kind, p_type AS namespace FROM part)"
REFERENCES_SQL = """refs AS (
  SELECT * FROM (
    SELECT l_partkey AS from_id,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS to_id,
           l_returnflag AS kind, l_orderkey AS file_id, l_linenumber AS line
    FROM lineitem) WHERE to_id IS NOT NULL)"""
FILES_SQL = """files AS (
  SELECT doc_id AS id, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, sha256(text) AS content_hash,
         CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, lang AS language, text FROM documents)"""
LINES_SQL = """lines AS (
  SELECT path, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, unnest(ls) AS line
  FROM (SELECT path, string_split(text, chr(10)) AS ls FROM files))"""
