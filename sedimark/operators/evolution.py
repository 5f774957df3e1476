"""Change logs in order: breaking changes, dependencies, schema differences, risk and effort.

A log is (seq, name, op, table_name, column_name); seq orders the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.scoring import overall_risk

# Operations that lose data or break readers, and how severely.
BREAKING = {"DropTable": "Critical", "DropColumn": "High", "AlterColumn": "Medium", "RenameTable": "High"}

# Names of the calls that a step's text is read for, by what their first argument is.
TABLE_CALLS = ["CreateTable", "DropTable", "RenameTable"]
COLUMN_CALLS = ["AddColumn", "DropColumn", "AlterColumn"]
PART_CALLS = ["CreateIndex", "DropIndex", "AddForeignKey", "DropForeignKey", "AddPrimaryKey", "DropPrimaryKey"]

_ARGUMENT = r"(?:(?<{0}>\w+)\s*:\s*)?[\"'](?<{1}>[^\"']+)[\"']"
#: A call: the word before the parenthesis, a first quoted argument and, after a comma, a second one; each may be named.
CALL = r"(?i)\b\w+(?:<[^>]*>)?\s*\(\s*" + _ARGUMENT.format("a", "b") + r"(?:\s*,\s*" + _ARGUMENT.format("c", "d") + ")?"


def parse_steps(files: DataFrame) -> DataFrame:
    """(seq, name, direction, op, table_name, column_name) from files (seq, name, text), one row per call.

    Calls after the text's ``Down`` method are its way back. A call is known by its name without case; the
    argument named ``name`` is a table's for calls on tables and a column's for calls on columns. Free SQL has no table name
    but the statement.
    """
    known = F.create_map(*[F.lit(x) for op in (*TABLE_CALLS, *COLUMN_CALLS, *PART_CALLS, "Sql") for x in (op.lower(), op)])
    halves = F.split("text", r"(?i)\bvoid\s+Down\s*\(", 2)
    half = F.posexplode(F.transform(halves, lambda t: F.regexp_extract_all(t, F.lit(CALL), F.lit(0))))
    found = files.select("seq", "name", half.alias("half", "calls")).select("seq", "name", "half", F.explode("calls").alias("call"))
    parts = found.withColumn("op", known[F.lower(F.regexp_extract("call", r"^\w+", 0))]).filter("op is not null")
    values = {c: F.regexp_extract("call", CALL, k) for k, c in enumerate("abcd", 1)}
    parts = parts.withColumns(values).withColumn("named", F.create_map(F.lower("a"), F.col("b")))
    on_table = F.col("op").isin(*TABLE_CALLS, "Sql")
    # ``table:`` may come first or second; without names the order is column, then table, as in the calls' signatures.
    table = F.when(on_table, F.col("b")).when(F.lower("a") == "table", F.col("b")).when(F.lower("c") == "table", F.col("d")).when(F.col("d") != "", F.col("d")).otherwise(F.col("b"))
    column = F.when(F.col("op").isin(*COLUMN_CALLS), F.when(F.lower("a") == "table", F.col("d")).when(F.col("d") != "", F.col("b")))
    direction = F.when(F.col("half") == 0, "Up").otherwise("Down")
    return parts.select("seq", "name", direction.alias("direction"), "op", table.alias("table_name"), F.nullif(column, F.lit("")).alias("column_name"))


def breaking_changes(log: DataFrame) -> DataFrame:
    """Breaking steps with their severity and the step before them on the same table."""
    table = F.create_map(*[F.lit(x) for kv in BREAKING.items() for x in kv])
    before = F.lag("name").over(Window.partitionBy("table_name").orderBy("seq", "name"))
    rows = log.withColumn("previous", before).withColumn("severity", table[F.col("op")])
    return rows.filter("severity is not null").select("seq", "name", "op", "table_name", "severity", "previous")


def dependencies(log: DataFrame) -> DataFrame:
    """(name, depends_on): each step depends on every step before it on one of its tables."""
    steps = log.select("table_name", "seq", "name").distinct()
    before = steps.select("table_name", F.col("seq").alias("earlier"), F.col("name").alias("depends_on"))
    met = steps.join(before, "table_name").filter("struct(earlier, depends_on) < struct(seq, name) and name <> depends_on")
    return met.select("name", "depends_on").distinct()


def implicit_dependencies(log: DataFrame) -> DataFrame:
    """Steps on a table that an earlier step made: the semi join of uses with creations before them."""
    made = log.filter("op = 'CreateTable'").groupBy("table_name").agg(F.min("seq").alias("made"))
    return log.filter("op <> 'CreateTable'").join(made, "table_name").filter("made < seq").select("seq", "name", "op", "table_name", "made")


def step_range(log: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Steps from ``first`` to ``last``, both inclusive; no end means to the end."""
    rows = log.filter(F.col("seq") >= first) if first is not None else log
    return rows.filter(F.col("seq") <= last) if last is not None else rows


def schema_at(log: DataFrame, seq: int) -> DataFrame:
    """Tables that exist after step ``seq``: the last of create and drop decides."""
    past = log.filter((F.col("seq") <= seq) & F.col("op").isin("CreateTable", "DropTable"))
    last = past.groupBy("table_name").agg(F.max_by("op", F.struct("seq", "name")).alias("op"))
    return last.filter("op = 'CreateTable'").select("table_name")


def schema_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, change) between two lists of tables: Create, Drop; unchanged tables are left out."""
    a, b = before.select("table_name", F.lit(True).alias("a")), after.select("table_name", F.lit(True).alias("b"))
    met = a.join(b, "table_name", "full_outer").filter("a is null or b is null")
    return met.select("table_name", F.when(F.col("a").isNull(), "Create").otherwise("Drop").alias("change"))


def growth(snapshots: DataFrame) -> DataFrame:
    """First against last of snapshots (seq, size): absolute and percent change and trend."""
    ends = snapshots.agg(F.min_by("size", "seq").alias("first"), F.max_by("size", "seq").alias("last"))
    change = F.col("last") - F.col("first")
    trend = F.when(change > 0, "Growing").when(change < 0, "Shrinking").otherwise("Stable")
    return ends.select("first", "last", change.alias("change"), F.round(F.when(F.col("first") != 0, 100.0 * change / F.col("first")), 4).alias("percent"), trend.alias("trend"))


def repeated_names(log: DataFrame) -> DataFrame:
    return log.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def summary(log: DataFrame) -> DataFrame:
    """One row: steps, operations, breaking ones by severity, and the overall risk."""
    table = F.create_map(*[F.lit(x) for kv in BREAKING.items() for x in kv])
    rows = log.withColumn("severity", table[F.col("op")])
    out = rows.agg(
        F.countDistinct("name").alias("steps"),
        F.count(F.lit(1)).alias("operations"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if(F.col("severity").isNotNull()).alias("breaking"),
    )
    return out.withColumn("risk", overall_risk(F.col("critical"), F.col("high"), F.col("breaking")))


def effort(log: DataFrame) -> DataFrame:
    """Per step: seconds (1, half an operation, 2 more for made tables and free SQL), bytes, and whether it needs downtime."""
    seconds = 1 + F.sum(F.when(F.col("op").isin("CreateTable", "Sql"), 2.5).otherwise(0.5))
    size = F.sum(F.when(F.col("op") == "CreateTable", 1024 * 1024).when(F.col("op") == "AddColumn", 1024 * 100).otherwise(0))
    down = F.bool_or(F.col("op").isin("DropTable", "AlterColumn"))
    return log.groupBy("seq", "name").agg(seconds.alias("seconds"), size.alias("bytes"), down.alias("downtime"))
