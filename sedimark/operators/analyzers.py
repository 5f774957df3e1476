"""Analyzers as table functions: registered once, called from SQL with ``LATERAL`` or on a whole table partitioned by path.

An analyzer is a list of text rules or any class with the methods of a table function. Its rows are issues: (path, rule, severity, line, column,
match, fix), ``fix`` being the text that should stand in place of the match, or null where the rule has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Rule(NamedTuple):
    id: str
    severity: str
    pattern: str
    fix: str | None = None


# The upgrade rules of the built-in analyzer.
UPGRADE_RULES = [
    Rule("NUNIT001", "Info", r"\[(?:NUnit\.)?TestFixture\]", "[Test]"),
    Rule("NUNIT002", "Warning", r"Assert\.AreEqual\(([^,]+),\s*([^,]+)\)", r"Assert.That(\2, Is.EqualTo(\1))"),
    Rule("NUNIT003", "Info", r"\[(?:NUnit\.)?SetUp\]"),
    Rule("NUNIT004", "Warning", r"\[(?:NUnit\.)?ExpectedException\((?:typeof\(([^)]+)\)|([^)]+))\)\]"),
    Rule("NUNIT005", "Info", r"Assert\.(True|False)\(string\.IsNullOrEmpty\(([^)]+)\)\)"),
    Rule("NUNIT006", "Info", r"using\s+NUnit\.Framework(?:\.Tests)?;"),
]

SCHEMA = StructType()
for _name, _type in (("path", StringType()), ("rule", StringType()), ("severity", StringType()), ("line", IntegerType()), ("column", IntegerType()), ("match", StringType()), ("fix", StringType())):
    SCHEMA = SCHEMA.add(_name, _type)


def rule_analyzer(rules: list[Rule], extensions: tuple[str, ...] = ()) -> type:
    """A table function that applies text rules to (path, text); with ``extensions`` only to files that have one of them.

    It takes two columns, or a table with the columns path and text. An optional third argument names the rules to apply, divided by commas; what it
    names must exist, which is checked when the query is analysed.
    """
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    names = {r.id for r in rules}

    class Analyzer:
        @staticmethod
        def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
            wanted = next((a.value for a in args[1:] if a.isConstantExpression and isinstance(a.value, str)), None) if len(args) in (2, 3) else None
            if wanted is not None and (unknown := set(wanted.split(",")) - names):
                raise ValueError(f"no such rules: {', '.join(sorted(unknown))}")
            return AnalyzeResult(SCHEMA)

        def eval(self, *args) -> Iterator[tuple]:
            if args and isinstance(args[0], Row):
                path, text, wanted = args[0]["path"], args[0]["text"], args[1] if len(args) > 1 else None
            else:
                path, text, wanted = args[0], args[1], args[2] if len(args) > 2 else None
            if text is None or extensions and not (path or "").lower().endswith(extensions):
                return
            chosen = None if wanted is None else set(wanted.split(","))
            for rule, pattern in compiled:
                if chosen is not None and rule.id not in chosen:
                    continue
                line, at = 1, 0
                for m in pattern.finditer(text):
                    line, at = line + text.count("\n", at, m.start()), m.start()
                    yield path, rule.id, rule.severity, line, m.start() - text.rfind("\n", 0, m.start()), m[0], None if rule.fix is None else m.expand(rule.fix)

    return Analyzer


def register(spark: SparkSession, name: str, analyzer: type) -> None:
    """Make an analyzer callable from SQL as ``name``."""
    spark.udtf.register(name, udtf(analyzer))


def analyze(files: DataFrame, name: str, rules: list[str] | None = None) -> DataFrame:
    """Issues of files (path, text) by a registered analyzer; each file goes to the task that has it, none is shuffled."""
    spark = files.sparkSession
    files.select("path", "text").createOrReplaceTempView("files_to_analyze")
    third = "" if rules is None else ", '" + ",".join(r.replace("'", "") for r in rules) + "'"
    return spark.sql(f"SELECT i.* FROM files_to_analyze f, LATERAL {name}(f.path, f.text{third}) i")


def issue_totals(issues: DataFrame) -> DataFrame:
    """(rule, severity, n, files): what an analyzer found, by rule and severity, with totals (null) by one roll-up."""
    return issues.rollup("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))
