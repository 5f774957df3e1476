"""Text search over lines: literal and regular-expression matches with context, paging and file selection."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.sources.roles import lines

# Directories and extensions that a search leaves out by default.
EXCLUDED_DIRECTORIES = (
    "bin", "obj", "node_modules", ".git", ".vs", ".vscode", "packages", "TestResults", ".idea", "out", "dist", "build",
)
BINARY_EXTENSIONS = (
    ".dll", ".exe", ".pdb", ".bin", ".obj", ".lib", ".so", ".dylib", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".pdf", ".zip",
    ".tar", ".gz", ".7z", ".rar", ".mp3", ".mp4", ".avi", ".mov",
)


def glob(path: Column, pattern: str) -> Column:
    """Case-insensitive glob on a path or, for patterns without a slash, on its last part."""
    body = fnmatch.translate(pattern).removeprefix("(?s:").rpartition(")")[0]
    target = path if "/" in pattern else F.element_at(F.split(path, "/"), -1)
    return target.rlike(f"(?is)^{body}$")


def select_files(files: DataFrame, include: str | None = None, exclude: str | None = None, directories: tuple = EXCLUDED_DIRECTORIES) -> DataFrame:
    """Files that match ``include`` and not ``exclude`` and lie in no excluded directory."""
    names = "|".join(re.escape(d) for d in directories)
    kept = files.filter(~F.col("path").rlike(rf"(?i)(^|/)({names})/")) if directories else files
    kept = kept.filter(glob(F.col("path"), include)) if include else kept
    return kept.filter(~glob(F.col("path"), exclude)) if exclude else kept


def looks_binary(path: Column, content: Column) -> Column:
    """A binary extension, a zero byte in the first 512, or no content to read."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(list(BINARY_EXTENSIONS))
    return extension | content.isNull() | F.hex(F.substring(content, 1, 512)).rlike("^(..)*?00")


def line_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of each file, from 0, both inclusive, clamped to the file."""
    return lines(files).filter(F.col("line_no").between(first + 1, last + 1))


def matches(files: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """path, line_no, column_no (from 1), match_text, line: the first match of each line."""
    found = lines(files)
    if regex:
        p = pattern if case_sensitive else f"(?i){pattern}"
        found = found.filter(F.col("line").rlike(p))
        text = F.regexp_substr("line", F.lit(p))
        return found.select("path", "line_no", F.instr("line", text).alias("column_no"), text.alias("match_text"), "line")
    line = F.col("line") if case_sensitive else F.lower("line")
    at = F.locate(pattern if case_sensitive else pattern.lower(), line)
    found = found.withColumn("column_no", at).filter("column_no > 0")
    return found.select("path", "line_no", "column_no", F.substring("line", F.col("column_no"), F.lit(len(pattern))).alias("match_text"), "line")


def with_context(files: DataFrame, found: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """``found`` with arrays of the lines before and after. Only files with a match are cut into lines again."""
    wide = lines(files.join(found.select("path").distinct(), "path", "left_semi"))
    in_file = Window.partitionBy("path").orderBy("line_no")
    around = wide.select(
        "path",
        "line_no",
        F.collect_list("line").over(in_file.rowsBetween(-before, -1)).alias("context_before"),
        F.collect_list("line").over(in_file.rowsBetween(1, after)).alias("context_after"),
    )
    return found.join(around, ["path", "line_no"])


def page(found: DataFrame, offset: int = 0, max_results: int = 100, order: tuple = ("path", "line_no")) -> DataFrame:
    return found.orderBy(*order).offset(offset).limit(max_results)


def totals(found: DataFrame, offset: int = 0, max_results: int = 100) -> DataFrame:
    """total_matches before paging, files_with_matches, and whether more follow the page."""
    return found.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.countDistinct("path").alias("files_with_matches"),
        (F.count(F.lit(1)) > offset + max_results).alias("has_more"),
    )


def declarations(files: DataFrame, name: str) -> DataFrame:
    """Lines that declare ``name``: type, method, property or field, the first form that fits."""
    n = re.escape(name)
    forms = {
        "type": rf"\b(class|interface|struct|enum|record)\s+{n}\b",
        "method": rf"\b\w+\s+{n}\s*\(",
        "property": rf"\b\w+\s+{n}\s*\{{",
        "field": rf"\b\w+\s+{n}\s*[;=]",
    }
    form = reduce(lambda c, kv: c.when(F.col("line").rlike(kv[1]), kv[0]), forms.items(), F.when(F.lit(False), ""))
    return lines(files).withColumn("form", form).filter("form is not null")
