"""Reports: files of several formats, histograms, contexts, and text cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write ``rows`` as JSON lines, CSV with a header, or a table of Markdown or HTML lines; one file per task."""
    if form in ("json", "csv"):
        writer = rows.write.option("header", True) if form == "csv" else rows.write
        writer.format(form).save(path)
        return
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
    if form == "markdown":
        safe = [F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in cells]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))
    elif form == "html":
        safe = [F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")) for c in cells]
        line = F.concat(F.lit("<tr>"), *(x for c in safe for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>"))
    else:
        raise ValueError(f"no report of the form {form}")
    rows.select(line.alias("value")).write.text(path)


def extension_histogram(paths: DataFrame, column: str = "path", k: int = 15) -> DataFrame:
    """(extension, n): the most frequent file extensions, lower-cased, empty where there is none."""
    found = F.lower(F.regexp_extract(column, r"(\.[^./?#]*)(?:[?#].*)?$", 1)).alias("extension")
    return paths.groupBy(found).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension").limit(k)


def top_contexts(contexts: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(context, n): the most frequent contexts."""
    counted = contexts.groupBy(F.col(column).alias("context")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "context").limit(k)


def cycle_steps(path: Column) -> Column:
    """(start, end) of every step of a cycle given as the array of its nodes, back to the first."""
    following = F.concat(F.slice(path, 2, F.size(path)), F.slice(path, 1, 1))
    return F.transform(F.arrays_zip(path.alias("start"), following.alias("end")), lambda x: F.struct(x["start"], x["end"]))


def _tokens(text: Column) -> Column:
    """Tokens of four characters, rounded up."""
    return F.ceil(F.length(text) * 0.25)


def truncate_object(fields: Column, budget: int) -> Column:
    """The entries of a map of strings that fit into ``budget`` tokens, values of few tokens first, then by key.

    The first entry always stays; the first one that does not fit ends the object, and a last entry then says how many there were.
    """
    entry = "struct<n:bigint,key:string,value:string>"
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(_tokens(e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    start = F.struct(F.lit(2).cast("long").alias("used"), F.array().cast(f"array<{entry}>").alias("kept"), F.lit(True).alias("more"))

    def add(state: Column, e: Column) -> Column:
        used = state["used"] + _tokens(e["key"]) + e["n"] + 3
        fits = state["more"] & ((used <= budget) | (F.size(state["kept"]) == 0))
        return F.struct(used.alias("used"), F.when(fits, F.concat(state["kept"], F.array(e))).otherwise(state["kept"]).alias("kept"), fits.alias("more"))

    kept = F.aggregate(entries, start, add)["kept"]
    made = F.map_from_arrays(F.transform(kept, lambda e: e["key"]), F.transform(kept, lambda e: e["value"]))
    note = F.format_string("Original had %d properties", F.size(fields))
    return F.when(F.size(kept) < F.size(fields), F.map_concat(made, F.create_map(F.lit("__truncated__"), note))).otherwise(made)


def truncate_array(items: Column, budget: int) -> Column:
    """The longest beginning of an array of strings that fits into ``budget`` tokens, one item at least, and how many are gone."""
    sums = F.aggregate(
        items, F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(2)) + _tokens(x) + 1))
    )
    n = F.greatest(F.size(F.filter(sums, lambda used: used <= budget)), F.least(F.size(items), F.lit(1)))
    note = F.array(F.format_string("... [%d items truncated]", F.size(items) - n))
    return F.concat(F.slice(items, 1, n), F.when(F.size(items) > n, note).otherwise(F.array().cast("array<string>")))
