"""Bulk edits of files (path, text): replace, conditional and multi-step edits, previews, statistics, backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged


def bulk_replace(files: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """files with new_text, n_matches and changed; ``^`` and ``$`` match at line ends."""
    p = f"(?m){pattern}"
    n = F.regexp_count("text", F.lit(p))
    new = F.regexp_replace("text", F.lit(p), F.lit(replacement))
    return files.withColumns({"n_matches": n, "new_text": F.when(n > 0, new).otherwise(F.col("text"))}).withColumn("changed", F.col("n_matches") > 0)


def condition(kind: str, negate: bool = False, **options) -> Column:
    """One of contains, matches, size, extension, directory, modified_after; an unknown kind never holds."""
    made = {
        "contains": lambda o: F.col("text").contains(o["value"]),
        "matches": lambda o: F.col("text").rlike(f"(?m){o['value']}"),
        "size": lambda o: F.octet_length("text").between(o.get("low", 0), o.get("high", 1 << 62)),
        "extension": lambda o: F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([e.lower() for e in o["values"]]),
        "directory": lambda o: F.col("path").contains(o["value"]),
        "modified_after": lambda o: F.col("modified") > F.lit(o["value"]).cast("timestamp"),
    }
    held = made[kind](options) if kind in made else F.lit(False)
    return ~held if negate else held


def conditional_edit(files: DataFrame, when: Column, edit: Column) -> DataFrame:
    """``edit`` where the condition holds, the text as it is elsewhere."""
    held = F.coalesce(when, F.lit(False))
    return files.withColumns({"edited": held, "new_text": F.when(held, edit).otherwise(F.col("text"))})


def multi_edit(files: DataFrame, steps: list[tuple[int, str, str]]) -> DataFrame:
    """Replacements (priority, pattern, replacement) applied one after the other, by ascending priority."""
    text = reduce(lambda t, s: F.regexp_replace(t, F.lit(f"(?m){s[1]}"), F.lit(s[2])), sorted(steps), F.col("text"))
    return files.withColumn("new_text", text).withColumn("changed", F.col("new_text") != F.col("text"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files with the edits (path, start, end, new) put in, from the last to the first; offsets in characters from 0.

    An edit beyond the end of its text appends. Two edits of a file that overlap raise an error when the result is computed: resolve
    conflicts first. Edits that only touch are put in one after the other.
    """
    listed = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new")), asc=False).alias("edits"))
    folded = F.aggregate(
        "edits", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new"], F.substring(t, F.least(e["end"], F.length("text")) + 1, F.length(t)))
    )
    # From the last to the first: an edit that ends after the next one starts overlaps it.
    pairs = F.zip_with("edits", F.slice("edits", 2, 1 << 30), lambda later, e: F.coalesce(e["end"] > later["start"], F.lit(False)))
    checked = F.when(F.exists(pairs, lambda bad: bad), F.raise_error(F.concat(F.lit("overlapping edits of "), "path"))).otherwise(folded)
    return files.join(listed, "path", "left").withColumn("new_text", F.coalesce(F.when(F.col("edits").isNotNull(), checked), F.col("text"))).drop("edits")


def rebased(edits: DataFrame) -> DataFrame:
    """``edits`` (path, start, end, new) that do not overlap, with ``new_start`` and ``new_end``: where their new text stands once all are in.

    What an edit grows its file by moves all later ones; a running sum of the earlier growth gives the shift.
    """
    before = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.length("new") - (F.col("end") - F.col("start"))
    start = F.col("start") + F.coalesce(F.sum(grown).over(before), F.lit(0))
    return edits.withColumn("new_start", start).withColumn("new_end", F.col("new_start") + F.length("new"))


def apply_fixes(files: DataFrame, fixes: DataFrame, prefer: str = "older") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of fixes (id, path, start, end, new, made_at) over files (path, text): the files after it, what was done, and the way back.

    Conflicts are resolved first, as in ``resolve_conflicts``. The second table has each fix with ``applied``, and for those applied the place of the new text
    (new_start, new_end), so a later round of fixes can be laid over it; the third has inverse edits (id, path, start, end, new) on
    the new texts, which ``apply_edits`` takes to roll back all of the run or single fixes.
    """
    kept = staged(rebased(resolve_conflicts(fixes, prefer)), "fixes")
    after = apply_edits(files, kept.select("path", "start", "end", "new"))
    done = fixes.join(kept.select("id", "new_start", "new_end"), "id", "left").withColumn("applied", F.col("new_start").isNotNull())
    old = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    back = kept.join(files.select("path", "text"), "path").select("id", "path", F.col("new_start").alias("start"), F.col("new_end").alias("end"), old.alias("new"))
    return after, done, back


def rebase_over(edits: DataFrame, done: DataFrame) -> DataFrame:
    """``edits`` (id, path, start, end, new) that were made for the texts before a run, moved to the texts after it.

    ``done`` has the fixes of the run with their places (path, start, end, new_start, new_end). Growth is summed over both in one order; an edit that
    overlaps an applied fix has lost its place and is left out.
    """
    applied = done.filter("applied").select("path", "start", "end", (F.col("new_end") - F.col("new_start") - F.col("end") + F.col("start")).alias("growth"), F.lit(0).alias("side"))
    asked = edits.withColumns({"growth": F.lit(0).cast("long"), "side": F.lit(1)})
    both = asked.unionByName(applied.withColumn("growth", F.col("growth").cast("long")), allowMissingColumns=True)
    in_order = Window.partitionBy("path").orderBy("start", "side")
    shift = F.sum("growth").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    reach = F.max(F.when(F.col("side") == 0, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("side") == 0, F.col("start"))).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    placed = both.withColumns({"shift": shift, "reach": reach, "ahead": ahead}).filter("side = 1")
    free = placed.filter("coalesce(reach <= start, true) and coalesce(ahead >= end, true)")
    return free.withColumns({"start": F.col("start") + F.col("shift"), "end": F.col("end") + F.col("shift")}).select(*edits.columns)


def _overlaps(edits: DataFrame, *columns: str) -> DataFrame:
    """Pairs a, b of edits of one file whose ranges overlap and a_id < b_id; touching counts.

    A range lies in one or two bins of the least power of two that is longer; the shorter of a pair looks for the longer one in bins of the
    longer one's size. So neither very long nor very many short ranges fill many bins. A pair counts in the bin where the later one starts.
    """
    size = F.greatest(F.lit(1), F.col("end") - F.col("start") + 1)
    sized = edits.withColumn("level", F.ceil(F.log2(size)).cast("int"))
    levels = sized.agg(F.collect_set("level").alias("levels"))  # a few dozen numbers
    ends = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long") for c in ("start", "end")]
    held = sized.withColumn("bin", F.explode(F.sequence(*ends)))
    asked = sized.withColumnRenamed("level", "own").join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("own"))))
    asked = asked.withColumn("bin", F.explode(F.sequence(*ends)))
    kept = ("id", "start", "end", *columns)
    a = asked.select("path", "bin", "level", "own", F.struct(*kept).alias("x"))
    b = held.select("path", "bin", "level", F.struct(*kept).alias("y"))
    met = a.join(b, ["path", "bin", "level"]).filter("x.start <= y.end and y.start <= x.end and (own < level or x.id < y.id)")
    met = met.filter(F.col("bin") == F.floor(F.greatest("x.start", "y.start") / F.pow(F.lit(2.0), F.col("level"))))
    first = F.col("x.id") < F.col("y.id")
    low, high = (F.when(first, F.col(p)).otherwise(F.col(q)) for p, q in (("x", "y"), ("y", "x")))
    met = met.filter("x.id <> y.id").select("path", low.alias("a"), high.alias("b"))
    return met.select("path", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in kept))


def fix_statistics(edits: DataFrame, kept: DataFrame) -> DataFrame:
    """(path, proposed, kept, dropped): edits of each file before and after conflicts are resolved."""
    marked = edits.select("id", "path").join(kept.select("id", F.lit(1).alias("k")), "id", "left")
    counted = marked.groupBy("path").agg(F.count(F.lit(1)).alias("proposed"), F.count("k").alias("kept"))
    return counted.withColumn("dropped", F.col("proposed") - F.col("kept"))


def conflicts(edits: DataFrame) -> DataFrame:
    """Pairs of edits (id, path, start, end) of one file whose ranges overlap; touching counts."""
    return _overlaps(edits).select("path", "a_id", "b_id")


def conflict_counts(edits: DataFrame) -> DataFrame:
    """(path, pairs): how many pairs ``conflicts`` has for each file. Edits of one range count together, not pair by pair."""
    ranges = edits.groupBy("path", "start", "end").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.struct("start", "end"))
    ranges = staged(ranges, "conflict-ranges")
    across = _overlaps(ranges, "n").select("path", (F.col("a_n") * F.col("b_n")).alias("pairs"))
    within = ranges.filter("start <= end and n > 1 and path is not null").select("path", F.expr("n * (n - 1) div 2").alias("pairs"))
    return across.unionByName(within).groupBy("path").agg(F.sum("pairs").alias("pairs"))


def resolve_conflicts(edits: DataFrame, prefer: str = "older") -> DataFrame:
    """Edits (id, path, start, end, made_at) that stay of those that overlap.

    ``older`` and ``newer`` drop an edit that overlaps one made before or after it; ``none`` drops all that overlap.
    """
    # Edits of one range overlap each other: only the one that may stay meets other ranges.
    order = F.struct("made_at", "id")
    pick = {"older": F.min(order), "newer": F.max(order), "none": F.min(order)}[prefer]
    ranges = edits.groupBy("path", "start", "end").agg(pick.alias("kept"), F.count(F.lit(1)).alias("n"))
    ranges = staged(ranges.select("path", "start", "end", F.col("kept.id").alias("id"), F.col("kept.made_at").alias("made_at"), "n"), "resolve-ranges")
    pairs = _overlaps(ranges, "made_at")
    first = F.struct("a_made_at", "a_id") < F.struct("b_made_at", "b_id")
    lost = {"older": F.array(F.when(first, F.col("b_id")).otherwise(F.col("a_id"))), "newer": F.array(F.when(first, F.col("a_id")).otherwise(F.col("b_id"))), "none": F.array("a_id", "b_id")}
    stay = ranges.filter("n = 1 or start > end") if prefer == "none" else ranges
    stay = stay.join(pairs.select(F.explode(lost[prefer]).alias("id")), "id", "left_anti")
    return edits.join(stay.select("id"), "id", "left_semi")


def preview(files: DataFrame, pattern: str) -> DataFrame:
    """path, match_no, match_text of every match, without changing anything."""
    found = F.regexp_extract_all("text", F.lit(f"(?m)({pattern})"), F.lit(1))
    return files.select("path", F.posexplode(found).alias("match_no", "match_text"))


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, line_no, old, new where the lines of two versions (path, text) differ at one place."""
    cut = [d.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line_no", name)) for d, name in ((before, "old"), (after, "new"))]
    return cut[0].join(cut[1], ["path", "line_no"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def file_statistics(files: DataFrame) -> DataFrame:
    """One row: count, total, truncated mean, smallest and largest size in bytes, and lines."""
    size = F.octet_length("text")
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(size).alias("total_bytes"),
        F.floor(F.avg(size)).alias("mean_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.sum(F.size(F.split("text", "\n", -1))).alias("total_lines"),
    )


def edit_summary(edited: DataFrame) -> DataFrame:
    """One row: files, changed, skipped, matches, and growth in bytes."""
    grown = F.octet_length("new_text") - F.octet_length("text")
    return edited.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("changed").alias("n_changed"),
        F.count_if(~F.col("changed")).alias("n_skipped"),
        F.sum("n_matches").alias("n_matches"),
        F.sum(F.when(F.col("changed"), grown).otherwise(0)).alias("bytes_grown"),
    )


def impact_estimate(files: DataFrame) -> DataFrame:
    """Complexity of a bulk edit: files over 10 plus megabytes, at most 100."""
    stats = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("text")).alias("bytes"))
    return stats.select("n_files", F.round(F.least(F.lit(100.0), F.col("n_files") / 10 + F.col("bytes") / 1048576.0), 4).alias("complexity"))


def verify_backup(files: DataFrame, backup: DataFrame) -> DataFrame:
    """path, intact: whether the backup's text has the digest of the file's."""
    a = files.select("path", F.sha2("text", 256).alias("now"))
    b = backup.select("path", F.sha2("text", 256).alias("then"))
    return b.join(a, "path", "left").select("path", F.col("then").eqNullSafe(F.col("now")).alias("intact"))
