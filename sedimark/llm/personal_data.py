"""Personal data in texts, by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the matches of four base patterns (e-mail addresses, IP addresses, card numbers of 12 digits or more, telephone numbers) and of wider forms of
each kind: masked addresses such as ``name (at) host (dot) org``, IPv6 and defanged IP addresses, cards in groups
between dots, slashes or low lines, national telephone numbers and those with 00 before the country. Six labelers vote for, against or not
at all on each: three regex labelers (the base pattern with its check, the usual form, arithmetic checks), a gazetteer (top-level domains, reserved
networks, card issuers, country codes), the words before, and the signs around. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability for each kind without any label, and a logistic span classifier is trained on its posteriors, on
the votes and on what the span looks like. A wider form that the classifier accepts, that fails no check and that touches no base
span is added; spans of the base patterns that pass their checks always stay, those that fail are evidence only.

All of it is DataFrame functions. One scan of the texts finds the matches and writes them, with their surroundings, to the shared folder; what
follows reads that table. Vote patterns are at most a few thousand, whatever the input; the models are fitted on their counts, in one job.

The base patterns are written with look-behinds and possessive repeats, so that long runs of signs take linear time; they match
what ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, ``[0-9]([ -]?[0-9])+`` and
``\\+[0-9][ ().0-9-]+[0-9]`` match, leftmost and not overlapping.

Cases: null and empty texts have no spans. Very long texts are read whole. Repeated rows get a row each; a null id is
an id like any other; extra columns are ignored. Spans of different kinds may overlap. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged

KINDS = ("email", "ip", "card", "phone")
#: The posterior from which on a wider form is added.
ACCEPT = 0.9
EM_STEPS = 10
FIT_STEPS = 25

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to give a candidate; cheap to look for, and most texts do not hold it.
_NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "wide": r"[(\[{][aA][tT][)\]}]|\x20[dD][oO][tT]\x20|:[0-9a-fA-F]{1,4}:|[\[(]\.[\])]|[0-9]{3}[)._/-]\x20?[0-9]{3}|00[1-9][\x20-]?[0-9]",
}

_AT, _DOT = r"\x20?[(\[{]at[)\]}]\x20?", r"(?:\x20?[(\[{]dot[)\]}]\x20?|\.)"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++|\x20at\x20[a-z0-9-]++(?:\x20dot\x20[a-z0-9-]++)++)",
    "ip": r"(?<![0-9a-f:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])|[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9]))",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9](?:[\x20-]?[0-9]){8,13}(?![0-9])",
}

# Names that the gazetteers and the context labeler know.
DOMAINS = "com org net edu gov int info io co uk de fr es it nl eu us ca au jp cn in br ch at".split()
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 65 81 82 86 90 91".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(0|127|255)\b"
WORDS_BEFORE = {
    "email": "email e-mail mail contact courriel correo write",
    "ip": "ip address host server client adresse from",
    "card": "card visa mastercard credit debit carte karte tarjeta payment",
    "phone": "phone tel telephone call mobile fax cell telefon teléfono",
}
OTHER_WORDS = "version order isbn invoice item serial build ticket part page"

LABELERS = ("pattern", "form", "check", "gazetteer", "context", "around")
_SURFACE = ("long", "many_digits", "spaced", "dashed", "bracketed", "one")
_N_VOTES = 3 * len(LABELERS)
#: The feature that every span has.
_ONE = _N_VOTES + len(_SURFACE) - 1


def _matches(text: Column, pattern: str, kind: Column) -> Column:
    """Array of structs, one a match: kind, gap (signs since the match before), match, and the text before and after."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def each(s: Column, i: Column) -> Column:
        gap = F.get(s["gaps"], i)
        return F.struct(
            kind.alias("kind_no"), F.length(gap).alias("gap"), F.get(s["found"], i).alias("match"), F.right(gap, F.lit(48)).alias("before"), F.left(F.get(s["gaps"], i + 1), F.lit(2)).alias("after")
        )

    # One step over a list of one element binds what was found, which else were searched for at every use.
    listed = F.transform(F.array(both), lambda s: F.when(F.size(s["found"]) > 0, F.transform(F.sequence(F.lit(0), F.size(s["found"]) - 1), lambda i: each(s, i))))
    return F.get(listed, F.lit(0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (row_id, doc_id) and their candidates (row_id, kind_no, wide, start, end, match, before, after)."""
    text = F.col(text_col)
    found = {f"m{k}": F.when(text.rlike(_NEEDS[kind]), _matches(text, BASE[kind], F.lit(k))) for k, kind in enumerate(KINDS)}
    found |= {"m4": F.when(text.rlike(_NEEDS["wide"]), _matches(text, "(?i)" + "|".join(f"(?:{WIDE[k]})" for k in KINDS), F.lit(len(KINDS))))}
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in found.items())), "personal-data")
    parts = [rows.filter(F.col(n).isNotNull()).select("row_id", F.lit(k).alias("found_by"), F.posexplode(n).alias("place", "m")) for k, n in enumerate(found)]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    # A match ends after all gaps and matches up to its own.
    until = Window.partitionBy("row_id", "found_by").orderBy("place")
    end = F.sum(F.col("m.gap") + F.length("m.match")).over(until)
    match = F.col("m.match")
    kind = F.when(F.col("found_by") < len(KINDS), F.col("found_by"))
    kind = kind.when(match.rlike(r"(?i)[(\[{]at[)\]}]|\x20at\x20"), 0).when(match.rlike(r":|[\[(]\.[\])]"), 1).when(match.rlike("^[0-9]{4}[._/][0-9]{4}[._/]"), 2).otherwise(3)
    spans = each.select("row_id", kind.alias("kind_no"), (F.col("found_by") == len(KINDS)).alias("wide"), (end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"), "m.before", "m.after")
    short = (F.col("kind_no") == KINDS.index("card")) & (F.length(F.regexp_replace("match", "[^0-9]", "")) < 12)
    return rows.select("row_id", "doc_id"), spans.filter(~short)


def _of_kind(options: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, kind in enumerate(KINDS):
        out = F.when(F.col("kind_no") == k, options[kind]).otherwise(out)
    return out


def _vote(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, 1).when(F.lit(True) if bad is None else bad, -1).otherwise(0)


def labelled(spans: DataFrame) -> DataFrame:
    """``spans`` with whether they pass their check, the vote of every labeler (1, 0 or -1), and the array of features."""
    match, digits = F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    plain = F.regexp_replace(match, r"[\[\]()]", "")
    check = {
        "email": F.lit(True),
        "ip": plain.rlike(rf"^{part}(\.{part}){{3}}$") | plain.contains(":"),
        "card": n.between(12, 19) & F.call_function("luhn_check", digits),
        "phone": n.between(9, 15),
    }
    form = {
        "email": _vote(F.lower(match).rlike(r"[a-z][^@]*[^a-z0-9-][a-z]{2,}$")),
        "ip": _vote(plain.rlike(r"^[1-9][0-9]*(\.(0|[1-9][0-9]*)){3}$") | plain.contains(":")),
        "card": _vote(n.isin(15, 16) & (F.regexp_count(match, F.lit("[^0-9]")) <= 4)),
        "phone": _vote(n.between(10, 13) & ~digits.rlike(r"^([0-9])\1*$")),
    }
    codes = "|".join(CALLING_CODES)
    gazetteer = {
        "email": F.when(F.lower(match).rlike(rf"[^a-z0-9-]({'|'.join(DOMAINS)})$"), 1).otherwise(0),
        "ip": F.when(plain.rlike(RESERVED), -1).otherwise(0),
        "card": _vote(digits.rlike(ISSUERS)),
        "phone": F.when(match.rlike(rf"^(\+|00)[ -]?({codes})"), 1).otherwise(0),
    }

    def near(words: str) -> Column:
        return F.lower("before").rlike(rf"(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])(?:[^a-z]+[a-z]+){{0,2}}[^a-z]*$")

    votes = {
        "pattern": F.when(F.col("wide"), 0).when(F.col("ok"), 1).otherwise(-1),
        "form": _of_kind(form),
        "check": _vote(F.col("ok")),
        "gazetteer": _of_kind(gazetteer),
        "context": F.when(_of_kind({k: near(w) for k, w in WORDS_BEFORE.items()}), 1).when(near(OTHER_WORDS), -1).otherwise(0),
        "around": F.when(F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(1),
    }
    surface = [F.length(match) > 18, n > 13, match.contains(" "), match.contains("-"), match.rlike(r"[(\[{]"), F.lit(True)]
    one_hot = [F.col(v) == x for v in LABELERS for x in (1, 0, -1)]
    features = F.array(*(c.cast("double") for c in one_hot + surface))
    checked = spans.withColumn("ok", F.coalesce(_of_kind(check), F.lit(False)))
    return checked.withColumns(votes).withColumn("features", features)


def _dot(features: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(patterns: Column, mass) -> Column:
    """For each feature, the sum of ``mass(pattern)`` over the patterns that have it."""
    weighed = F.transform(patterns, lambda p: F.struct(p["features"].alias("features"), mass(p).alias("mass")))
    none = F.lit([0.0] * (_ONE + 1))
    return F.aggregate(weighed, none, lambda sums, p: F.zip_with(sums, p["features"], lambda s, x: s + x * p["mass"]))


def vote_patterns(spans: DataFrame) -> DataFrame:
    """(kind_no, patterns, total): of each kind how often each combination of features occurs, and how often each feature.

    Combinations are counted before they are listed; there are at most a few thousand of a kind, whatever the input.
    """
    counted = spans.groupBy("kind_no", "features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    listed = counted.groupBy("kind_no").agg(F.array_sort(F.collect_list(F.struct("features", "n"))).alias("patterns"))
    return listed.withColumn("total", _sums(F.col("patterns"), lambda p: p["n"]))


def with_reliabilities(patterns: DataFrame, steps: int = EM_STEPS) -> DataFrame:
    """``patterns`` with ``odds``: log odds to add up for each vote of each labeler, and at the end the prior's; by expectation-maximisation.

    Labelers are taken as independent given the truth. The start takes every labeler for mostly right; counts are smoothed by one.
    """
    total = F.col("total")
    start = [math.log(0.6 / 0.1), 0.0, math.log(0.1 / 0.6)] * len(LABELERS) + [0.0] * len(_SURFACE)

    def maximise(yes: Column) -> Column:
        n_yes, n_no = F.get(yes, F.lit(_ONE)), F.get(total, F.lit(_ONE)) - F.get(yes, F.lit(_ONE))

        def odds(v: Column, j: Column) -> Column:
            voted = F.log((v + 1) / (n_yes + 3) * (n_no + 3) / (F.greatest(F.lit(0.0), F.get(total, j) - v) + 1))
            return F.when(j < _N_VOTES, voted).when(j == _ONE, F.log((n_yes + 1) / (n_no + 1))).otherwise(0.0)

        return F.transform(yes, odds)

    def step(odds: Column, _: Column) -> Column:
        return _bound(_sums(F.col("patterns"), lambda p: p["n"] * _sigmoid(_dot(p["features"], odds))), maximise)

    return patterns.withColumn("odds", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(start), step))


def with_classifier(patterns: DataFrame, steps: int = FIT_STEPS, rate: float = 2.0, decay: float = 1e-3) -> DataFrame:
    """``patterns`` with ``weights`` of the features: logistic regression on the posteriors, by gradient steps over all patterns."""
    taught = F.transform("patterns", lambda p: F.struct(p["features"].alias("features"), p["n"].alias("n"), _sigmoid(_dot(p["features"], F.col("odds"))).alias("truth")))

    def step(weights: Column, _: Column) -> Column:
        slope = _sums(F.col("taught"), lambda p: p["n"] * (_sigmoid(_dot(p["features"], weights)) - p["truth"]))
        return F.zip_with(weights, slope, lambda w, g: w - rate * (g / F.get("total", F.lit(_ONE)) + decay * w))

    start = F.lit([0.0] * (_ONE + 1))
    return patterns.withColumn("taught", taught).withColumn("weights", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, spans), one row per row of ``docs``: structs (start, kind_no, end, kind, base, score) by start, kind and end.

    Places are code points from 0, the end exclusive; ``base`` tells base spans from added ones; the score is the classifier's.
    """
    rows, found = candidates(docs, id_col, text_col)
    spans = staged(labelled(found), "personal-data-votes")
    model = staged(with_classifier(with_reliabilities(vote_patterns(spans))).select("kind_no", "weights"), "personal-data-model")
    # A wider form overlaps a base span where one that starts before ends after its start, or one starts before its end.
    in_order = Window.partitionBy("row_id").orderBy("start")
    base = ~F.col("wide") & F.col("ok")
    before = F.max(F.when(base, F.col("end"))).over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(in_order.rangeBetween(0, Window.unboundedFollowing))
    scored = spans.join(F.broadcast(model), "kind_no")  # a row a kind
    placed = scored.withColumns({"score": _sigmoid(_dot(F.col("features"), F.col("weights"))), "base_end": before, "base_start": after})
    free = F.coalesce(F.col("base_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("base_start") >= F.col("end"), F.lit(True))
    kept = placed.filter(base | F.col("wide") & F.col("ok") & (F.col("score") >= accept) & free)
    kind = F.get(F.lit(list(KINDS)), F.col("kind_no"))
    span = F.struct("start", "kind_no", "end", kind.alias("kind"), base.alias("base"), "score")
    listed = kept.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return rows.join(listed, "row_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def span_summary(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_personal_data``: base spans of each kind, the digest of them, and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(of, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
