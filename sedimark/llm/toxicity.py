"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, and reads digits and signs
inside words as the letters they stand for. A lexicon entry is a whole word or, with a trailing ``*``, a
word's beginning; an exception phrase is a text in which entries do not count. The raw score is the sum of
the weights of the matches over log2(2 + words), passed through a logistic whose centre and slope are
parameters.

``fit_lexicon`` learns entries from a bounded sample of labelled rows: words and beginnings of words whose
log odds of occurring in a toxic row reach ``min_weight``. Entries are taken by the number of toxic rows they are
in; what an entry covers, or would cover it, is not taken again. Near copies in the sample count once. Exception phrases
are what entries match in at least ``min_rows`` clean rows and in no toxic one: a word that begins like an entry, or a match
with the word before or after it. Model bounds: the sample, ``max_entries`` entries and as many exceptions.

Cases: null and empty texts have no match and get the score of none. Without labelled rows the lexicon is
empty. Repeated rows get a row each; extra columns are ignored. Texts are matched whole, very long ones too. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.sampling import labelled, without_copies
from sedimark.storage import staged

MAX_TRAIN_ROWS = 16_000
MIN_WEIGHT = 4.0
MIN_ROWS = 4
MIN_PREFIX, MAX_PREFIX = 3, 8
#: Terms that a task counts before it hands on its counts; they are summed afterwards, so only its memory depends on it.
FLUSH = 100_000
MAX_ENTRIES = 20_000
CENTRE, SLOPE = 0.16, 14.0

# Letters of other scripts that look like Latin ones, and what digits and signs stand for in words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ս": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + r"\uff21-\uff3a\uff41-\uff5a\u200b-\u200d\u00ad]")
_WIDE = {chr(0xFF21 + k): chr(97 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_FOLD = str.maketrans(HOMOGLYPHS | _WIDE | dict.fromkeys("\u200b\u200c\u200d\u00ad"))
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?!\w)|(?<!\w)[0134578@$]+(?=[^\W\d_])")
_SUB = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER, _NEXT_WORD = re.compile(r"[^\W\d_]"), re.compile(r" [^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs inside words as letters."""
    text = text.lower()
    if _LOOKALIKE.search(text):
        text = text.translate(_FOLD)
    return _SIGN.sub(lambda m: m.group().translate(_SUB), text)


class ToxicityScorer:
    """Matches a lexicon; ``lexicon`` maps entries to weights, ``exceptions`` are phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str] = (), centre: float = CENTRE, slope: float = SLOPE):
        self.centre, self.slope = centre, slope
        self.automaton = ahocorasick.Automaton()
        values: dict[str, list] = {}
        for entry, weight in lexicon.items():
            values.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), float(weight)))
        for phrase in exceptions:
            values.setdefault(phrase, []).append(None)
        for text, kinds in values.items():
            if text:
                self.automaton.add_word(text, (len(text), tuple(kinds)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that count in a folded text; of several at one start the longest."""
        if not len(self.automaton):
            return []
        found, excepted = {}, []
        for last, (n, kinds) in self.automaton.iter(folded):
            start, end = last - n + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end == len(folded) or not folded[end].isalpha()
            for kind in kinds:
                if kind is None:
                    if whole:
                        excepted.append((start, end))
                elif kind[0] or whole:
                    found[start] = max(found.get(start, (0, 0.0)), (end, kind[1]))
        excepted.sort()
        starts, ends = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        # A match lies in an exception if the furthest end of those that begin no later is not before its own.
        covered = lambda s, e: (k := bisect_right(starts, s)) > 0 and ends[k - 1] >= e
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not covered(s, e)]

    def phrases(self, folded: str) -> set[str]:
        """The word of each match, alone where it is longer than the entry, and with its neighbours on the same line."""
        out = set()
        for start, end, _ in self.matches(folded):
            while end < len(folded) and folded[end].isalpha():
                end += 1
            out.add(folded[start:end])
            if after := _NEXT_WORD.match(folded, end):
                out.add(folded[start : after.end()])
            if folded[start - 1 : start] == " ":
                before = start - 1
                while before and _LETTER.match(folded, before - 1):
                    before -= 1
                if before < start - 1:
                    out.add(folded[before:end])
        return out

    def __call__(self, text: str | None) -> tuple[float, int]:
        """(score, matches)."""
        folded = fold(text or "")
        found = self.matches(folded)
        words = len(folded.split())
        raw = sum(w for _, _, w in found) / math.log2(2 + words)
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, self.slope * (raw - self.centre))))), len(found)


def _counts(seen: dict[int, Counter], name: str, more: dict[str, tuple[int, int]] | None = None) -> pa.RecordBatch:
    """Rows (name, toxic, clean) of what a task has counted so far."""
    table = {t: (seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys()} | (more or {})
    columns = [pa.array(table, pa.string()), *(pa.array((n[k] for n in table.values()), pa.int64()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, [name, "toxic", "clean"])


def fit_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
    min_weight: float = MIN_WEIGHT,
    min_rows: int = MIN_ROWS,
    max_entries: int = MAX_ENTRIES,
) -> tuple[dict[str, float], list[str]]:
    """(lexicon, exceptions) from at most about ``max_rows`` labelled rows."""
    sample = staged(without_copies(staged(labelled(docs, labels, label, id_col, text_col, max_rows), "toxic-sample")), "toxic-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = {0: Counter(), 1: Counter()}, Counter()

        def out() -> pa.RecordBatch:
            return _counts(seen, "term", {"": (rows[1], rows[0])})

        for b in batches:
            for text, mark in zip(b["text"], b["label"].to_pylist()):
                words = set(_WORD.findall(fold(text.as_py())))
                starts = {w[:n] + "*" for w in words for n in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1)}
                seen[int(mark)].update(words | starts)
                rows[int(mark)] += 1
                if len(seen[0]) + len(seen[1]) >= FLUSH:
                    yield out()
                    seen, rows = {0: Counter(), 1: Counter()}, Counter()
        yield out()

    counted = sample.mapInArrow(count, "term string, toxic long, clean long")
    terms = staged(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-terms")
    total = terms.filter("term = ''").collect()
    if not total:
        return {}, []
    toxic, clean = total[0]["toxic"], total[0]["clean"]
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    telling = terms.filter((F.col("term") != "") & (F.col("toxic") >= min_rows)).withColumn("weight", weight)
    telling = telling.filter(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "term").limit(max_entries)
    found = telling.collect()
    rows, seen = {r["term"]: r["weight"] for r in found}, {r["term"]: r["toxic"] for r in found}
    lexicon: dict[str, float] = {}
    for term in sorted(rows, key=lambda t: (-seen[t], -rows[t], -len(t), t)):
        body = term.rstrip("*")
        covered = any(body[:n] + "*" in lexicon for n in range(MIN_PREFIX, len(body) + 1))
        covers = term.endswith("*") and any(t.startswith(body) for t in lexicon)
        if not covered and not covers and body not in lexicon:
            lexicon[term] = rows[term]
    scorer = ToxicityScorer(lexicon)

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, mark in zip(b["text"], b["label"].to_pylist()):
                seen[int(mark)].update(scorer.phrases(fold(text.as_py())))
                if len(seen[0]) + len(seen[1]) >= FLUSH:
                    yield _counts(seen, "phrase")
                    seen = {0: Counter(), 1: Counter()}
        yield _counts(seen, "phrase")

    phrases = sample.mapInArrow(context, "phrase string, toxic long, clean long")
    phrases = phrases.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = phrases.filter((F.col("toxic") == 0) & (F.col("clean") >= min_rows)).orderBy(F.desc("clean"), "phrase").limit(max_entries)
    return lexicon, sorted(r["phrase"] for r in spared.collect())


def toxicity_scores(
    docs: DataFrame,
    lexicon: dict[str, float],
    exceptions: list[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    centre: float = CENTRE,
    slope: float = SLOPE,
) -> DataFrame:
    """(doc_id, score, n_matches), one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, list(exceptions), centre, slope))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicityScorer(*sent.value)
        for b in batches:
            out = [scorer(t.as_py()) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64())],
                ["doc_id", "score", "n_matches"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, n_matches long")
