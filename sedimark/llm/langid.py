"""Language identification, word first with back-off to character n-grams.

Every word of a text that the model knows counts with its log frequency in each language; a word that it
does not know counts with the mean log frequency of its longest character n-grams that the model knows,
going from ``MAX_GRAM`` characters down to one. The language with the largest sum wins; the score is the
winner's share of the languages' likelihoods per word. Words are runs of letters, lower-cased, read from
the whole text.

The model is fitted on a bounded sample of rows with a language, counted per task and summed by shuffle;
it keeps at most ``max_words`` words and ``max_grams`` n-grams a language, so it is sent to every task.

Model bounds: the sample, ``max_words`` and ``max_grams`` a language, and words and n-grams seen once are left out.

Cases: ``und`` with score 0 for null and empty texts and texts without letters, and for all texts where no row has a
language. Ties go to the language that sorts first. Very long texts are read whole. Repeated rows get a row each; extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.sampling import bounded_sample
from sedimark.storage import staged

MAX_TRAIN_ROWS = 12_000
MAX_WORDS = 20_000
MAX_GRAMS = 12_000
MAX_GRAM = 4
PARTS = 16
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MEMO_LIMIT = 400_000


def words_of(text: str) -> list[str]:
    r"""The runs of letters of a text, lower-cased.

    ``\w`` also takes number signs such as those for a half or for Roman numerals, which are no letters: a match that
    holds one is cut there.
    """
    found = _WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    cut = (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w) for w in found)
    return [part for w in cut for part in w.split(" ") if part]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between boundary marks."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def fit_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = MAX_TRAIN_ROWS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> dict:
    """The model: languages, and log frequencies of words and of n-grams by length."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = bounded_sample(rows, "_id", max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                words[lang].update(words_of(text))
        for lang, counts in words.items():
            pieces: Counter = Counter()
            for w, k in counts.items():
                for n in range(1, MAX_GRAM + 1):
                    for g in grams(w, n):
                        pieces[n, g] += k
            table = [(0, w, k) for w, k in counts.items()] + [(n, g, k) for (n, g), k in pieces.items()]
            kind, text, n = zip(*table) if table else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(table), pa.string()), pa.array(kind, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int64())],
                ["lang", "kind", "gram", "n"],
            )

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, kind int, gram string, n long")
    summed = counted.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    summed = staged(summed, "language-counts")
    total = summed.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # The most frequent of each language and kind, in two steps, so that no task ranks all of one language.
    bound = F.when(F.col("kind") == 0, max_words).otherwise(max_grams)
    kept = summed.filter("n > 1").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    for by in (["lang", "kind", "part"], ["lang", "kind"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
        kept = kept.withColumn("rank", rank).filter(F.col("rank") <= bound)
    rows = kept.join(F.broadcast(total), ["lang", "kind"]).select("lang", "kind", "gram", "n", "total").collect()  # bounded by max_words and max_grams a language
    langs = sorted({r["lang"] for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    floors, cells = {}, [defaultdict(dict) for _ in range(MAX_GRAM + 1)]
    for r in rows:
        floors[r["kind"], r["lang"]] = math.log(0.5 / (r["total"] + 1))
        cells[r["kind"]][r["gram"]][place[r["lang"]]] = math.log(r["n"] / (r["total"] + 1))
    tables = []
    for kind, table in enumerate(cells):
        names = sorted(table)
        m = np.array([[floors.get((kind, lang), -20.0) for lang in langs]] * max(1, len(names)), np.float32)
        for k, name in enumerate(names):
            for at, value in table[name].items():
                m[k, at] = value
        tables.append(({name: k for k, name in enumerate(names)}, m))
    return {"langs": langs, "tables": tables}


class LanguageScorer:
    """Scores texts with a fitted model; remembers what words resolve to."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        starts = np.cumsum([0] + [len(m) for _, m in self.tables])
        self.matrix = np.concatenate([m for _, m in self.tables]) if self.langs else None
        self.words = self.tables[0][0]
        self.grams = [{g: int(starts[n] + k) for g, k in self.tables[n][0].items()} for n in range(1, MAX_GRAM + 1)]
        self.memo: dict[str, list[int]] = {}

    def resolve(self, word: str) -> list[int]:
        """Rows of the matrix whose mean stands for an unknown word."""
        marked = f"<{word}>"
        found: list[int] = []
        for n in range(MAX_GRAM, 0, -1):
            get = self.grams[n - 1].get
            found = [k for k in (get(marked[i : i + n]) for i in range(len(marked) - n + 1)) if k is not None]
            if found:
                break
        if len(self.memo) >= _MEMO_LIMIT:
            self.memo.clear()
        self.memo[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        rows, weights, total = [], [], 0
        words, memo = self.words, self.memo
        for word, k in Counter(found).items():
            at = words.get(word)
            if at is not None:
                rows.append(at)
                weights.append(k)
                total += k
                continue
            ids = memo.get(word)
            if ids is None:
                ids = self.resolve(word)
            if ids:
                rows += ids
                weights += [k / len(ids)] * len(ids)
                total += k
        if not rows:
            return self.langs[0], 1.0 / len(self.langs)
        sums = np.asarray(weights) @ self.matrix[rows].astype(np.float64)
        best = int(np.argmax(sums))
        return self.langs[best], float(1.0 / np.exp((sums - sums[best]) / total).sum())


def detect_language(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = LanguageScorer(sent.value)
        for b in batches:
            out = [scorer(t.as_py()) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(detect, f"doc_id {kind}, lang_pred string, score double")
