"""The scores of the classifiers against plain re-computations, and the operators' harder cases."""

import math
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.llm import decontam, exact_dedup, langid, mixing, quality, registry, suffix_dedup, toxicity
from tests.conftest import SMALL
from tests.llm.test_llm import AWKWARD, clashing, docs

MASK = (1 << 64) - 1


def tables(spark):
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return d, labels, {r["doc_id"]: r["text"] for r in d.collect()}


def test_quality_scores_against_brute_force(spark):
    d, labels, texts = tables(spark)
    weights, bias = registry.quality_model(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, (weights, bias)).collect()}
    for doc, text in texts.items():
        ids = []
        for t in re.findall(r"\w+|[^\w\s]+", text or ""):
            word = t[0].isalnum() or t[0] == "_"
            ids.append(zlib.crc32(("C" if len(t) > 1 and t.isupper() else "w").encode() + t.lower().encode()) & ~1 | word)
        seen = [1 << 32 if x & 1 and x in ids[max(0, k - 2) : k] else x for k, x in enumerate(ids)]
        cells = [((x + 1) * 0xD6E8FEB86659FD93 & MASK) >> 46 for x in seen]
        cells += [(((x * 0x9E3779B97F4A7C15 & MASK) ^ (y * 0xC2B2AE3D27D4EB4F & MASK)) * 0xD6E8FEB86659FD93 & MASK) >> 46 for x, y in zip(seen, seen[1:])]
        dot = quality.SCALE * sum(float(weights[c]) for c in cells) / len(cells) if cells else 0.0
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, dot + bias)))), abs=1e-6)


def test_toxicity_scores_against_brute_force(spark):
    d, labels, texts = tables(spark)
    lexicon, exceptions = toxicity.fit_lexicon(d, labels)
    lexicon |= {"th*": 0.25, "the": 0.5, "in of": 1.5}
    exceptions = [*exceptions, "than", "the heon", "of the"]
    got = {r["doc_id"]: (r["score"], r["n_matches"]) for r in toxicity.toxicity_scores(d, lexicon, exceptions).collect()}
    for doc, text in texts.items():
        t = toxicity.fold(text or "")
        found, spared = {}, []
        for start in (k for k in range(len(t)) if not k or not t[k - 1].isalpha()):
            whole = lambda n: start + n == len(t) or not t[start + n].isalpha()
            spared += [(start, start + len(p)) for p in exceptions if t.startswith(p, start) and whole(len(p))]
            hits = [(len(e.rstrip("*")), w) for e, w in lexicon.items() if t.startswith(e.rstrip("*"), start) and (e.endswith("*") or whole(len(e)))]
            if hits:
                found[start] = max(hits)
        counted = [w for s, (n, w) in found.items() if not any(a <= s and s + n <= b for a, b in spared)]
        raw = sum(counted) / math.log2(2 + len(t.split()))
        score = 1 / (1 + math.exp(-max(-35.0, min(35.0, toxicity.SLOPE * (raw - toxicity.CENTRE)))))
        assert got[doc][1] == len(counted) and got[doc][0] == pytest.approx(score, abs=1e-9)


def test_language_scores_against_brute_force(spark):
    d, _, texts = tables(spark)
    model = langid.fit_language(d, max_words=60, max_grams=80)
    langs, named = model["langs"], [{n: m[k] for n, k in names.items()} for names, m in model["tables"]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.detect_language(d, model).collect()}
    for doc, text in texts.items():
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        sums, total = np.zeros(len(langs)), 0
        for w in words:
            rows = [named[0][w]] if w in named[0] else []
            for n in range(langid.MAX_GRAM, 0, -1) if not rows else ():
                rows = [named[n][g] for g in langid.grams(w, n) if g in named[n]]
                if rows:
                    break
            if rows:
                sums, total = sums + np.mean(np.array(rows, np.float64), axis=0), total + 1
        if not words:
            assert got[doc] == ("und", 0.0)
        elif total:
            best = int(np.argmax(sums))
            assert got[doc][0] == langs[best]
            assert got[doc][1] == pytest.approx(1 / np.exp((sums - sums[best]) / total).sum(), abs=1e-6)


def test_numbers_are_no_letters(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(["½ ²", "Ⅷ ①", "12", "½ day"])]
    model = langid.fit_language(docs(spark, [(9, "the day the day", "en", "s", 0)]))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_language(docs(spark, rows), model).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "en"}


def test_toxicity_counts_words_between_any_white_space():
    score = toxicity.ToxicityScorer({"idiot": 5.0})
    assert score("an idiot and more") == score("an\tidiot\x0band\n\nmore")


def test_exception_phrases_have_words_around_a_match(spark):
    names = [a + b for a in "abcdefg" for b in "hijklmn"]
    rows = [(k, f"{names[k]} idiot {names[-k - 1]}", "en", "s", 0) for k in range(6)]
    rows += [(10 + k, f"the idiot board called {names[k]}", "en", "s", 0) for k in range(5)]
    rows += [(20 + k, f"some plain words {names[k]}", "en", "s", 0) for k in range(30)]
    labels = spark.createDataFrame([(k, 0, int(k < 10)) for k, *_ in rows], "doc_id long, quality int, toxic int")
    lexicon, exceptions = toxicity.fit_lexicon(docs(spark, rows), labels, min_weight=0.1)
    assert "idiot" in lexicon or any("idiot".startswith(e.rstrip("*")) for e in lexicon if e.endswith("*"))
    assert "idiot board" in exceptions and "the idiot" in exceptions and not any(e.startswith("ah ") for e in exceptions)
    score = toxicity.ToxicityScorer(lexicon, exceptions)
    assert score("that idiot board met")[1] == 0 < score("that idiot spoke")[1]


def test_repetitive_texts_are_decontaminated_in_time():
    index = decontam.SeedIndex([(1, "so " * 100), (2, "a b c d e f g h i j k l m n")])
    memo, began = decontam._Hashes(), time.perf_counter()
    found = index.search("so " * 20_000 + "a b c d e f g h i j k l m n", memo)
    assert {(f[0], f[2], f[3]) for f in found} == {(1, 100, 0), (2, 14, 20_000)}
    assert time.perf_counter() - began < 20


def test_longest_stretch_against_all_stretches():
    rng = np.random.default_rng(4)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 40)) < 0.8
        at = np.flatnonzero(equal)
        sizes = [j - i + 1 for i in at for j in at if j >= i and j - i + 1 >= 13 and (~equal[i : j + 1]).sum() <= 0.2 * (j - i + 1) + 1e-9]
        got = decontam.best_stretch(equal, 13, 0.2)
        assert (got is None) == (not sizes) and (got is None or got[1] - got[0] == max(sizes))


@pytest.mark.parametrize("n", range(13, 25))
def test_masks_hit_every_stretch_with_a_fifth_of_substitutions(n):
    looks = [sum(1 << at + k for k, bit in enumerate(m) if bit == "1") for m in decontam.MASKS for at in range(n - len(m) + 1)]
    for changed in combinations(range(1, n - 1), n // 5):
        bits = sum(1 << p for p in changed)
        assert any(not look & bits for look in looks)


def test_mixed_decides_by_row(spark):
    rows = [*AWKWARD, *((50, f"{w} " * 5, "en", "u", 0) for w in "abcdefgh"), *[(60, "same words", "en", "u", 0)] * 5]
    d = clashing(docs(spark, rows)).withColumns({c: F.lit("x") for c in ("copy_no", "_words", "_size", "_copies", "_id", "row", "k1", "key", "rows", "copies")})
    out = mixing.mixed(d)
    assert sorted(out.columns) == sorted(d.columns)
    taken = {(r["source"], r["size"]): r["n"] for r in mixing.mix(d).groupBy("source", "size").agg(F.sum("copies").alias("n")).collect()}
    got = {(r["source"], r["size"]): r["n"] for r in out.withColumn("size", mixing.word_count(F.col("text"))).groupBy("source", "size").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in taken.items() if n}
    assert mixing.mixed(out).count() > 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_suffix_dedup_of_a_text_over_16_mib(spark):
    letters = np.random.default_rng(3).integers(97, 123, (1 << 24) + 20_000, np.uint8).tobytes().decode()
    at = [suffix_dedup.TEXT_CHUNK - 300, (1 << 24) + 5_000]  # over the end of a segment, and beyond 16 MiB
    short = "".join("-" * 50 + letters[k : k + 600] for k in at)
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, letters), (2, short)], "doc_id long, text string"), with_text=True).collect()
    spans = {r["doc_id"]: [(x["s"], x["e"]) for x in r["spans"] or ()] for r in rows}
    assert spans == {1: [(k, k + 600) for k in at], 2: [(50, 650), (700, 1300)]}


def test_anchors_fail_loudly_over_their_positions():
    with pytest.raises(ValueError):
        suffix_dedup.anchors([b"a" * (1 << 24)], 400)


def test_first_copies_keep_unique_texts_of_null_and_repeated_ids(spark):
    rows = [(1, "a"), (None, "a"), (None, "b"), (2, "a"), (2, "c"), (3, "d")]
    kept = exact_dedup.first_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == [("a", 1), ("b", None), ("c", 2), ("d", 3)]


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Texts 1, 2, 2 and that without an id are equal, 3 and 4 are empty; the item's two words stand in the first four.
    kept = {"exact dedup": [1, 3, 5, 7, 8], "n-gram Jaccard join": [1, 3, 4, 5, 7, 8], "benchmark decontamination": [3, 4, 5, 7, 8]}
    for name, stage in corpus_pipeline.STAGES:
        for d in (clashing(docs(spark)), docs(spark, [])):
            out = stage(spark, d, str(tmp_path))
            rows = [tuple(r)[: len(d.columns)] for r in out.collect()]
            assert set(d.columns) <= set(out.columns) and set(rows) <= {tuple(r) for r in d.collect()}, name
            assert d.isEmpty() == (not rows) or name == "quality classifier", name
            if rows and name in kept:
                assert sorted(r["doc_id"] for r in out.collect()) == kept[name], name


def test_phrases_reach_over_words_of_any_length():
    score = toxicity.ToxicityScorer({"idiot": 5.0})
    long = "w" * 500
    assert score.phrases(f"a {long} idiot here") == {"idiot", f"{long} idiot", "idiot here"}
    assert score.phrases("idiot") == {"idiot"} and score.phrases("1 idiot") == {"idiot"} and score.phrases("x, idiot") == {"idiot"}
