"""The training-data operators against brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.llm import (
    archives, decontam, exact_dedup, jaccard, langid, mixing, quality, registry, sampling, suffix_dedup, token_counts, toxicity,
)
from tests.conftest import SMALL
from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, repeated rows, ties, a null id, a very long text, a null source.
AWKWARD = [
    (1, "a b  c\td", "en", "s", 1), (2, "a b c d", "en", "s", 1), (2, "a b c d", "en", "s", 1), (3, None, None, None, None),
    (4, "", "en", "s", 0), (5, " ", "en", "t", 0), (None, "a b c d", "en", "t", 1), (7, "word " * 30_000, "en", "t", 1), (8, "Ünïcode ß 日本 🙂", "de", None, 1),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with the names that the operators use themselves."""
    extra = "h sha n keep_id part size score component_id u1 u2 g a b block _order label word text_sha256".split()
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(registry.queries()[name](spark, SMALL), connect(SMALL), registry.oracle_sql()[name])


def test_exact_dedup_awkward(spark):
    rows = exact_dedup.exact_dedup(clashing(docs(spark)), capacity=1).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    abcd = by[hashlib.sha256(b"a b c d").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in abcd} == {(1, 4)} and sum(r["kept"] for r in abcd) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(r["doc_id"] for r in empty) == [3, 4] and {r["keep_id"] for r in empty} == {3}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.first_copies(clashing(docs(spark))).columns == clashing(docs(spark)).columns
    assert exact_dedup.first_copies(docs(spark)).count() == 5


def test_directory_doubles_until_buckets_fit(spark):
    buckets, overfull = exact_dedup.split_buckets({k: 1 for k in range(1, 16)} | {0: 100}, 0, 4, 4)
    assert overfull == [0]
    assert sorted([0] + [s for p, d in buckets for s in range(p << 4 - d, (p + 1) << 4 - d)]) == list(range(16))
    close = [(k << 20) + j for k in (5, -5) for j in range(6)] + [1 << 62, -1]
    keys = spark.createDataFrame([(h,) for h in close], "h long")
    for capacity in (1, 100):
        directory = exact_dedup.grow_directory(keys, capacity)
        held = [sum((h & (1 << 64) - 1) >> 64 - d == p for h in close) for p, d in directory]
        assert sum(held) == len(close) and max(held) <= capacity
        index = exact_dedup.build_index(keys, capacity).collect()
        assert len(index) == len(close) and all(
            (r["h"] & (1 << 64) - 1) >> 64 - directory[r["bucket"]][1] == directory[r["bucket"]][0] for r in index
        )


def test_colliding_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    rows = [(k, "ab"[k % 2] * (1 + k % 3), "en", "s", 0) for k in range(30)]
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") if c == "norm" else real(c))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {k: (k % 6, 5) for k in range(30)}


def test_first_copies_decide_by_row(spark):
    rows = [(0, "a", "en", "s", 1), (1, "a", None, None, None), (1, "b", "en", "s", 1), (None, "a", "en", "s", 1), (None, "z", "en", "s", 1)]
    d = clashing(docs(spark, rows))
    kept = exact_dedup.first_copies(d)
    assert kept.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("0", "a"), ("1", "b"), ("None", "z")]
    assert exact_dedup.first_copies(docs(spark, [])).count() == 0


def test_mix_meets_targets(spark):
    rows = mixing.mix(clashing(docs(spark)).drop("size")).collect()
    assert len(rows) == len(AWKWARD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(docs(spark, [])).count() == 0
    rng = random.Random(3)
    many = [(k, "w " * rng.randint(1, 60), "en", f"s{min(k % 10, 3)}", 0) for k in range(3000)]
    first, again = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, many)).collect()) for _ in range(2))
    assert first == again
    for r in mixing.mix(docs(spark, many)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 130
    out = mixing.mixed(docs(spark, many))
    assert out.count() == mixing.mix(docs(spark, many)).agg(F.sum("copies")).collect()[0][0]


# ---------------------------------------------------------------- Jaccard


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(rng, families):
    """Texts with edited copies; the last family is large, its members edited at one to six places each."""
    rows = []
    for k in range(families):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 6, 30, 80]))]
        base = base if k < families - 1 else [f"w{j}" for j in range(90)]
        for _ in range(rng.choice([1, 2, 9]) if k < families - 1 else 40):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) if k < families - 1 else rng.randint(1, 4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(words) + rng.choice(["", " ", " tail"]), "en", "s", 0))
    return rows


@pytest.mark.parametrize("full_run, hot_bits", [(1, 16), (1, 0), (4, 1), (48, 16)])
def test_jaccard_against_brute_force(spark, full_run, hot_bits):
    rows = near_copies(random.Random(full_run + hot_bits), 14)
    found = jaccard.jaccard_components(docs(spark, rows), full_run=full_run, hot_bits=hot_bits).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_jaccard_of_groups_with_one_prefix(spark, monkeypatch):
    """With one class for all shingles and few of them in a prefix, many sets share theirs."""
    monkeypatch.setattr(jaccard, "frequency_classes", lambda counts: np.zeros(len(counts), np.uint8))
    monkeypatch.setattr(jaccard, "shingles", lambda text, memo, words: np.unique(np.array([int(w) for w in (text or "").split()], np.uint64)))
    rng = random.Random(2)
    first = [1, 2, 3, 4]
    rows = [(k, " ".join(map(str, [*first, *rng.sample(range(10 + 10 * (k % 3), 26 + 10 * (k % 3)), 8)])), "en", "s", 0) for k in range(60)]
    rows += [(60 + k, " ".join(map(str, [*first[:2], 5, *rng.sample(range(10, 26), 9)])), "en", "s", 0) for k in range(30)]
    sets = {i: set(t.split()) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in sets:
        for b in sets:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for full_run in (1, 5):
        found = jaccard._components(docs(spark, rows).withColumn("th", F.xxhash64("text")), full_run=full_run).collect()
        assert {r["doc_id"]: r["keeper"]["doc_id"] if r["keeper"] else r["doc_id"] for r in found} == {i: root(i) for i in sets}


def test_jaccard_awkward(spark):
    rows = jaccard.jaccard_components(clashing(docs(spark))).collect()
    assert len(rows) == len(AWKWARD)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7), (8, 1, 8)} == got
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_per_component(docs(spark)).collect()) == ["1", "3", "4", "5", "7", "8"]


def test_one_per_component_decides_by_row(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "en", "s", 0), (5, a + " more", "en", "s", 0), (5, b, "en", "s", 0), (None, b + " more", "en", "t", 0), (None, a + " x", "en", "s", 0)]
    rows += [(None, "one two three", "en", "s", 0), (None, "ONE two three", "en", "s", 0), (5, "c d", None, None, None)]
    d = clashing(docs(spark, rows))
    kept = jaccard.one_per_component(d)
    assert kept.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(kept) == 4 and {(1, a), (5, b), (5, "c d")} < set(kept) and sum(t.lower() == "one two three" for _, t in kept) == 1
    assert jaccard.one_per_component(docs(spark, [])).count() == 0


def test_prefix_entries_survive_packing():
    e = np.empty(5, jaccard._ENTRY)
    e["key"], e["group"], e["size"], e["at"] = [1, 2, (1 << 40) - 1, 4, 5], [7, 7, (1 << 48) - 1, 9, 9], [3, 3, 4, 70_000, 1 << 31], [0, 1, 2, 66_000, 4]
    assert (jaccard.unpack_entries(jaccard.pack_entries(e)) == e).all()


# ---------------------------------------------------------------- repeated byte strings


def brute_suffix(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for k in range(len(x) - length + 1):
            seen[x[k : k + length]] = seen.get(x[k : k + length], 0) + 1
    out = []
    for x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [0, 2, 8192])
def test_suffix_dedup_against_brute_force(spark, hot):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé \n") for _ in range(260))
    texts = [None, "", "x" * 500, "ab" * 150, passage, passage]
    for _ in range(24):
        t = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400)))
        k = rng.randint(0, 100)
        texts.append(t + passage[k : k + rng.randint(20, 160)] + t[:30])
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(clashing(docs(spark, rows)), length=60, hot=hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute_suffix(texts, 60)
    spans = suffix_dedup.suffix_dedup(docs(spark, rows), length=60, with_text=True).filter("doc_id = 4").collect()[0]
    assert [(s["s"], s["e"]) for s in spans["spans"]] == [(0, len(passage.encode()))] and spans["kept"] == b""
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_suffix_dedup_awkward(spark):
    rows = suffix_dedup.suffix_dedup(docs(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["doc_id"]: r["n_removed"] for r in rows}[7] == 150_000


# ---------------------------------------------------------------- token counts


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", "Hello <|endoftext|> world", "<|startoftext|><|endoftext|>x", "Σίσυφος ΣΑΣ", "I'LL don't İstanbul", "日本語", "🙂🙂 naïve", "á", "\x1c a\x85b", "½²", "<|endoftext"]
    counter = token_counts.MergeCounter(token_counts.load_vocabulary(path))
    assert [counter(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    rows = token_counts.token_counts(clashing(docs(spark)), path, limit=100).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["doc_id"]: (r["n_bytes"], r["over_limit"]) for r in rows}[3] == (0, False)
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 7] == [30_000]
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    big = "x" * 1200
    rows = [(1, "http://a/ü b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 10), (9, "u", big), (None, "u", big)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    manifest = archives.write_packages(archives.with_roles(pages), package_bytes=600)
    got = {r["page_id"]: r for r in archives.read_packages(manifest, run=2).collect()}
    assert len(got) == len(rows) and manifest.count() > 1
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", 9), 2: ("revisit", 9), 3: ("response", None), 4: ("response", None), 5: ("response", None), 9: ("response", None), None: ("revisit", 9)
    }
    assert bytes(got[5]["payload"]) == ("é" * 10).encode() and got[1]["payload"] is None
    assert {got[k]["payload_digest"] for k in (1, 2, 9)} == {hashlib.sha1(big.encode()).hexdigest()}
    empty = archives.write_packages(archives.with_roles(pages.limit(0)))
    assert archives.read_packages(empty).count() == 0


def test_zip64_directories_are_read(tmp_path):
    import struct

    body, name = b"hello", archives.DATA.encode()
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 5, 5, len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(central)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at, 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    reader = archives.open_bytes(local + central + end64 + locator + end)
    offset, size = reader.locate(archives.DATA)
    assert reader.range(offset, size) == body
    with pytest.raises(ValueError):
        archives.open_bytes(b"no zip file")


# ---------------------------------------------------------------- classifiers


def held_out_accuracy(rows, labels, label):
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(a == b for a, b in pairs) / len(pairs)


@pytest.mark.parametrize("name, label", [("op1_quality_classifier", "quality"), ("op6_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    medium = "/root/testdata/sf0.01"
    rows = registry.queries()[name](spark, medium).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert held_out_accuracy(rows, labels, label) >= 0.93
    modulus, rest = (4, 2) if label == "quality" else (3, 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)


def test_language_accuracy(spark):
    medium = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = [r for r in registry.queries()["op9_language_id"](spark, medium).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) >= 0.97


def test_classifiers_awkward(spark):
    d = clashing(docs(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        model = quality.fit_quality(d, marks)
        assert quality.quality_scores(d, model).count() == len(AWKWARD)
        assert quality.accepted(d, model, threshold=0.0).collect() == d.collect()
        lexicon, exceptions = toxicity.fit_lexicon(d, marks)
        assert toxicity.toxicity_scores(d, lexicon, exceptions).count() == len(AWKWARD)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_language(d, langid.fit_language(d)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[7] == "en"
    nothing = langid.fit_language(docs(spark, []))
    assert {r["lang_pred"] for r in langid.detect_language(d, nothing).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams():
    table = lambda names: ({n: k for k, n in enumerate(names)}, np.array([[-1.0, -9.0]] * max(1, len(names)), np.float32))
    model = {"langs": ["aa", "bb"], "tables": [table(["known"]), table(["z"]), table([]), table([]), table([])]}
    scorer = langid.LanguageScorer(model)
    assert scorer("known")[0] == scorer("xzx")[0] == "aa"
    assert scorer("12 34") == ("und", 0.0)


def test_toxicity_folds_and_excepts():
    score = toxicity.ToxicityScorer({"idiot": 5.0, "lowei*": 4.0}, ["loweide"])
    assert [m[2] for m in score.matches(toxicity.fold("An 1d10t, іdіot IDIOT idiotic"))] == [5.0, 5.0, 5.0]
    assert score.matches(toxicity.fold("loweide")) == [] and len(score.matches(toxicity.fold("Loweident"))) == 1
    assert score("clean text")[0] < 0.5 < 0.7 < score("idiot " + "word " * 20_000)[0]
    assert score(None) == score("")


def test_copies_do_not_vote_twice(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text if k < 4 else " ".join(f"own{k}of{j}" for j in range(9)), 1) for k in range(6)]
    sample = spark.createDataFrame(rows, "_order long, text string, label int")
    assert sorted(r["_order"] for r in sampling.without_copies(sample).collect()) == [0, 4, 5]


# ---------------------------------------------------------------- decontamination


def test_masks_hit_every_stretch_with_two_substitutions():
    from itertools import combinations

    for changed in combinations(range(13), 2):
        assert any(
            all(at + k not in changed for k, bit in enumerate(m) if bit == "1") for m in decontam.MASKS for at in range(13 - len(m) + 1)
        )


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [[word() for _ in range(n)] for n in (6, 13, 20, 40)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    rows, want = [], set()
    for k in range(60):
        words, item = [word() for _ in range(30)], rng.randrange(4)
        copy = list(items[item])
        for at in rng.sample(range(1, len(copy) - 1), rng.choice([0, 1, 2, 6])) if item else ():
            copy[at] = "changed"
        rows.append((k, " ".join(words[:15] + copy + words[15:]).upper(), "en", "s", 0))
        full = words[:15] + copy + words[15:]
        for i, x in enumerate(items):
            for shift in range(-len(x), len(full)):
                pairs = [(p, p + shift) for p in range(len(x)) if 0 <= p + shift < len(full)]
                equal = np.array([x[p] == full[q] for p, q in pairs], bool)
                if i == 0:
                    hit = len(equal) == len(x) and equal.all()
                else:
                    hit = len(equal) > 0 and decontam.best_stretch(equal, 13, 0.2) is not None
                if hit:
                    want.add((k, i))
    for block in (10, 1_000_000):
        found = decontam.contaminated(clashing(docs(spark, rows)), bench, block_tokens=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} >= {w for w in want if w[1] == 0}
        got = {(r["doc_id"], r["item_id"]) for r in found}
        assert got <= want and len(got) >= 0.98 * len(want)
    clean = decontam.clean_documents(docs(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {k for k in range(60)} - {d for d, _ in got}
    assert decontam.contaminated(docs(spark), bench.limit(0)).count() == 0
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    assert decontam.clean_documents(docs(spark), bench).count() == len(AWKWARD)


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, registry.quality_model(d, labels)).collect()}
    left = [r for r in d.collect() if scores[r["doc_id"]] >= 0.7]
    first = {}
    for r in sorted(left, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join((r["text"] or "").split()), r)
    left = sorted(first.values(), key=lambda r: r["doc_id"])
    parts = brute_components([tuple(r) for r in left])
    left = [r for r in left if parts[r["doc_id"]][1] == r["doc_id"]]
    index = decontam.SeedIndex([(r["item_id"], r["text"]) for r in bench.collect()])
    memo = decontam._Hashes()
    left = [r for r in left if not index.search(r["text"], memo)]
    taken = mixing.mix(spark.createDataFrame(left, d.schema)).collect()
    want = sorted((r["doc_id"], k + 1) for r in taken for k in range(r["copies"]))
    assert sorted((r["doc_id"], r["copy_no"]) for r in corpus_pipeline.run(spark, SMALL).collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
