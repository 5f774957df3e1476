"""Personal data, periodic runs and ranked search against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedimark.llm import periodic, personal_data, ranking, registry
from tests.conftest import SMALL
from tests.llm.test_llm import AWKWARD, clashing, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good[kind](m[0])]
    return sorted(found)


def noise(rng, n):
    whole = ["4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4", "a@b.c", "300.1.2.3", "_x@y.z"]
    return "".join(rng.choice("ab1.2@-_+ ()3é🙂") if rng.random() < 0.9 else rng.choice(whole) for _ in range(n))


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(3)
    rows = [(k, noise(rng, rng.randint(0, 80))) for k in range(400)] + [(1000 + k, t) for k, t in enumerate(["1" * 2000, "a" * 2000, "+1" + " " * 500, "1 " * 500, "1." * 500, "", None])]
    texts = dict(rows)
    found = personal_data.span_summary(personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(found) == len(rows)
    for r in found:
        spans = base_spans(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans).encode()).hexdigest()
        assert r["base_sha256"] == digest and [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]


def test_wider_forms_are_added_and_clean_texts_left_alone(spark):
    rows = [(k, f"write to x{k}@mail{k}.example.com or call +1 (555) 555-{1000 + k} from 10.1.2.{k}") for k in range(60)]
    rows += [(k, "version 1.2.3 of item 1234-5678, see page 12 at noon (at last)") for k in range(100, 140)]
    rows += [(200, "mail joe (at) example (dot) org, phone (555) 123-4567"), (201, "a b"), (None, None)]
    found = {r["doc_id"]: r["spans"] for r in personal_data.span_summary(personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[200] == "email:5:31,phone:39:53"
    assert not any(found[k] for k in [*range(100, 140), 201, None])


def plain_models(patterns):
    """Both models as loops over lists: (kind, features, n) to weights by kind."""
    dot = lambda x, w: sum(a * b for a, b in zip(x, w))
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    one, votes = personal_data._ONE, personal_data._N_VOTES
    out = {}
    for kind in {p[0] for p in patterns}:
        own = [(x, n) for k, x, n in patterns if k == kind]
        total = [sum(n * x[j] for x, n in own) for j in range(one + 1)]
        odds = [math.log(6), 0.0, math.log(1 / 6)] * 6 + [0.0] * 6
        for _ in range(personal_data.EM_STEPS):
            yes = [sum(n * sigmoid(dot(x, odds)) * x[j] for x, n in own) for j in range(one + 1)]
            a, b = yes[one], total[one] - yes[one]
            odds = [math.log((yes[j] + 1) / (a + 3) * (b + 3) / (max(0.0, total[j] - yes[j]) + 1)) if j < votes else math.log((a + 1) / (b + 1)) if j == one else 0.0 for j in range(one + 1)]
        weights = [0.0] * (one + 1)
        for _ in range(personal_data.FIT_STEPS):
            off = [(x, n * (sigmoid(dot(x, weights)) - sigmoid(dot(x, odds)))) for x, n in own]
            weights = [w - 2.0 * (sum(o * x[j] for x, o in off) / total[one] + 1e-3 * w) for j, w in enumerate(weights)]
        out[kind] = odds, weights
    return out


def test_models_match_plain_loops(spark):
    _, found = personal_data.candidates(spark.read.parquet(f"{SMALL}/documents.parquet"))
    counted = personal_data.vote_patterns(personal_data.labelled(found))
    made = {r["kind_no"]: r for r in personal_data.with_classifier(personal_data.with_reliabilities(counted)).collect()}
    expected = plain_models([(k, p["features"], p["n"]) for k, r in made.items() for p in r["patterns"]])
    assert expected
    for kind, (odds, weights) in expected.items():
        assert made[kind]["odds"] == pytest.approx(odds) and made[kind]["weights"] == pytest.approx(weights)


def plain_runs(words, least=24, power=3):
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if (n := i - start + q) >= max(least, power * q):
                found.setdefault((start, n), q)
            i += 1
    return sorted((s, q, n) for (s, n), q in found.items())


def test_runs_match_brute_force():
    rng = random.Random(1)
    seen = 0
    for _ in range(600):
        n, words = rng.randint(0, 160), []
        while len(words) < n:
            period = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
            words += (period * 80)[: rng.randint(1, 80)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]
        for own in (words, [rng.choice("ab") for _ in range(n)]):
            assert periodic.runs_of(own) == (found := plain_runs(own))
            assert periodic.runs_of(own, 12, 4) == plain_runs(own, 12, 4)
            seen += len(found)
            gone = {k for s, q, size in found for k in range(s + q, s + size)}
            assert periodic.kept_words(own, found) == [w for k, w in enumerate(own) if k not in gone]
    assert seen > 500
    assert periodic.runs_of(["x"] * 50_000) == [(0, 1, 50_000)]


def test_runs_awkward(spark):
    found = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in periodic.run_summary(periodic.periodic_runs(clashing(docs(spark)))).collect()}
    assert (7, 1, 0, 30_000, 1, 30_000_000) in found and (3, 0, None, None, None, None) in found and (None, 0, None, None, None, None) in found
    assert periodic.periodic_runs(docs(spark)).count() == len(AWKWARD) and periodic.periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs(spark), min_power=2)


def plain_ranks(texts, items, top):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(fold(t))) for i, t in texts]
    bags = [(i, c) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in bags:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(fold(text)) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_match_brute_force(spark, monkeypatch, parts):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ünï", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, text(rng.randint(1, 60))) for k in range(700)] + [(700 + k, "w1 W2 w3") for k in range(60)] + [(None, text(9)), (5000, None), (5001, "--"), (5002, text(3000))]
    items = [(k, text(rng.randint(1, 25))) for k in range(40)] + [(50, "w1"), (51, "nowhere"), (52, None), (None, "w2, W3"), (50, "w1")]
    monkeypatch.setattr(ranking, "_PART", 500)
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("id", "doc_id", "block", "n")})
    expected = sorted(plain_ranks(texts, items[:-1], 20), key=str)
    for block_terms in (1 << 18, 60):
        got = ranking.ranked_search(d, i, 20, block_terms=block_terms)
        assert sorted(map(tuple, got.collect()), key=str) == expected


def test_ranks_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked_search(none, items).count() == 0
    assert ranking.ranked_search(docs(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_names_of_queries():
    assert {"op11_personal_data", "op12_periodic_runs", "op13_ranked_search"} <= set(registry.queries())
