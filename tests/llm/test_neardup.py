import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.functions.text import normalised
from lodeworks.functions.hashing import char_shingles
from lodeworks.llm import neardup as nd
from lodeworks.operators import pairs, skew

SCHEMA = "links string, descriptions string, id string, rep string"


def ads(spark, rows):
    return spark.createDataFrame([(k, t, "x", None) for k, t in rows], SCHEMA)


def truth(rows, threshold=0.7, k=10, least=80):
    sets = sorted((key, {x[i : i + k] for x in [normalised(t)] for i in range(len(x) - k + 1)}) for key, t in rows if key and len(normalised(t)) >= least)
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(x & y) >= threshold * len(x | y)}


def edited(n, seed, families=12):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("casa", "via", "mq", "luce", "zona", "affitto") for b in range(40)]
    texts = []
    for i in range(n):
        if i < families:
            w = list(rng.choice(words, rng.integers(20, 90)))
        else:
            w = texts[rng.integers(families)][1].split(" ")
            for _ in range(rng.integers(0, 6)):
                at = rng.integers(len(w))
                w[at : at + rng.integers(0, 2)] = [str(rng.choice(words))]
        texts.append((f"l{i:04d}", " ".join(w)))
    return texts


def find(spark, rows, **more):
    args = {"key": "links", "text": "descriptions", "shingle": 10, "threshold": 0.7, "min_chars": 80} | more
    return {tuple(r) for r in nd.similar_pairs(ads(spark, rows), **args).collect()}


def test_pairs_against_brute_force(spark):
    rows = edited(150, 1)
    assert find(spark, rows) == truth(rows)


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    rows = edited(220, 2, families=1)
    monkeypatch.setattr(nd, "DIRECT", 10)
    monkeypatch.setattr(nd, "BLOCK", 40)
    assert find(spark, rows) == truth(rows)


@pytest.mark.parametrize("copies", [51, 300])
def test_every_copy_is_listed(spark, monkeypatch, copies):
    monkeypatch.setattr(pairs, "BLOCK", 40)
    text = "bilocale luminoso in zona tranquilla vicino alla stazione con balcone e cantina al terzo piano"
    rows = [(f"c{i:04d}", text.upper() if i % 2 else text + "!") for i in range(copies)] + [("z", text + " oggi"), ("y", text + " ora"), ("a", text + " ora"), ("x", "altro " * 30)]
    assert find(spark, rows) == truth(rows)


def test_thousands_of_copies(spark):
    text = "bilocale luminoso in zona tranquilla vicino alla stazione con balcone e cantina al terzo piano"
    rows = [(f"c{i:04d}", text) for i in range(5000)] + [("z", text + " oggi")]
    found = nd.similar_pairs(ads(spark, rows), "links", "descriptions", 10, 0.7, 80)
    assert found.count() == found.distinct().count() == 5000 * 4999 // 2 + 5000 and found.filter("b = 'z'").count() == 5000
    near, members = nd.representative_pairs(ads(spark, rows), "links", "descriptions", 10, 0.7, 80)
    assert [(r["a"], r["b"]) for r in near.collect()] == [("c0000", "z")] and members.filter("rep = 'c0000' AND copies = 5000").count() == 5000


def test_very_great_buckets_are_banded_anew(spark, monkeypatch):
    rows = edited(220, 6, families=2)
    for name, value in (("DIRECT", 5), ("REBAND", 30), ("BLOCK", 40)):
        monkeypatch.setattr(nd, name, value)
    assert find(spark, rows) == truth(rows)


@pytest.mark.parametrize("small", [0, 4_000_000])
def test_a_hub_of_components(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL_TABLE", small)
    edges = spark.createDataFrame([("a", f"n{i:05d}") for i in range(4000)] + [(f"n{i:05d}", f"z{i:05d}") for i in range(0, 4000, 7)], "a string, b string")
    got = nd.components(edges)
    assert got.filter("root = 'a'").count() == got.count() == 4001 + len(range(0, 4000, 7))


def test_nulls_short_and_repeated_rows(spark):
    long = "appartamento arredato con due camere, cucina abitabile e bagno, vicino alla metro e ai negozi"
    rows = [("a", long), ("a", long), ("b", long), (None, long), ("c", None), ("d", ""), ("e", "corto"), ("f", "aaaa" * 40), ("g", "aaaa" * 41), ("h", "é" * 90)]
    assert find(spark, rows) == {("a", "b"), ("f", "g")}
    assert find(spark, []) == set()
    classes = {r["id"]: (r["class_id"], r["links"]) for r in nd.classes(ads(spark, rows), "links", "descriptions", 10, 0.7, 80).collect()}
    assert classes["a"] == classes["b"] == ("a", 1) and classes["c"] == ("c", 0) and classes["f"][0] == classes["g"][0] == "f" and len(classes) == 8


def test_classes_join_chains(spark):
    rows = edited(120, 3)
    edges = truth(rows)
    root = {k: k for k, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r["id"]: (r["class_id"], r["links"]) for r in nd.classes(ads(spark, rows), "links", "descriptions", 10, 0.7, 80).collect()}
    assert got == {k: (top(k), sum(k in e for e in edges)) for k, _ in rows}


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {tuple(r) for r in nd.components(edges).collect()}
    assert got == {(f"n{i:03d}", "n000") for i in range(61)} | {("x", "x"), ("y", "x")}


def test_words_of_five(spark):
    base = " ".join(f"parola{i}" for i in range(60))
    rows = [("a", base), ("b", base.replace("parola30", "altra")), ("c", " ".join(f"altro{i}" for i in range(60)))]
    assert find(spark, rows, shingle=5, threshold=0.8, min_chars=0, words=True) == {("a", "b")}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(4)
    gaps = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(20):
            both = rng.integers(0, 2**63, int(800 * share), dtype=np.uint64)
            one, two = (np.concatenate([both, rng.integers(0, 2**63, 800 - len(both), dtype=np.uint64)]) for _ in range(2))
            a, b = (nd.sketches(x, np.array([0, len(x)])) for x in (one, two))
            gaps.append(nd.estimated_similarity(a, b)[0] - len(both) / (1600 - len(both)))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.045


def test_disjoint_sets_estimate_nothing():
    rng = np.random.default_rng(5)
    a, b = (nd.sketches(rng.integers(0, 2**63, 50_000, dtype=np.uint64), np.array([0, 50_000])) for _ in range(2))
    assert abs(nd.estimated_similarity(a, b)[0]) < 0.02


@given(st.lists(st.text(min_size=10, max_size=60), min_size=1, max_size=6))
@settings(max_examples=50, deadline=None)
def test_shingle_hashes_follow_the_substrings(texts):
    hashes, offsets = char_shingles(texts, 10)
    parts = [t[i : i + 10] for t in texts for i in range(len(t) - 9)]
    assert list(np.diff(offsets)) == [len(t) - 9 for t in texts] and len(hashes) == len(parts)
    assert len(set(hashes.tolist())) == len(set(parts))


@pytest.mark.parametrize("n", [1, 5, 71])
def test_equal_sets_have_equal_sketches(n):
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = nd.sketches(x, np.array([0, n])), nd.sketches(x[::-1].copy(), np.array([0, n]))
    assert (a == b).all() and nd.bands(a)[1].any()
