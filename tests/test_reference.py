from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions.hashing import char_shingles, distinct
from lodeworks.functions.text import normalised, tokens, word_count
from lodeworks.functions.words import ITALIAN, stem_italian, stemmed, without
from lodeworks.operators import ads, baskets, cluster, search, shingles, songs
from lodeworks.session import shared_dir
from lodeworks.sources import tables


def test_normalised():
    assert normalised("  Città, PERCHÉ?!\n è_qui ") == "citta perche e qui"
    assert normalised(None) == normalised("?!") == ""


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_normalised_is_stable(text):
    assert normalised(normalised(text)) == normalised(text)


def test_tokens_and_counts(spark):
    row = spark.createDataFrame([("Perché no_1, sì!",), (None,)], "t string").select(tokens(F.col("t")).alias("w"), word_count(F.col("t")).alias("n")).collect()
    assert row[0]["w"] == ["perché", "no_1", "sì"] and row[0]["n"] == 3 and row[1]["n"] == 0


@pytest.mark.parametrize("word,stem", [("abbandonata", "abbandon"), ("pronto", "pront"), ("propaga", "propag"), ("bilocale", "bilocal"), ("appartamento", "appart"), ("fuochi", "fuoc"), ("velocemente", "veloc"), ("a", "a")])
def test_stems(word, stem):
    assert stem_italian(word) == stem


def test_stemmed_and_stop_words(spark):
    df = spark.createDataFrame([(["la", "casa", "la"],), (None,)], "w array<string>")
    rows = df.select(stemmed(F.col("w")).alias("s"), without(F.col("w"), ITALIAN).alias("k")).collect()
    assert rows[0]["s"][1] == "cas" and rows[0]["k"] == ["casa"] and rows[1]["s"] is None and rows[1]["k"] is None


def test_price(spark):
    rows = [("1.090,00 €",), ("330 €",), ("x",), (None,), ("",), ("Contatta l'utente",)]
    assert [r[0] for r in spark.createDataFrame(rows, "prices string").select(ads.price("prices")).collect()] == [1090.0, 330.0, None, None, None, None]


def test_first_by_key(spark):
    df = spark.createDataFrame([("a", "2", "x"), ("a", "1", "y"), ("a", None, "z"), (None, "1", "q"), ("b", "1", "r"), ("b", "1", "r")], "k string, t string, v string")
    assert {tuple(r) for r in ads.first_by_key(df, "k", ["t"]).collect()} == {("a", None, "z"), ("b", "1", "r")}


def test_baskets(spark):
    log = spark.createDataFrame([("u", "a")] * 3 + [("u", "b")] * 2 + [("v", "a")] * 2 + [("v", "c")] * 2 + [(None, "a"), (" ", "a"), ("w", None)], "userid string, traid string")
    counts = baskets.play_counts(log, 2)
    assert {tuple(r) for r in counts.collect()} == {("u", "a", 3), ("u", "b", 2), ("v", "a", 2), ("v", "c", 2)}
    lists = baskets.baskets(counts)
    assert {tuple(r) for r in lists.collect()} == {("u", "a b"), ("v", "a c")}
    assert {tuple(r) for r in baskets.postings(counts).collect()} == {("a", "u"), ("b", "u"), ("a", "v"), ("c", "v")}
    top = baskets.top_tracks(baskets.track_users(counts))
    assert [tuple(r) for r in top.collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert [tuple(r) for r in baskets.top_pairs(top).collect()] == [("a", "b", 3), ("a", "c", 3), ("b", "c", 2)]
    assert baskets.top_pairs(top.limit(0)).collect() == []


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "casa bella casa", None), ("d2", "bella vista", "casa"), ("d3", None, "")], "links string, descriptions string, titles string")
    counts = search.term_counts(docs, "links", ["descriptions", "titles"], [])
    lengths = docs.select(F.col("links").alias("doc"), (F.coalesce(F.length("descriptions"), F.lit(0)) + F.coalesce(F.length("titles"), F.lit(0))).alias("length"))
    path = str(tmp_path / "index")
    search.store_index(search.index(counts, 3), lengths, path)
    assert search.stored_postings(spark, path).count() == 5
    query = ["cas", "casa"]
    read = search.stored_postings(spark, path, query)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    rows = search.search(read, 3, query).collect()
    weight = (1 + np.log10(2)) * (1 + np.log10(3 / 2)) * (1 + np.log10(4 / 2)) / 2 / 15
    assert rows[0]["doc"] in ("d1", "d2") and {r["doc"]: r["score"] for r in rows}["d1"] == pytest.approx(weight, abs=1e-7)
    assert search.search(search.stored_postings(spark, path, []), 3, []).collect() == [] == search.search(search.stored_postings(spark, path, ["zzz"]), 3, ["zzz"]).collect()
    assert search.query_tokens("la casa della CASA") == ["cas"]


def naive_signature(text):
    import hashlib

    hexed = {hashlib.sha1(text[i : i + 10].encode()).hexdigest() for i in range(len(text) - 9)}
    return [min(hashlib.sha1((h + str(i).zfill(20)).encode()).hexdigest()[-10:] for h in hexed) for i in range(10)]


def test_shingles_signatures_and_pairs(spark):
    base = "il palazzo degli anni settanta ha un cortile e una rampa per le auto dei condomini"
    texts = [("a", base), ("b", base + " oggi"), ("c", base), ("d", "tutt'altro testo che non somiglia a niente di quanto sta sopra"), ("e", "corto"), ("f", None), (None, base)]
    df = spark.createDataFrame(texts, "k string, t string")
    once = shingles.distinct_texts(df, "k", "t")
    assert {r["key"] for r in once.collect()} == {"a", "b", "d", "e"}
    assert {tuple(r) for r in shingles.class_members(df, "k", "t").collect()} == {("a", "a", 2), ("c", "a", 2), ("b", "b", 1), ("d", "d", 1), ("e", "e", 1)}
    signed = shingles.signatures(once)
    got = {r["key"]: r["signature"] for r in signed.collect()}
    assert got["a"] == naive_signature(base) and set(got) == {"a", "b", "d"}
    equal = sum(x == y for x, y in zip(got["a"], got["b"]))
    assert {(r["a"], r["b"]) for r in shingles.lsh_pairs(signed).collect()} == ({("a", "b")} if equal >= 8 else set())
    assert [tuple(r)[:2] for r in shingles.jaccard_pairs(once).collect()] == [("a", "b")]
    assert shingles.jaccard_pairs(once.limit(0)).collect() == []


@pytest.mark.parametrize("kept", [0, 50, 10**6])
def test_signatures_of_many_chunks(spark, monkeypatch, kept):
    """A shingle of earlier chunks is hashed once, as far as a task keeps it, and the signatures stay."""
    monkeypatch.setattr(shingles, "HELD_TAILS", kept, raising=False)
    hashed = []
    monkeypatch.setattr(shingles, "_tails", lambda s, tails=shingles._tails: hashed.append(s) or tails(s))
    monkeypatch.setattr(shingles, "in_chunks", lambda texts, characters: ((i, i + 1) for i in range(len(texts))))
    texts = {f"k{i}": t for i, t in enumerate(edited_texts(30, 2))}

    class Held:  # runs in this process
        def mapInPandas(self, sign, _):
            return [r for out in sign([pd.DataFrame({"key": list(texts), "text": list(texts.values())})]) for r in zip(out["key"], out["signature"])]

    monkeypatch.setattr(shingles, "_dealt", lambda *_: Held())
    assert dict(shingles.signatures(None)) == {k: naive_signature(t) for k, t in texts.items()}
    if kept > 50:
        assert len(hashed) == len(set(hashed))


def test_duplicates_count_copies(spark):
    base = "il palazzo degli anni settanta ha un cortile e una rampa per le auto dei condomini"
    rows = [("b", base), ("e", base), ("d", base + "!"), ("a", base + "!"), ("f", base + "!"), ("z", "un testo solo che non somiglia agli altri"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    pairs = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, score double")
    sets = {k: {t[i : i + 10] for i in range(len(t) - 9)} for k, t in rows if t}
    want = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {r["key"] for r in shingles.later_copies(pairs, shingles.class_members(df, "k", "t")).collect()} == want


@given(st.lists(st.text(min_size=10, max_size=40), min_size=1, max_size=5))
@settings(max_examples=50, deadline=None)
def test_shingle_hashes(texts):
    hashes, offsets = char_shingles(texts, 10)
    assert list(np.diff(offsets)) == [len(t) - 9 for t in texts]
    assert len(distinct(hashes)) == len({t[i : i + 10] for t in texts for i in range(len(t) - 9)}) == len(set(hashes.tolist()))


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = list(rng.choice(words, 20)) if i % 3 == 0 else list(texts[-1][1].split(" "))
        if i % 3:
            base[rng.integers(20)] = rng.choice(words)
        texts.append((f"k{i:02d}", " ".join(base)))
    sets = {k: {t[i : i + 10] for i in range(len(t) - 9)} for k, t in texts}
    got = {tuple(r) for r in shingles.jaccard_pairs(shingles.distinct_texts(spark.createDataFrame(texts, "k string, t string"), "k", "t")).select("a", "b").collect()}
    reps = {}
    for k, t in texts:
        reps.setdefault(t, k)
    keys = sorted(reps.values())
    assert got == {(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def edited_texts(n, seed):
    """Texts of few words and very different length, of which many are edits of one another."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        base = texts[rng.integers(len(texts))].split(" ") if i % 3 else list(rng.choice([f"parola{w}" for w in range(40)], rng.integers(3, 60)))
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(len(base))] = f"parola{rng.integers(60)}"
        texts.append(" ".join(base[: rng.integers(max(2, len(base) - 6), len(base) + 1)]))
    return list(dict.fromkeys(t for t in texts if len(t) >= 10))


def brute_force(texts, threshold):
    sets = [{t[i : i + 10] for i in range(len(t) - 9)} for t in texts]
    return {(min(f"k{i}", f"k{j}"), max(f"k{i}", f"k{j}")) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("bits", [3, 8, 22])
def test_blocks_of_texts_meet_exactly(monkeypatch, threshold, bits):
    """Also where nearly all shingles fall on one another, and whatever is held at a time."""
    for name, value in (("BUCKET_BITS", bits), ("BUCKETS", 1 << bits), ("CHUNK", 700), ("MEETINGS", 50), ("HELD_SETS", 3)):
        monkeypatch.setattr(shingles, name, value)
    texts = edited_texts(120, bits)
    keys = [f"k{i}" for i in range(len(texts))]
    one, two = (shingles._Block(keys[cut], texts[cut], 10, threshold) for cut in (slice(0, 70), slice(70, None)))
    one.index()
    two.index()
    got = [x[:2] for x in (*one.similar(one), *one.similar(two), *two.similar(two))]
    assert len(got) == len(set(got)) and set(got) == brute_force(texts, threshold)


def test_jaccard_stores_only_the_texts(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 20_000, raising=False)
    monkeypatch.setattr(shingles, "FILE_ROWS", 30, raising=False)
    texts = edited_texts(400, 1)
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string")
    held = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = held()
    got = [tuple(r)[:2] for r in shingles.jaccard_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(texts, 0.8)
    assert held() - before < sum(map(len, texts))  # shingles or candidates would take many times that


def test_clusters(spark):
    points = cluster.synthetic_points(spark, 4, 25, 3)
    assert points.count() == 100 and len(points.first()["vector"]) == 7
    rows = {r["id"]: np.array(r["vector"]) for r in points.collect()}
    chosen = cluster.farthest_first(points, 4, 0)
    want = [0]
    while len(want) < 4:
        want.append(max(rows, key=lambda i: (min(((rows[i] - rows[j]) ** 2).sum() for j in want), -i)))
    assert chosen == want
    assigned, centers = cluster.kmeans(points, cluster.seeds(points, chosen), 30)
    for r in assigned.collect():
        assert r["cluster"] == min(range(4), key=lambda c: ((rows[r["id"]] - centers[c]) ** 2).sum())
    scores = cluster.agreement(assigned, points).collect()
    assert len(scores) == 4 and all(0 < r["jaccard"] <= 1 for r in scores)
    reduced, values = cluster.svd(points, 3)
    x = np.stack([rows[i] for i in sorted(rows)])
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3])
    back = {r["id"]: r["reduced"] for r in reduced.collect()}
    assert np.allclose(np.linalg.norm([back[i] for i in sorted(back)], axis=0), values)


def test_kmeans_runs_until_no_point_changes(spark):
    # five seeds at one end of a line: the borders between the clusters creep along it
    line = [[float(i), float(i % 3)] for i in range(300)]
    points = spark.createDataFrame(list(enumerate(line)), "id bigint, vector array<double>").repartition(3)
    x, centers, passes = np.array(line), np.array(line[:5]), 0
    near = np.full(len(x), -1)
    while True:
        now = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        if (now == near).all():
            break
        near, passes = now, passes + 1
        centers = np.array([x[near == c].mean(axis=0) for c in range(5)])
    assert passes > 20
    assigned, found = cluster.kmeans(points, np.array(line[:5]))
    assert [r["cluster"] for r in assigned.orderBy("id").collect()] == list(near)
    assert np.allclose(found, centers)
    with pytest.raises(RuntimeError):
        cluster.kmeans(points, np.array(line[:5]), 20)


def test_agreement_of_the_kmeans_result(spark, tmp_path):
    from lodeworks.plans import reference_queries as q

    rows = [(i, [float(i), float(i % 3)], i % 5) for i in range(300)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found, known = {}, {}
    for r in q.kmeans(spark, str(tmp_path)).collect():
        found.setdefault(r["cluster"], set()).add(r["vec_id"])
        known.setdefault(r["vec_id"] % 5, set()).add(r["vec_id"])
    want = {label: round(max(len(a & b) / len(a | b) for b in found.values()), 6) for label, a in known.items()}
    assert {r["label"]: r["jaccard"] for r in q.kmeans_agreement(spark, str(tmp_path)).collect()} == want


def test_reconstruction(spark):
    points = cluster.synthetic_points(spark, 3, 20, 2)
    x = np.array([r["vector"] for r in points.orderBy("id").collect()])
    u, w, v = np.linalg.svd(x, full_matrices=False)
    back = np.array([r["vector"] for r in cluster.reconstructed(points, 2).orderBy("id").collect()])
    assert np.allclose(back, u[:, :2] @ np.diag(w[:2]) @ v[:2])
    assert cluster.svd(points.limit(0), 2)[1].size == 0 and cluster.reconstructed(points.limit(0), 2).count() == 0


def test_best_classifier_is_saved(spark, tmp_path):
    rows = [(i, ("Rock", "Jazz")[i % 2], ["guitar", "loud", f"w{i % 7}"] if i % 2 == 0 else ["horn", "blue", f"w{i % 5}"]) for i in range(150)]
    df = spark.createDataFrame(rows, "idx bigint, genre string, tokens array<string>")
    model = songs.best_classifier(df, str(tmp_path / "model"), strengths=(0.1, 0.01), features=64)
    assert (tmp_path / "model").exists() and model.numClasses == 2
    guessed = songs.baseline_classifier(df, features=64).collect()
    assert guessed and all(r["label"] == r["predicted"] for r in guessed)


def test_songs(spark):
    rows = [(1, "Rock", "[Chorus verse] Hello (World)"), (1, "Rock", "[Chorus verse] Hello (World)"), (2, "Jazz", None), (3, "Pop", "short"), (4, "Jazz", "la la blue note la tonight")]
    df = spark.createDataFrame(rows, "idx bigint, genre string, lyrics string")
    clean = songs.cleaned(df)
    assert {(r["idx"], r["text"]) for r in clean.collect()} == {(1, " ] hello (world"), (4, "la la blue note la tonight")}
    words = songs.song_tokens(clean)
    vocab = {r["word"]: r["word_id"] for r in songs.vocabulary(words).collect()}
    assert vocab == {w: i for i, w in enumerate(sorted(["hello", "world", "la", "blue", "note", "tonight"]))}
    ids = {r["idx"]: r["ids"] for r in songs.encoded(words, songs.vocabulary(words, reserve_zero=True), 6).collect()}
    assert ids[1] == [vocab["hello"] + 1, vocab["world"] + 1, 0, 0, 0, 0]
    assert songs.encoded(words, songs.vocabulary(words).filter("word = 'blue'"), 3).count() == 2
    presence = {r["word"]: (r["rock"], r["jazz"]) for r in songs.word_class_presence(words).collect()}
    assert presence["hello"] == (1, 0) and presence["blue"] == (0, 1)
    assert songs.balanced(clean, k=1).count() == 2
    assert songs.long_items(words, 2).select(F.size("tokens")).first()[0] == 2


def test_numbered_without_gaps(spark):
    rows = songs.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), [F.col("v")], "n", 7)
    assert all(r["v"] == r["n"] for r in rows.collect())


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in songs.class_metrics(songs.confusion(df)).collect()}
    assert got == {"a": (1.0, 0.5, 0.666667, 2), "b": (0.333333, 1.0, 0.5, 1), "c": (0.0, 0.0, 0.0, 1)}
    assert songs.micro_metrics(songs.confusion(df)).first()["accuracy"] == 0.5


def test_extract_ads(spark):
    html = '<div class="item"><a class="cta" href="/1?a=1&amp;b=2"> Bella &amp; nuova </a><p class="locale">Roma</p></div><div class="item"><h4 class="price">10 €</h4></div>'
    want = [("/1?a=1&b=2", "Bella & nuova", None, "Roma", None, None), (None, None, None, None, None, "10 €")]
    rows = tables.extract_ads(spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string"), scope=None).collect()
    assert [tuple(r) for r in rows] == want
    around = '<img src="x"><div class="item"><a class="cta" href="/ad">Sponsored</a></div>'
    page = f'<html><body>{around}<div id="menu"><div></div></div><div id="search-result"><div><br>{html}</div></div><div>{around}</div><p class="locale">Milano</p></body></html>'
    rows = tables.extract_ads(spark.createDataFrame([(1, page), (2, around)], "page int, html string")).collect()
    assert [tuple(r) for r in rows] == want


def test_text_files(spark, tmp_path):
    texts = ["", None, " a ", "a\tb", 'q"x"', "\\", "a,b", "é", '""', "\t", "-"]
    df = spark.createDataFrame([(t, "1", "a", t, "t", "y") for t in texts], tables.LISTENING_LOG)
    for header in (True, False):
        tables.write_tsv(df, str(tmp_path / "log"), header=header)
        back = tables.read_tsv(spark, str(tmp_path / "log"), tables.LISTENING_LOG, header=header, null=tables.NULL)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "plain.tsv").write_text("u\t1\ta\t\tt\ty\nv\t2\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "plain.tsv"), tables.LISTENING_LOG).collect()] == [("u", "1", "a", None, "t", "y"), ("v", "2", None, None, None, None)]
    (tmp_path / "songs.csv").write_text('idx,song,song_year,artist,genre,lyrics\n1,s,2000,a,Rock,"one\ntwo ""q"""\n')
    assert tables.read_csv(spark, str(tmp_path / "songs.csv"), tables.SONGS).first()["lyrics"] == 'one\ntwo "q"'
    df = spark.createDataFrame([(1, t, None, None, "", 'one\r\n\ntwo, "q"\r') for t in texts], tables.SONGS)
    tables.write_csv(df, str(tmp_path / "songs"))
    assert sorted(map(str, tables.read_csv(spark, str(tmp_path / "songs"), tables.SONGS, null=tables.NULL).collect())) == sorted(map(str, df.collect()))


def test_first_rows_in_file_order(spark, tmp_path):
    spark.createDataFrame([(k, i) for i, k in enumerate("bacabcab")], "k string, v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = tables.with_file_order(spark.read.parquet(str(tmp_path / "t")))
    assert {tuple(r)[:2] for r in ads.first_by_key(rows, "k", ["__file", "__row"]).collect()} == {("b", 0), ("a", 1), ("c", 2)}


def test_subword_items(spark):
    from lodeworks.plans.reference_queries import SUBWORDS

    df = spark.createDataFrame([(1, "word " * 200), (2, "short one"), (3, None), (4, "a b c d <|endoftext|>")], "idx bigint, text string")
    rows = {r["idx"]: r for r in songs.subword_items(df, SUBWORDS, length=5).collect()}
    assert set(rows) == {1, 4} and all(len(r[c]) == 5 for r in rows.values() for c in ("ids", "mask", "segments"))
    assert rows[1]["ids"][0] == rows[4]["ids"][0] == 49406 and len(set(rows[1]["ids"][1:])) == 1 and set(rows[1]["mask"]) == {1}


def test_multi_hot(spark):
    rows = spark.createDataFrame([(1, "Rock", ["a", "b"]), (2, "Jazz", ["a"])], "idx int, genre string, tokens array<string>")
    assert [tuple(r) for r in songs.multi_hot(rows, ("Rock", "Jazz")).orderBy("word_id").collect()] == [(0, "a", [1, 1]), (1, "b", [1, 0])]


def test_networks_learn_what_can_be_learnt(spark):
    rng = np.random.default_rng(8)
    words = {"Rock": ["guitar", "loud", "drum"], "Jazz": ["sax", "swing", "blue"], "Country": ["road", "truck", "farm"]}
    rows = [(i, g, [str(w) for w in rng.choice([*words[g], "the", "and", "night"], 12)]) for i, g in enumerate(list(words) * 120)] + [(1000, "Rock", []), (1001, "Jazz", None)]
    df = spark.createDataFrame(rows, "idx bigint, genre string, tokens array<string>")
    hot = songs.multi_hot(df, tuple(words)).join(songs.vocabulary(df).select("word", "df"), "word")
    features = songs.filter_features(df, hot.select("word", "df", F.col("hot").alias("vector")), length=20, filters=8)
    assert features.count() == len(rows)
    guessed = songs.network_classifier(features, hidden=8)
    assert guessed.count() > 20 and guessed.filter("label = predicted").count() >= 0.7 * guessed.count()
    empty = songs.filter_features(df.limit(0), hot.select("word", "df", F.col("hot").alias("vector")))
    assert songs.network_classifier(empty).collect() == []


def test_synthetic_points_are_normal_and_repeatable(spark):
    rows = cluster.synthetic_points(spark, 5, 2000, 6).orderBy("id").collect()
    again = cluster.synthetic_points(spark, 5, 2000, 6).repartition(7).orderBy("id").collect()
    assert rows == again
    x = np.array([r["vector"] for r in rows])
    assert (x[:, :5].argmax(axis=1) == np.arange(10_000) % 5).all() and (x[:, :5].sum(axis=1) == 1).all()
    z = x[:, 5:] * 5**0.5
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and np.abs(np.corrcoef(z.T) - np.eye(6)).max() < 0.05 and abs((z**4).mean() - 3) < 0.2
