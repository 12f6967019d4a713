import numpy as np

from lodeworks.llm import langid

WORDS = {
    "en": "the night is long and we are walking home through rain with you under an old umbrella while city sleeps".split(),
    "it": "questa notte lunga noi camminiamo verso casa sotto la pioggia con un vecchio ombrello mentre dorme ancora".split(),
    "ru": "эта длинная ночь мы идём домой под дождём старый зонт пока город спит снова никто ничего".split(),
}


def song(rng, language, lines=4):
    return "\n".join(" ".join(rng.choice(WORDS[language], 6)) for _ in range(lines))


def tables(spark, songs, labels):
    return (
        spark.createDataFrame([(i, t, "x", 0.5) for i, t in songs], "idx bigint, lyrics string, stanza string, confidence double"),
        spark.createDataFrame([(i, x, 1) for i, x in labels], "idx bigint, lang string, words int"),
    )


def corpus():
    rng = np.random.default_rng(1)
    songs, labels = [], []
    for i in range(90):
        code = ("en", "it", "ru")[i % 3]
        songs.append((i, song(rng, code)))
        labels.append((i, {"en": "en-GB", "it": "Italian", "ru": " RU"}[code] if i % 11 else "italiano"))
    return rng, songs, labels


def test_stanzas():
    text = "[Verse]\r\none two\r\n(la la)\r\rthree\n \t\n\nfour\n[x\n"
    assert langid.stanzas_of(text) == [["one two"], ["three"], ["four", "[x"]]
    assert langid.stanzas_of(None) == langid.stanzas_of("[a]\n\n(b)") == []
    assert langid.spoken(["la", "casa", "yeah"]) == 1


def test_languages_of_songs_and_stanzas(spark):
    rng, songs, labels = corpus()
    songs += [(100, song(rng, "en") + "\n\n" + song(rng, "it")), (101, "[Intro]\n\nla la la\noh yeah\n\n" + song(rng, "ru")), (102, None), (103, "  short\n"), (104, "[instrumental track]"), (None, song(rng, "en")), (0, songs[0][1])]
    labels += [(100, "eng"), (101, "??"), (102, "en"), (3, "en-GB"), (None, "it")]
    rows = langid.stanza_languages(*tables(spark, songs, labels)).collect()
    by = {(r["idx"], r["stanza"]): r for r in rows}
    assert len(by) == len(rows)
    for i in range(90):
        assert by[i, 1]["lang"] == by[i, 1]["song_lang"] == ("en", "it", "ru")[i % 3]
        assert 0 < by[i, 1]["confidence"] <= 1
    assert (by[100, 1]["lang"], by[100, 2]["lang"], by[100, 1]["languages"]) == ("en", "it", 2)
    assert (101, 1) not in by and by[101, 2]["lang"] == "ru" and by[101, 2]["label"] is None
    assert not {i for i, _ in by} & {102, 103, 104, None}
    found = {(r["idx"], r["stanza"]) for r in langid.relabelled(spark.createDataFrame(rows, langid.STANZAS)).collect()}
    assert found == {(100, 1), (100, 2), (101, 2)} | {(i, 1) for i in range(0, 90, 11) if i % 3 != 1}


def test_held_out_accuracy():
    rng = np.random.default_rng(2)
    model = langid.train([(c, song(rng, c, 8)) for c in WORDS for _ in range(30)])
    lines = [(c, x) for c in WORDS for x in song(rng, c, 200).split("\n")]
    right = sum(model.languages[k] == c for (c, _), (k, _) in zip(lines, zip(*model.nearest([langid.words_of(x) for _, x in lines]))))
    assert right >= 0.98 * len(lines)


def test_rejects_what_is_far_from_all():
    rng = np.random.default_rng(3)
    model = langid.train([(c, song(rng, c, 8)) for c in WORDS for _ in range(30)])
    assert [k for k, _, _ in model.judge(["ξζψ ωφχ ζζξψ", "1234", ""])] == [-1, -1, -1]


def test_word_rows_equal_the_cosines(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.train([(c, song(rng, c, 8)) for c in WORDS for _ in range(30)])
    lines = [" ".join([*rng.choice(WORDS[c], 3), *rng.choice(WORDS["en"], 2), "ζξψ"][: rng.integers(1, 6)]) for c in WORDS for _ in range(60)]
    row, ids, values, n = langid.vectors(lines, model.idf, {})
    cosines = langid._cosines(row, ids, values, n, model.centroids)
    best = np.stack([cosines[:, model.owner == k].max(axis=1) for k in range(len(model.languages))], axis=1)
    for part in (0.0, 0.5, 1.0, 2.0):  # rejection too, where the bounds of the norm settle it and where they do not
        monkeypatch.setattr(model, "reject", np.full(len(model.languages), part * np.median(best.max(axis=1))))
        top, _ = model.nearest([langid.words_of(x) for x in lines])
        want = np.where(best.max(axis=1) >= model.reject[0], best.argmax(axis=1), -1)
        assert (top == want).mean() > 0.98


def test_other_languages_come_from_the_labels(spark):
    rng = np.random.default_rng(6)
    songs = [(i, song(rng, ("en", "ru")[i % 2])) for i in range(60)]
    labels = [(i, ("EN", "xx-YY")[i % 2]) for i in range(60)]
    rows = langid.stanza_languages(*tables(spark, songs, labels), spellings={"en": "en", "xx": "xx"}).collect()
    assert {(r["idx"] % 2, r["lang"]) for r in rows} == {(0, "en"), (1, "xx")}


def test_unsure_lines_follow_their_stanza():
    verdicts = [(0, 0.9), (1, 0.05), (0, 0.8), (1, 0.9)]
    langid.settle(verdicts, [5, 9, 5, 4], 0, [3, 1])
    assert verdicts == [(0, 0.9), (0, 0.05), (0, 0.8), (1, 0.9)]


def test_without_labels_there_is_no_model(spark):
    songs, labels = tables(spark, [(1, "some words that are sung")], [])
    assert langid.fit(songs, labels) is None and langid.stanza_languages(songs, labels).collect() == []
    assert langid.stanza_languages(*tables(spark, [], [(1, "en")])).collect() == []


def test_spellings(spark):
    rows = [("en_US",), (" Italiano ",), ("русский",), ("und",), ("",), (None,), ("pt-BR",), ("xx",)]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string").select(langid.language_code(langid.F.col("lang"))).collect()]
    assert got == ["en", "it", "ru", None, None, None, "pt", None]
