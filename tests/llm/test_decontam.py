import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.functions.text import normalised
from lodeworks.llm import decontam

ITEM = "Quale strumento apre Bribequelta, durante l'inverno a Miteltia? Quante volte Pratrabrala Corzanerzia ripete: entro la scadenza"


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, doc_id int")


def truth(docs, items, n=12):
    found = set()
    for d, t in docs:
        hay = f" {normalised(t)} "
        for i, s in items:
            if any(f" {g} " in hay for g in decontam.grams(normalised(s).split(), n)):
                found.add((d, i))
    return found


WORDS = ITEM.split(" ")
DOCS = [
    (1, "Prima. " + ITEM.upper() + " Dopo."),
    (2, "inizio " + " ".join(WORDS[3:15]) + " fine"),
    (3, "inizio " + " ".join(WORDS[3:13]) + " fine"),
    (4, None),
    (5, ""),
    (6, " ".join(WORDS[:9]) + " altro " + " ".join(WORDS[9:])),
    (7, "parola " * 30_000 + ITEM),
    (1, "Prima. " + ITEM.upper() + " Dopo."),
]
ITEMS = [(10, ITEM), (11, "prima frase. " + " ".join(WORDS[2:])), (12, None), (13, "corto"), (14, "x" * 5000), (10, ITEM)]


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_leaks(spark, most):
    docs, items = tables(spark, DOCS, ITEMS)
    rows = [tuple(r) for r in decontam.leaks(docs, items, max_broadcast=most).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == truth(DOCS, ITEMS)
    assert {d for d, _ in rows} == {1, 2, 7}


@pytest.mark.parametrize("most", [4_000_000, -1])
def test_empty(spark, most):
    docs, items = tables(spark, DOCS, [])
    assert decontam.leaks(docs, items, max_broadcast=most).collect() == []
    docs, items = tables(spark, [], ITEMS)
    assert decontam.leaks(docs, items, max_broadcast=most).collect() == []


def test_cleaned(spark):
    docs, items = tables(spark, [(1, "Prima di tutto. " + ITEM.replace("Quante", "Quànte") + " Poi altre " + "parole " * 30), (2, ITEM), (3, "niente")], ITEMS)
    rows = {r["doc_id"]: r for r in decontam.cleaned(docs, items).collect()}
    assert set(rows) == {1, 2} and rows[2]["dropped"] and rows[2]["text"] is None
    assert rows[1]["text"].startswith("Prima di tutto.  Poi altre parole") and not rows[1]["dropped"] and rows[1]["removed_words"] == len(normalised(ITEM).split())


MIXED = [*DOCS, (8, "prima " + " ".join(WORDS[:6]) + " \u0301 " + " ".join(WORDS[6:]) + " dopo"), (9, "İİ ΑΣ'Α " + ITEM + " İ ΑΣ"), (None, ITEM), (10, ITEM.replace(" ", "-\u0308-"))]


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_cleaned_and_leaks_agree(spark, most):
    docs, items = tables(spark, MIXED, ITEMS)
    rows = [tuple(r) for r in decontam.cleaned(docs, items, max_broadcast=most).collect()]
    assert len(rows) == len(set(rows)) and {r[0] for r in rows} == {r[0] for r in decontam.leaks(docs, items, max_broadcast=most).collect()} == {1, 2, 7, 8, 9, 10, None}
    texts = {r[0]: r[1] for r in rows}
    assert texts[8] == "prima  dopo" if texts[8] else True
    again, _ = tables(spark, [(d, t) for d, t in texts.items()], [])
    assert decontam.leaks(again, items, max_broadcast=most).collect() == []


def test_both_ways_clean_alike(spark):
    docs, items = tables(spark, MIXED, ITEMS)
    one, two = ({tuple(r) for r in decontam.cleaned(docs, items, drop_share=1.0, max_broadcast=most).collect()} for most in (4_000_000, 10))
    assert one == two and all(t is not None for _, t, _, _ in one)


@given(st.text(max_size=60))
@settings(max_examples=500, deadline=None)
def test_spans_are_the_normalised_words(text):
    words, places = decontam.spans(text)
    assert words == normalised(text).split()
    assert all(a < b <= len(text) for a, b in places) and all(b <= c for (_, b), (c, _) in zip(places, places[1:]))


def test_equal_hashes_of_other_words_are_no_hits(monkeypatch):
    monkeypatch.setattr(decontam.xxhash, "xxh64_intdigest", lambda w: 7)
    scanner = decontam.Scanner([(1, ITEM)], 12)
    other = [f"w{i}" for i in range(40)]
    assert list(scanner.hits([other])) == [] and {i for _, _, i in scanner.hits([normalised(ITEM).split()])} == {1}
