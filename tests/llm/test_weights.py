import math
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import weights
from lodeworks.operators import skew

SCHEMA = "links string, titles string, descriptions string, term string, record int"


def ads(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)


ROWS = [("a", "casa bella", "casa  mare casa "), ("a", "casa bella", "casa  mare casa "), ("b", None, "casa monte"), ("c", "", None), ("d", "solo", ""), (None, "casa", "mare")]


def graph(texts, window):
    """Brute force: {term: (frequency, distinct neighbours)} of one record."""
    tf, near = Counter(), {}
    for text in texts:
        words = [w for w in (text or "").split(" ") if w]
        tf.update(words)
        for i, a in enumerate(words):
            near.setdefault(a, set()).update(b for b in words[max(0, i - window + 1) : i + window] if b != a)
    return {t: (n, len(near[t])) for t, n in tf.items()}


@given(st.lists(st.tuples(st.one_of(st.none(), st.text("ab  \u0301c", max_size=20)), st.one_of(st.none(), st.text("abc  ", max_size=20))), max_size=8), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_graphs_equal_brute_force(rows, window):
    record, term, tf, degree = weights.term_graphs([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], window)
    got = [{} for _ in rows]
    for r, t, n, d in zip(record.tolist(), term.to_pylist(), tf.tolist(), degree.tolist()):
        got[r][t] = (n, d)
    assert got == [graph(r, window) for r in rows]


@pytest.mark.parametrize("hot,chunk", [(1000, 4_000_000), (1, 1), (3, 10)])
def test_weights(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(weights, "HOT_TERMS", hot)
    monkeypatch.setattr(skew, "SMALL_TABLE", 0)
    monkeypatch.setattr(weights, "CHUNK", chunk)
    postings, records = weights.term_weights(ads(spark, ROWS), local="tf")
    got = {(r["link"], r["term"]): (r["tf"], r["df"], r["weight"]) for r in postings.join(records, "record").collect()}
    idf = lambda df: 1 + math.log10(4 / df)
    assert got["a", "casa"] == (3, 3, round((1 + math.log10(3)) * idf(3), 6))
    assert got["a", "bella"] == (1, 1, round(idf(1), 6)) and got[None, "mare"][1] == 2
    assert len(got) == 3 + 2 + 1 + 2
    degrees, records = weights.term_weights(ads(spark, ROWS))
    by = {(r["link"], r["term"]): (r["degree"], r["weight"]) for r in degrees.join(records, "record").collect()}
    assert by["a", "casa"] == (2, round((1 + math.log10(2)) * idf(3), 6)) and by["d", "solo"] == (0, round(idf(1), 6))


def test_top_terms(spark):
    got = {tuple(r) for r in weights.top_terms(*weights.term_weights(ads(spark, ROWS), local="tf", min_df=2)).collect()}
    assert got == {("a", "casa"), ("b", "casa"), (None, "mare")}
    ties = weights.top_terms(*weights.term_weights(ads(spark, [("x", "zeta alfa", None), ("y", "alfa zeta", "")]), local="tf", min_df=2))
    assert {tuple(r) for r in ties.collect()} == {("x", "alfa"), ("y", "alfa")}


def test_empty(spark):
    assert weights.top_terms(*weights.term_weights(ads(spark, []))).collect() == []


def test_very_long_text(spark):
    text = " ".join(f"t{i % 5000}" for i in range(50_000))
    postings, _ = weights.term_weights(ads(spark, [("a", text, None)]), local="tf")
    assert postings.count() == 5000 and postings.agg({"tf": "sum"}).first()[0] == 50_000
