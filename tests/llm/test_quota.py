from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import quota

SONGS = "idx bigint, genre string, lyrics string, bin int, key string"
TARGETS = "set_id int, genre string, target_pct int, min_rows int, sample_rows int, available bigint"


def songs(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SONGS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], TARGETS)


def test_largest_remainder():
    assert quota.allocate(10, [50, 30, 20], [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert quota.allocate(10, [34, 33, 33], [0, 0, 0], [99, 99, 99]) == [4, 3, 3]
    assert quota.allocate(10, [90, 10], [0, 4], [99, 99]) == [6, 4]
    assert quota.allocate(10, [90, 10], [0, 0], [3, 99]) == [3, 7]
    assert quota.allocate(10, [50, 50], [0, 0], [2, 3]) == [2, 3]
    assert quota.allocate(0, [50, 50], [0, 0], [2, 3]) == [0, 0] and quota.allocate(5, [], [], []) == []
    assert quota.allocate(5, [0, 0], [1, 0], [9, 9]) == [1, 0]


@given(st.integers(0, 200), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40), st.integers(0, 80)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_quotas_keep_their_bounds(total, parts):
    shares, floors, caps = map(list, zip(*parts))
    got = quota.allocate(total, shares, floors, caps)
    low = [min(f, c) for f, c in zip(floors, caps)]
    assert all(lo <= q <= c for q, lo, c in zip(got, low, caps))
    if sum(low) <= total <= sum(c for c, s in zip(caps, shares) if s):
        assert sum(got) == total
    free = [i for i in range(len(parts)) if low[i] < got[i] < caps[i] and shares[i]]
    for i in free:  # the unbound ones share in proportion, to a row
        for j in free:
            assert abs(Fraction(got[i], shares[i]) - Fraction(got[j], shares[j])) <= Fraction(1, shares[i]) + Fraction(1, shares[j])


ROWS = [(i, "Rock" if i % 3 else "hip hop", "words " * 5) for i in range(300)] + [(5, "Rock", "words " * 5), (None, "Rock", "words " * 5), (400, "Rock", "  short \n"), (401, None, "words " * 5), (402, "R&B", None)]


def test_report(spark):
    report = quota.quota_report(quota.eligible(songs(spark, ROWS)), targets(spark, [(1, "ROCK ", 60, None, 50), (1, "Hip-Hop", 30, 120, 50), (1, "Ska", 10, 0, 50), (1, "Ska", 10, 0, 50), (2, None, None, None, 10)]))
    got = {(r["set_id"], r["genre"]): (r["needed"], r["available"], r["quota"], r["shortfall"], r["unmet"], r["overdrawn"]) for r in report.collect()}
    assert got == {(1, "ROCK "): (30, 200, 0, 0, 30, 50), (1, "Hip-Hop"): (120, 100, 100, 20, 20, 50), (1, "Ska"): (5, 0, 0, 5, 5, 50), (2, None): (0, 0, 0, 0, 0, 0)}


def test_floors_that_crowd_out_others_are_reported(spark):
    many = [(i, "Rock" if i % 2 else "Jazz", "words " * 5) for i in range(2000)]
    wanted = [(1, "Rock", 90, None, 100), (1, "Jazz", 10, 50, 100), (2, "Rock", 50, 20, 10), (2, "Jazz", 50, 20, 10)]
    report = quota.quota_report(quota.eligible(songs(spark, many)), targets(spark, wanted))
    got = {(r["set_id"], r["genre"]): (r["needed"], r["quota"], r["shortfall"], r["unmet"], r["overdrawn"]) for r in report.collect()}
    assert got == {(1, "Rock"): (90, 50, 0, 40, 0), (1, "Jazz"): (50, 50, 0, 0, 0), (2, "Rock"): (20, 20, 0, 0, 30), (2, "Jazz"): (20, 20, 0, 0, 30)}


def test_sample_takes_the_smallest_keys(spark, monkeypatch):
    monkeypatch.setattr(quota, "BINS_LOG2", 3)
    sample, report = quota.sample_by_targets(songs(spark, ROWS), targets(spark, [(1, "Rock", 70, 0, 60), (1, "Hip-Hop", 30, 0, 60), (2, "rock", 100, 0, 500)]))
    rows = [tuple(r) for r in sample.collect()]
    assert len(rows) == len(set(rows))
    counts = {}
    for s, c, _ in rows:
        counts[s, c] = counts.get((s, c), 0) + 1
    assert counts == {(1, "rock"): 42, (1, "hiphop"): 18, (2, "rock"): 200}
    again, _ = quota.sample_by_targets(songs(spark, ROWS).repartition(7), targets(spark, [(1, "Rock", 70, 0, 60), (1, "Hip-Hop", 30, 0, 60), (2, "rock", 100, 0, 500)]))
    assert {tuple(r) for r in again.collect()} == set(rows)
    monkeypatch.setattr(quota, "BINS_LOG2", 12)
    fine, _ = quota.sample_by_targets(songs(spark, ROWS), targets(spark, [(1, "Rock", 70, 0, 60), (1, "Hip-Hop", 30, 0, 60), (2, "rock", 100, 0, 500)]))
    assert {tuple(r) for r in fine.collect()} == set(rows)


def test_empty_tables(spark):
    sample, report = quota.sample_by_targets(songs(spark, []), targets(spark, [(1, "Rock", 100, 1, 5)]))
    assert sample.collect() == [] and report.first()["shortfall"] == 5
    sample, report = quota.sample_by_targets(songs(spark, ROWS), targets(spark, []))
    assert sample.collect() == [] and report.collect() == []
