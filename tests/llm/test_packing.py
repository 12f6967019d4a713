from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import packing
from lodeworks.llm.catalog import BPE, BPE_PATTERN

ITEMS, KINDS = "id bigint, size int, bin string", "container string, capacity_tokens int, size int"


@given(st.lists(st.integers(0, 20), max_size=40), st.integers(20, 30))
@settings(max_examples=300, deadline=None)
def test_best_fit_and_bound(sizes, capacity):
    place, rooms = packing.best_fit_decreasing(sizes, capacity)
    used = Counter()
    for p, s in zip(place, sizes):
        used[p] += s
    assert all(used[p] + rooms[p] == capacity and rooms[p] >= 0 for p in range(len(rooms)))
    assert packing.lower_bound(Counter(sizes), capacity) <= len(rooms)


def fewest(sizes, capacity):
    """Bins of an optimal packing, by search."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                put(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bound_is_below_the_optimum(sizes):
    assert packing.lower_bound(Counter(sizes), 12) <= fewest(sorted(sizes, reverse=True), 12)


def test_bound_sees_more_than_the_sum():
    assert packing.lower_bound({6: 4}, 10) == 4 and packing.lower_bound({4: 6}, 10) == 3 and packing.lower_bound({}, 10) == 0


def check(rows, items, capacities):
    for name, capacity in capacities:
        mine = [r for r in rows if r["container"] == name]
        used = Counter()
        for r in mine:
            used[r["bin"]] += r["size"]
        assert all(u <= capacity for u in used.values())
        pieces = Counter()
        for r in mine:
            pieces[r["id"]] += r["size"]
            assert r["piece"] == 0 or dict(items)[r["id"]] > capacity
        assert pieces == Counter({i: s or 0 for i, s in items}) or all(pieces[i] == (s or 0) for i, s in items)


def test_packing_exchanges_between_partitions(spark):
    items = [(i, (i * 37) % 90 + 1) for i in range(900)] + [(1000, 250), (1001, 100), (1002, 0), (1003, None)]
    kinds = [("small", 100), ("big", 250), ("none", 0), (None, 50)]
    df = spark.createDataFrame([(*x, "q") for x in items], ITEMS)
    containers = spark.createDataFrame([(*k, 1) for k in kinds], KINDS)
    packed = packing.pack(df, containers, per_partition=60)
    rows = packed.collect()
    check(rows, items, kinds[:2])
    assert {tuple(r) for r in packing.cut_items(packed).collect()} == {("small", 1000)}
    alone = packing.pack(df, containers, per_partition=60, exchange=False)
    proof = {r["container"]: r for r in packing.certificate(packed).collect()}
    plain = {r["container"]: r for r in packing.certificate(alone).collect()}
    for name in ("small", "big"):
        assert proof[name]["lower_bound"] <= proof[name]["bins"] <= min(plain[name]["bins"], proof[name]["lower_bound"] + 2)
    assert proof["small"]["bins"] < plain["small"]["bins"] or proof["small"]["bins"] == proof["small"]["lower_bound"]


def test_every_partition_has_its_bound(spark):
    items = [(i, (i * 37) % 90 + 1, "") for i in range(900)] + [(1000, 250, "")]
    packed = packing.pack(spark.createDataFrame(items, ITEMS), spark.createDataFrame([("small", 100, 1), ("big", 250, 1)], KINDS), per_partition=60)
    rows = packed.collect()
    parts = packing.partition_certificate(packed).collect()
    whole = {r["container"]: r for r in packing.certificate(packed).collect()}
    assert len(parts) > 4 and {(r["container"], r["partition"]) for r in parts if r["partition"] == "full"} == {("small", "full")}
    for name in ("small", "big"):
        assert sum(r["bins"] for r in parts if r["container"] == name) == whole[name]["bins"]
    for p in parts:
        mine = [r for r in rows if r["container"] == p["container"] and r["bin"].startswith(p["partition"] + "-")]
        assert p["bins"] == len({r["bin"] for r in mine}) and p["lower_bound"] == packing.lower_bound(Counter(r["size"] for r in mine), p["capacity"]) <= p["bins"]


def test_repeated_ids_and_empty_tables(spark):
    containers = spark.createDataFrame([("c", 10, 1)], KINDS)
    rows = packing.pack(spark.createDataFrame([(1, 7, ""), (1, 7, ""), (None, 3, "")], ITEMS), containers).collect()
    assert len(rows) == 3 and len({r["bin"] for r in rows}) == 2
    assert packing.pack(spark.createDataFrame([], ITEMS), containers).collect() == []
    assert packing.pack(spark.createDataFrame([(1, 7, "")], ITEMS), containers.limit(0)).collect() == []


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "due parole, e_3!", "x"), (2, None, "x"), (3, "", None)], "doc_id bigint, text string, size string")
    assert {tuple(r) for r in packing.sized_by_words(df).collect()} == {(1, 3), (2, 0), (3, 0)}
    got = dict(tuple(r) for r in packing.sized_by_bpe(df, BPE, BPE_PATTERN).collect())
    assert got[1] > 3 and got[2] == got[3] == 0
