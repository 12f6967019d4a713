"""Filling containers of fixed capacity: bound-certified repacking.

Items are dealt out over partitions in order of their size, and each partition is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the containers that
any packing of the partition needs: one that meets its bound is certified and
stays as it is. Where a gap is left, partitions release the items of their
containers with unused space, exchange them and are packed again. They do so in
groups of two, then of four and so on up to all, and a group whose containers
meet the bound of its items is certified and left out.

An item above the capacity is cut into full pieces, each a container of its
own, and a rest that is packed like any item. Defined results: items of size
0 or null take part with size 0 and go to the first container of their
partition (a partition of nothing else opens one); repeated ids are kept as
items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import word_count
from lodeworks.operators.songs import numbered
from lodeworks.session import materialize

#: Items of a first partition; large enough that its last open containers weigh little.
ITEMS_PER_PARTITION = 20_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(container of each item, room left in each container). Sizes are at most the capacity.

    Open containers are kept by room left, with a bit set of the rooms that
    occur, so the tightest fit costs a few machine words' work.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    room_of: list[int] = []
    place = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(room_of)
            room_of.append(capacity)
        place[i], room_of[at] = at, room - size
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return place, room_of


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing of the sizes needs, by dual feasible functions.

    f_e: sizes above capacity - e count as a whole container, those below e as
    nothing, the rest as they are; over the e that occur. u_k: size * (k + 1) /
    capacity rounded down, in k-ths, whole multiples kept. With both, the sum
    of the mapped sizes bounds the number of containers from below.
    """
    sizes = sorted((s, n) for s, n in counts.items() if s > 0)
    if not sizes:
        return int(any(counts.values()))
    best = -(-sum(s * n for s, n in sizes) // capacity)
    whole = total = 0
    prefix = [(0, 0)]
    for s, n in sizes:
        whole, total = whole + n, total + s * n
        prefix.append((whole, total))
    keys = [s for s, _ in sizes]
    for e in {s for s in keys if 2 * s <= capacity}:
        low, high = bisect_left(keys, e), bisect_right(keys, capacity - e)
        middle = prefix[high][1] - prefix[low][1]
        best = max(best, prefix[-1][0] - prefix[high][0] + -(-middle // capacity))
    for k in range(1, min(capacity, 24)):
        mapped = sum(n * (s * k if (s * (k + 1)) % capacity == 0 else (s * (k + 1) // capacity) * capacity) for s, n in sizes)
        best = max(best, -(-mapped // (k * capacity)))
    return best


_PACKED = "container string, capacity int, round int, slot int, id bigint, piece int, size int, bin int, room int, bins int, bound int"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _packed(items: DataFrame, round_no: int) -> DataFrame:
    """Pack each partition (container, slot); every row gets its bin, the bin's room and the partition's bins and bound. Stored."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True])
        capacity, sizes = int(pdf["capacity"].iat[0]), pdf["size"].astype(int).tolist()
        place, rooms = best_fit_decreasing(sizes, capacity)
        return pdf.assign(bin=place, room=[rooms[p] for p in place], bins=len(rooms), bound=lower_bound(Counter(sizes), capacity), round=round_no)[_NAMES]

    return materialize(items.groupBy("container", "slot").applyInPandas(one, _PACKED), "pack-round")


def _exchanged(packed: DataFrame, slots: int, per_partition: int) -> DataFrame:
    """The placement after partitions have exchanged what lies in bins with room, first two by two, then four by four and so on.

    A group of partitions takes part only if its bins exceed the bound of its
    own items; a certified group stays as it is. The released items are dealt
    out over as few partitions as they need and packed again, and the result
    is kept where it has fewer bins. Once all partitions are one group this
    goes on for as long as it saves bins. Full bins never move again.
    """
    group = ["container", "group"]
    sizes = materialize(packed.groupBy("container", "capacity", "slot", "size").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    loose, full = materialize(packed.filter("room > 0"), "pack-open"), packed.filter("room = 0")
    settled, level, saved = [full], 0, False
    counted = [materialize(full.groupBy("container", "slot").agg(F.count_distinct("bin").alias("bins")), "pack-full")]
    while 1 << level < slots or saved:
        level, saved = level + 1, False
        at = F.shiftright("slot", level).alias("group")
        bounds = _bounds(sizes.select("container", "capacity", at, "size", "n"), group, F.sum("n"))
        pool = loose.groupBy("container", at).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("round", "slot", "bin").alias("bins"), F.count_distinct("slot").alias("partitions"))
        fulls = reduce(DataFrame.unionByName, counted).groupBy("container", at).agg(F.sum("bins").alias("full"))
        known = pool.join(bounds, group).join(fulls, group, "left").filter((F.col("bins") + F.coalesce("full", F.lit(0)) > F.col("lower_bound")) & (F.col("partitions") > 1))
        slot_count = F.least(F.ceil(F.col("items") / per_partition), F.lit(1 << min(30, level))).cast("int")
        gaps = materialize(known.select(*group, "bins", slot_count.alias("k")), "pack-gaps")
        if gaps.isEmpty():
            continue
        met = loose.withColumn("group", at).join(gaps.drop("bins"), group)
        dealt = F.pmod(F.xxhash64("round", "slot", "bin", "id", "piece", F.lit(level)), F.col("k")).cast("int")
        again = _packed(met.select("container", "capacity", (F.shiftleft("group", level) + dealt).alias("slot"), "id", "piece", "size"), level)
        after = again.groupBy("container", at).agg(F.count_distinct("slot", "bin").alias("after"))
        better = materialize(gaps.join(after, group).filter("after < bins").select(*group), "pack-better")
        if better.isEmpty():
            continue
        saved = 1 << level >= slots
        taken = again.withColumn("group", at).join(better, group, "left_semi").drop("group")
        settled.append(taken.filter("room = 0"))
        counted.append(materialize(settled[-1].groupBy("container", "slot").agg(F.count_distinct("bin").alias("bins")), "pack-full"))
        kept = loose.withColumn("group", at).join(better, group, "left_anti").drop("group")
        loose = materialize(kept.unionByName(taken.filter("room > 0")), "pack-open")
    return reduce(DataFrame.unionByName, [*settled, loose])


def pack(items: DataFrame, containers: DataFrame, per_partition: int = ITEMS_PER_PARTITION, exchange: bool = True) -> DataFrame:
    """(container, capacity, id, piece, bin, size) for items (id, size) and containers (container, capacity_tokens).

    bin is unique within the container; the pieces of a cut item count from 0.
    Containers without a positive capacity take nothing. The kinds of
    containers are a stated list: each takes all items once.
    """
    kinds = containers.filter("container IS NOT NULL AND capacity_tokens > 0").select("container", "capacity_tokens").distinct().collect()
    known = materialize(items.select("id", F.coalesce(F.col("size"), F.lit(0)).cast("int").alias("size"), F.monotonically_increasing_id().alias("row")), "pack-items")
    slots = max(1, -(-known.count() // per_partition))
    if slots > 1:
        known = numbered(known, [F.col("size"), F.col("row")], "place")
        slot = F.pmod("place", F.lit(slots)).cast("int").alias("slot")  # every partition gets the like of every size
    else:
        slot = F.lit(0).alias("slot")
    kind = F.explode(F.array(*(F.struct(F.lit(k[0]).alias("container"), F.lit(k[1]).alias("capacity")) for k in kinds))) if kinds else F.explode(F.array().cast("array<struct<container:string,capacity:int>>"))
    each = known.select(slot, "id", "size", kind.alias("k")).select("slot", "id", "size", "k.*")
    cut = each.withColumn("whole", F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / F.col("capacity")).cast("int"))
    full = cut.filter("whole > 0").select("container", "capacity", "id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"), F.col("capacity").alias("size"))
    full = full.select("container", "capacity", "id", "piece", F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin"), "size")
    packed = _packed(cut.select("container", "capacity", "slot", "id", F.col("whole").alias("piece"), (F.col("size") - F.col("whole") * F.col("capacity")).cast("int").alias("size")), 0)
    if exchange and slots > 1:
        packed = _exchanged(packed, slots, per_partition)
    name = F.concat_ws("-", "round", "slot", F.col("bin"))
    return full.unionByName(packed.select("container", "capacity", "id", "piece", name.alias("bin"), "size"))


def cut_items(placement: DataFrame) -> DataFrame:
    """(container, id) of the items that exceed the capacity: those placed in more than one piece."""
    return placement.filter("piece > 0").select("container", "id").distinct()


def certificate(placement: DataFrame) -> DataFrame:
    """(container, capacity, bins, lower_bound, unused_tokens, unused_share) over the whole placement."""
    return _certified(placement, ["container"])


def partition_certificate(placement: DataFrame) -> DataFrame:
    """(container, partition, capacity, bins, lower_bound, unused_tokens, unused_share) of each partition by its own bound.

    A partition is named by the round and slot that packed its bins last; the
    full pieces of cut items are one of their own. A partition whose items of
    bins with room were exchanged is judged by the items that it kept.
    """
    return _certified(placement.withColumn("partition", F.regexp_extract("bin", r"^(full|\d+-\d+)-", 1)), ["container", "partition"])


def _bounds(pieces: DataFrame, by: list[str], count: Column | None = None) -> DataFrame:
    """(by, capacity, lower_bound) of the pieces of each group, each of them a row or standing for a count of rows."""
    histogram = pieces.groupBy(*by, "capacity", "size").agg((F.count(F.lit(1)) if count is None else count).alias("n"))  # at most capacity + 1 rows a group

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iat[0])
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in by}, "capacity": [capacity], "lower_bound": [lower_bound(dict(zip(pdf["size"].astype(int), pdf["n"].astype(int))), capacity)]})

    types = dict(pieces.dtypes)
    return histogram.groupBy(*by).applyInPandas(bound, "".join(f"`{c}` {types[c]}, " for c in by) + "capacity int, lower_bound bigint").select(*by, "lower_bound", "capacity")


def _certified(placement: DataFrame, by: list[str]) -> DataFrame:
    bins = placement.groupBy(*by, "bin").agg(F.sum("size").alias("used")).groupBy(*by).agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("used"))
    space = F.col("bins") * F.col("capacity")
    return _bounds(placement, by).join(bins, by).select(*by, "capacity", "bins", "lower_bound", (space - F.col("used")).alias("unused_tokens"), F.round((space - F.col("used")) / space, 6).alias("unused_share"))


def sized_by_words(documents: DataFrame) -> DataFrame:
    """(id, size): runs of letters, digits and underscores."""
    return documents.select(F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size"))


def sized_by_bpe(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(id, size): tokens of a byte-level BPE of the given splitting pattern, out of a file of base64 tokens and ranks that goes out with the job."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def sizes(batches):
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "size": [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(sizes, "id bigint, size bigint")
