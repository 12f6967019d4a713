"""Joins that pair the rows of a key, whose cost stays even where a key holds much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize

#: Rows of a block.
BLOCK = 2000


def pairs_within(rows: DataFrame, key: str, ident: str, carry: list[str] | None = None, block: int | None = None) -> DataFrame:
    """(x, y, and each carried column as c_x and c_y): every two rows of the same key and different ident, once, in either order.

    A key of more than `block` (else BLOCK) rows is cut into blocks that meet two by two,
    each meeting a join key of its own, so its pairs are spread over as many
    tasks as they need and no task holds more than two blocks of it. ident
    should be unique within a key; null keys and idents pair with nothing.
    rows is read more than once and should be cheap to read.
    """
    carry, block = carry or [], block or BLOCK
    held = [f"__{c}" for c in carry]  # the carried columns may have any name
    kept = rows.filter(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(F.col(key).alias("k"), F.col(ident).alias("id"), *(F.col(c).alias(h) for c, h in zip(carry, held)))
    left, right = blocks_of_pairs(kept, held, block)
    met = left.join(right, ["k", "i", "j"]).filter("(i < j AND x <> y) OR x < y")
    return met.select("x", "y", *(F.col(f"{h}_{side}").alias(f"{c}_{side}") for c, h in zip(carry, held) for side in "xy"))


def blocks_of_pairs(kept: DataFrame, held: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the self-join of (k, id, held): each row with every meeting (i, j) of its block; keys of one row are dropped."""
    sizes = materialize(kept.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pair-sizes")
    known = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if known["most"] <= block:  # nothing to cut: rows alone in their key find no partner
        one = F.lit(0)
        return kept.select("k", one.alias("i"), one.alias("j"), F.col("id").alias("x"), *(F.col(h).alias(f"{h}_x") for h in held)), kept.select("k", one.alias("i"), one.alias("j"), F.col("id").alias("y"), *(F.col(h).alias(f"{h}_y") for h in held))
    cut = with_sizes(kept, sizes, ["k"], "n", known["rows"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = cut.withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).select("k", F.col("own").alias("i"), "j", F.col("id").alias("x"), *(F.col(h).alias(f"{h}_x") for h in held))
    right = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).select("k", "i", F.col("own").alias("j"), F.col("id").alias("y"), *(F.col(h).alias(f"{h}_y") for h in held))
    return left, right


def meet(left: DataFrame, right: DataFrame, key: str, block: int | None = None) -> DataFrame:
    """The inner join of two tables on one key that may hold much on either side.

    Where a key has more than `block` (else BLOCK) rows on a side, its rows there are cut
    into blocks, and each meets every block of the other side under a join key
    of its own. Both tables are read more than once and should be cheap to
    read; they share no other column. Null keys meet nothing.
    """
    block = block or BLOCK
    counts = [side.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "__nl"), (right, "__nr"))]
    most = [c.agg(F.coalesce(F.max(n), F.lit(0))).first()[0] for c, n in zip(counts, ("__nl", "__nr"))]
    if max(most) <= block:
        return left.join(right, key)
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = materialize(counts[0].join(counts[1], key).select(key, "__nl", "__nr"), "meet-sizes")
    totals = sizes.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("__nl", "__nr"))).first()
    sides = []
    for rows, mine, other, own, its in ((left, "__nl", "__nr", "__i", "__j"), (right, "__nr", "__nl", "__j", "__i")):
        placed = with_sizes(rows, sizes, [key], mine, totals[mine])
        place = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), cut(mine)).cast("int")  # equal rows stay together
        sides.append(placed.withColumn(own, place).withColumn(its, F.explode(F.sequence(F.lit(0), cut(other) - 1))).drop("__nl", "__nr"))
    return sides[0].join(sides[1], [key, "__i", "__j"]).drop("__i", "__j")
