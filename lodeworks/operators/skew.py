"""Aggregation and joins whose keys are very unevenly spread.

Heavy keys are found in one pass with a mergeable sketch of fixed size; it
only decides which keys are salted and never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.session import materialize, stored_bytes

#: Keys that the heavy-key sketch can report, and counters it keeps; its error is below rows / TRACKED.
REPORTED, TRACKED = 200, 4000
#: Keys that a join leaves in place: those with more than this part of all rows.
HOT_KEYS = 1000
#: Bytes of a stored (compressed) table of keys that is broadcast whole.
SMALL_TABLE = 4_000_000


@dataclass(frozen=True)
class Partial:
    """An aggregate in two stages: partial over (key, salt), merge over key."""

    name: str
    partial: Column
    merge: str = "sum"  # sum, min or max of the partial results

    def merged(self, column: str) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.merge](column)


def row_identity(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that are equal for rows equal in every column, nulls counted as values."""
    first = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(*first), F.xxhash64(F.lit("second"), *reversed(first))


def heavy_keys(df: DataFrame, fields: list[str], share: float) -> list[tuple[str, str]]:
    """(field, value) pairs that may hold at least share of all rows, by one sketch for each field.

    The result has at most REPORTED values a field whatever the data's size.
    Nulls are left out. An empty table gives none.
    """
    found = df.agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"approx_top_k(`{f}`, {REPORTED}, {TRACKED})").alias(f"k{i}") for i, f in enumerate(fields))).first()
    least = max(1, share * found["n"] * 0.5)
    return [(f, x["item"]) for i, f in enumerate(fields) for x in found[f"k{i}"] or [] if x["item"] is not None and x["count"] >= least]


def salted_aggregate(df: DataFrame, keys: list[str], aggregates: list[Partial], heavy: Column, spread: Column, salts: int = 64) -> DataFrame:
    """Two-stage aggregation: rows of heavy keys get one of `salts` salts, partials are merged by the original key.

    heavy: true for rows of a heavy key. spread: an integer that varies within
    a key (a row hash, so that a task run again gives the same salts). Null
    keys form a group of their own, as in groupBy. Rows with a null spread
    get salt 0.
    """
    salt = F.when(heavy, F.coalesce(F.pmod(spread, F.lit(salts)), F.lit(0)).cast("int")).otherwise(F.lit(0))
    partials = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*(a.partial.alias(a.name) for a in aggregates))
    return partials.groupBy(*keys).agg(*(a.merged(a.name).alias(a.name) for a in aggregates))


def with_sizes(rows: DataFrame, sizes: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner or left join of rows with sizes (one row a key, `count` its rows) that gathers no key which holds much in one task.

    total is the sum of count over all keys, or more. Keys of more than
    total / hot_keys rows are fewer than hot_keys whatever the data's size;
    they are broadcast and leave their rows in place, all others meet in a
    hash join. A table of sizes that takes up to SMALL_TABLE bytes where it is
    stored is broadcast whole. An inner join leaves out null keys. sizes should
    be a stored table, since both parts read it.
    """
    held = stored_bytes(sizes)
    if held is not None and held <= SMALL_TABLE:
        return rows.join(F.broadcast(sizes), keys, how)
    bar = max(1, total // hot_keys)
    hot, cold = sizes.filter(F.col(count) > bar), sizes.filter(F.col(count) <= bar)
    if hot.isEmpty():
        return rows.join(cold, keys, how)
    listed = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(listed, keys, "left_anti").join(cold, keys, how))


def clean_key(column: str) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", "")), F.lit(""))


def key_counts(log: DataFrame, fields: list[str], share: float = 0.01, salts: int = 64) -> DataFrame:
    """(field_name, key_value, plays): distinct rows of log for each cleaned value of each field.

    Exact repeats of a row (equal in every column of log) count once. Null and
    blank values have no row; the pseudo field '*' holds the number of all
    distinct rows. The one shuffle of row size goes by a row hash and is even;
    behind it the counting is salted for the keys that hold much.
    """
    one, two = row_identity(log)
    keyed = log.select(one.alias("__one"), two.alias("__two"), *(clean_key(f).alias(f) for f in fields))
    heavy = heavy_keys(keyed, fields, share)
    entries = [F.struct(F.lit("*").alias("field_name"), F.lit("").alias("key_value")), *(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in fields)]
    long = keyed.distinct().select("__one", F.explode(F.array(*entries)).alias("e")).select("__one", "e.*").filter("key_value IS NOT NULL")
    is_heavy = F.col("field_name") == "*"
    for f in fields:
        if values := [v for g, v in heavy if g == f]:
            is_heavy |= (F.col("field_name") == f) & F.col("key_value").isin(values)
    return salted_aggregate(long, ["field_name", "key_value"], [Partial("plays", F.count(F.lit(1)))], is_heavy, F.col("__one"), salts)


def plays_by_key(log: DataFrame, fields: list[str], share: float = 0.01) -> DataFrame:
    """key_counts with the share of all distinct rows and whether the key is a heavy one (more than `share`)."""
    counts = materialize(key_counts(log, fields, share), "key-counts")
    total = counts.filter("field_name = '*'").agg(F.max("plays")).first()[0] or 0
    return counts.filter("field_name <> '*'").select("field_name", "key_value", "plays", (F.col("plays") > F.lit(share) * total).alias("heavy"))
