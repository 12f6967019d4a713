"""Samples whose category shares follow given targets.

Quotas: largest remainder over the target percentages, with floors for small
categories and caps at what is available. Selection: the smallest hash keys
of each category, found through a histogram of the keys so that no category
is ever sorted in one task.

Defined results: songs with a null idx, null lyrics or lyrics of at most ten
characters are not eligible; repeated rows of an idx count once (of rows that
differ, the smallest category key holds); a null genre belongs to no category;
null percentages and minimum rows are 0; empty tables give empty results.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import longer_than
from lodeworks.session import materialize

#: Bins of the key histogram; a boundary bin holds about a 4096th of a category.
BINS_LOG2 = 12
MIN_CHARS = 10


def category(column: str) -> Column:
    """Lower-cased, only letters a-z and digits kept."""
    return F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]", "")


def eligible(songs: DataFrame) -> DataFrame:
    """(idx, category): one row for each idx that has lyrics."""
    usable = songs.filter(F.col("idx").isNotNull() & (longer_than(F.col("lyrics"), MIN_CHARS)))
    return usable.select("idx", category("genre").alias("category")).groupBy("idx").agg(F.min("category").alias("category"))


def allocate(total: int, shares: list[int], floors: list[int], caps: list[int]) -> list[int]:
    """Integers near total * share / sum of shares, each between its floor and cap, adding up to total where that can be.

    Largest remainder over the categories that are not yet bound; those it
    puts below a floor or above a cap are bound there, the side with the
    greater excess first, and the rest is allotted again.
    """
    quota: dict[int, int] = {}
    free = list(range(len(shares)))
    while free:
        rest = max(0, total - sum(quota.values()))
        weight = sum(shares[i] for i in free)
        exact = {i: Fraction(rest * shares[i], weight) if weight else Fraction(0) for i in free}
        part = {i: int(exact[i]) for i in free}
        left = rest - sum(part.values()) if weight else 0
        for i in sorted(free, key=lambda i: (part[i] - exact[i], i))[:left]:
            part[i] += 1
        low = [i for i in free if part[i] < min(floors[i], caps[i])]
        high = [i for i in free if part[i] > caps[i]]
        if not low and not high:
            return [quota[i] if i in quota else part[i] for i in range(len(shares))]
        if sum(min(floors[i], caps[i]) - part[i] for i in low) >= sum(part[i] - caps[i] for i in high):
            quota |= {i: min(floors[i], caps[i]) for i in low}
        else:
            quota |= {i: caps[i] for i in high}
        free = [i for i in free if i not in quota]
    return [quota[i] for i in range(len(shares))]


_REPORT = "set_id int, genre string, category string, sample_rows bigint, needed bigint, available bigint, quota bigint, shortfall bigint, unmet bigint, overdrawn bigint"


def quota_report(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: what it needs, what there is, the quota allotted and where the target is missed.

    needed is the larger of min_rows and sample_rows * target_pct / 100
    rounded up; shortfall is needed less available, unmet is needed less
    quota, both at least 0: the second also counts what the floors of other
    categories took away. overdrawn is by how many rows the quotas of the set
    exceed its sample, since floors are kept even where they add up to more.
    Targets of a set that name the same category share one quota, shown with
    each.
    """
    wanted = targets.select("set_id", "genre", category("genre").alias("category"), *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("target_pct", "min_rows", "sample_rows"))).distinct()
    counts = candidates.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    known = wanted.join(counts, "category", "left").withColumn("available", F.coalesce("available", F.lit(0)))

    def per_set(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["category", "genre"], na_position="first").reset_index(drop=True)
        total = int(pdf["sample_rows"].max())
        groups = pdf.fillna({"category": "\0"}).groupby("category", sort=True).agg(share=("target_pct", "sum"), floor=("min_rows", "max"), cap=("available", "max"))
        quotas = dict(zip(groups.index, allocate(total, *(groups[c].astype(int).tolist() for c in ("share", "floor", "cap")))))
        needed = [max(m, -(-s * p // 100)) for m, s, p in zip(pdf["min_rows"], pdf["sample_rows"], pdf["target_pct"])]
        out = pdf.assign(needed=needed, quota=[quotas[c] for c in pdf["category"].fillna("\0")])
        out["shortfall"] = (out["needed"] - out["available"]).clip(lower=0)
        out["unmet"] = (out["needed"] - out["quota"]).clip(lower=0)
        out["overdrawn"] = max(0, sum(quotas.values()) - total)
        return out[[c.split()[0] for c in _REPORT.split(", ")]]

    return known.groupBy("set_id").applyInPandas(per_set, _REPORT)  # a group is one set's list of targets


def quota_sample(candidates: DataFrame, report: DataFrame, seed: int = 7) -> DataFrame:
    """(set_id, category, idx): for each set the quota's smallest hash keys of each category, ties by idx."""
    quotas = report.filter("category IS NOT NULL AND quota > 0").select("set_id", "category", "quota").distinct()
    digest = F.md5(F.concat_ws("|", F.lit(seed), "set_id", "idx").cast("binary"))
    key = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")  # 60 bits
    keyed = candidates.join(quotas, "category").withColumn("key", key).withColumn("bin", F.shiftright("key", 60 - BINS_LOG2))
    group = ["set_id", "category"]
    histogram = keyed.groupBy(*group, "quota", "bin").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))  # at most 2**BINS_LOG2 rows a group
    edges = histogram.withColumn("before", running - F.col("n")).filter("before < quota").groupBy(*group).agg(F.max("bin").alias("edge"), F.max("before").alias("before"))
    near = keyed.join(edges, group).filter("bin <= edge")
    whole = near.filter("bin < edge").select(*group, "idx")
    order = Window.partitionBy(*group).orderBy("key", "idx")
    last = near.filter("bin = edge").withColumn("place", F.row_number().over(order)).filter("place <= quota - before").select(*group, "idx")
    return whole.unionByName(last)


def sample_by_targets(songs: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report); see quota_sample and quota_report."""
    candidates = materialize(eligible(songs), "quota-eligible")
    report = materialize(quota_report(candidates, targets), "quota-report")
    return quota_sample(candidates, report, seed), report
