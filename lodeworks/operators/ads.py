"""Grouped statistics and first-wins deduplication of classified ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in the price column where there is no price.
NO_PRICE = ("Contatta l'utente", "prices")


def price(column: str) -> Column:
    """An Italian price as a number: the last two characters off, points group thousands, the comma is decimal; else null."""
    cut = F.expr(f"left(`{column}`, greatest(length(`{column}`) - 2, 0))")
    return F.replace(F.replace(cut, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def average_price(ads: DataFrame) -> DataFrame:
    """(location, ads, avg_price) over ads with a price; places without one have no row."""
    priced = ads.select(F.col("locations").alias("location"), "prices").filter(F.col("prices").isNotNull() & ~F.col("prices").isin(*NO_PRICE))
    priced = priced.withColumn("price", price("prices")).filter("price IS NOT NULL AND location IS NOT NULL")
    return priced.groupBy("location").agg(F.count(F.lit(1)).alias("ads"), F.round(F.avg("price"), 4).alias("avg_price"))


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, nulls first; combined before the shuffle, so a key of many rows is no burden.

    Rows with a null key are left out.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    ranked = F.struct(*(F.struct(F.col(c).isNotNull().alias("set"), F.col(c).alias("value")).alias(f"o{i}") for i, c in enumerate([*order, *rest])))
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ranked).alias("__first"))
    return first.select(key, *(F.col(f"__first.o{i}.value").alias(c) for i, c in enumerate([*order, *rest]))).select(*rows.columns)
