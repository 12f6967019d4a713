"""The listening log as a stream: exact repeats dropped, plays counted by key and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.skew import clean_key, row_identity


def distinct_plays(stream: DataFrame, time: str = "loaded_at", delay: str = "30 days") -> DataFrame:
    """The stream without rows equal in every column that arrive within `delay` of each other; state is kept for that long only.

    Rows with a null time are left out, since no watermark covers them.
    """
    one, two = row_identity(stream)
    timed = stream.withColumn("__one", one).withColumn("__two", two).withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull())
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["__one", "__two"]).drop("__one", "__two")


def windowed_plays(stream: DataFrame, field: str, time: str = "loaded_at", window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(start, key_value, plays) of each window and cleaned key; blank keys have no row."""
    plays = distinct_plays(stream, time, delay).withColumn("key_value", clean_key(field)).filter("key_value IS NOT NULL")
    return plays.groupBy(F.window(time, window).alias("w"), "key_value").agg(F.count(F.lit(1)).alias("plays")).select("w.start", "key_value", "plays")
