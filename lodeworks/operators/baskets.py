"""Frequency counting over interaction logs: plays, baskets, postings, top tracks and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.tables import non_empty


def play_counts(log: DataFrame, least: int = 20, user: str = "userid", track: str = "traid") -> DataFrame:
    """(user, track, plays) of pairs with at least `least` plays; null and blank keys are left out."""
    keyed = log.select(F.trim(user).alias("user"), F.trim(track).alias("track")).filter(non_empty(F.col("user")) & non_empty(F.col("track")))
    return keyed.groupBy("user", "track").agg(F.count(F.lit(1)).alias("plays")).filter(F.col("plays") >= least)


def baskets(counts: DataFrame) -> DataFrame:
    """(user, tracks): each user's different tracks in order, joined by spaces.

    A basket is one row, as its form demands: a task holds all tracks of a
    user at once. postings() has the same content in long form.
    """
    return counts.groupBy("user").agg(F.array_join(F.array_sort(F.collect_list("track")), " ").alias("tracks"))


def postings(counts: DataFrame) -> DataFrame:
    """(track, user) in long form: one row for each user of a track, in place."""
    return counts.select("track", "user")


def track_users(counts: DataFrame) -> DataFrame:
    return counts.groupBy("track").agg(F.count(F.lit(1)).alias("users"))


def top_tracks(users: DataFrame, k: int = 20) -> DataFrame:
    """The k tracks of most users, ties to the smaller track."""
    return users.orderBy(F.desc("users"), "track").limit(k)


def top_pairs(top: DataFrame, k: int = 10) -> DataFrame:
    """(track_a, track_b, score) of the k best pairs of at most a few dozen tracks.

    The score is the sum of both tracks' users, as in the system this one
    replaces. The pairs are cut out of one ordered list, so no join is needed.
    """
    ordered = top.agg(F.array_sort(F.collect_list(F.struct("track", "users"))).alias("all"))  # the top list, of fixed length
    paired = ordered.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    scored = paired.select(F.col("a.track").alias("track_a"), F.col("b.track").alias("track_b"), (F.col("a.users") + F.col("b.users")).alias("score"))
    return scored.orderBy(F.desc("score"), "track_a", "track_b").limit(k)
