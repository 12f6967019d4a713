"""Farthest-first k-means, agreement with known clusters, and SVD reduction.

Points are (id, vector) rows; the driver holds k centroids and d x d sums only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.hashing import MIX, mixed
from lodeworks.session import materialize


def synthetic_points(spark: SparkSession, k: int, n: int, d: int, seed: int = 1) -> DataFrame:
    """(id, vector, label): k * n points, a one-hot part of k places for id mod k, then d normal values of deviation sqrt(1 / k).

    Each value follows from the seed, the id and its place alone, so a task
    run again, or another partitioning, gives the same points.
    """

    def points(batches):
        places = np.arange(d, dtype=np.uint64)
        for batch in batches:
            ids = batch["id"].to_numpy()
            one = mixed(mixed(ids.astype(np.uint64)[:, None] + np.uint64(seed) * MIX) + places * MIX)
            u, v = (one >> np.uint64(11)).astype(np.float64), (mixed(one + MIX) >> np.uint64(11)).astype(np.float64)
            normal = np.sqrt(-2 * np.log((u + 1) / 2**53)) * np.cos(2 * np.pi * v / 2**53) * (1 / k) ** 0.5
            hot = np.zeros((len(ids), k))
            hot[np.arange(len(ids)), ids % k] = 1.0
            yield pd.DataFrame({"id": ids, "vector": list(np.hstack([hot, normal])), "label": (ids % k).astype(np.int32)})

    return spark.range(k * n).mapInPandas(points, "id bigint, vector array<double>, label int")


def seeds(points: DataFrame, ids: list[int]) -> np.ndarray:
    rows = {r["id"]: r["vector"] for r in points.filter(F.col("id").isin(ids)).collect()}
    return np.array([rows[i] for i in ids if i in rows], dtype=np.float64)


def squared_distance(vector: Column, center: np.ndarray) -> Column:
    each = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in center)), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, a column a center."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, vector, cluster, distance): the nearest center, the first of equal ones, and its squared distance."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))

    @F.pandas_udf("cluster int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, shared.value.shape[1]))
        gaps = _gaps(x, shared.value)
        return pd.DataFrame({"cluster": gaps.argmin(axis=1).astype("int32"), "distance": gaps.min(axis=1)})

    return points.withColumn("__near", nearest("vector")).select("id", "vector", "__near.cluster", "__near.distance")


def means(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, mean): summed per batch before the shuffle, so a cluster may hold any number of points."""

    def sums(batches):
        for batch in batches:
            if len(batch):
                x, near = np.stack(batch["vector"].to_numpy()).astype(np.float64), batch["cluster"].to_numpy()
                found, at = np.unique(near, return_inverse=True)
                total = np.zeros((len(found), x.shape[1] + 1))
                np.add.at(total, at, np.column_stack([x, np.ones(len(x))]))
                yield pd.DataFrame({"cluster": found, "row": list(total[:, :-1]), "n": total[:, -1]})

    parts = assigned.select("cluster", "vector").mapInPandas(sums, "cluster int, row array<double>, n double")
    return parts.select("cluster", "n", F.posexplode("row").alias("dim", "x")).groupBy("cluster", "dim").agg((F.sum("x") / F.sum("n")).alias("mean"))


def _pass(points: DataFrame, centers: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(the means of the points nearest to each center, the number of points that had another center before), summed per batch before anything is sent."""
    k, d = centers.shape
    shared = points.sparkSession.sparkContext.broadcast((centers, before))

    def sums(batches):
        now, then = shared.value
        total = np.zeros((k, d + 2))  # the last two places: points, changed points
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                near = _gaps(x, now).argmin(axis=1)
                other = np.ones(len(x)) if then is None else near != _gaps(x, then).argmin(axis=1)
                np.add.at(total, near, np.column_stack([x, np.ones(len(x)), other]))
        yield pd.DataFrame({"cluster": np.arange(k), "row": list(total)})

    parts = points.select("vector").mapInPandas(sums, "cluster int, row array<double>")
    cells = parts.select("cluster", F.posexplode("row").alias("dim", "v")).groupBy("cluster", "dim").agg(F.sum("v").alias("v")).collect()  # k * (d + 2) numbers
    shared.destroy()
    total = np.zeros((k, d + 2))
    for c in cells:
        total[c["cluster"], c["dim"]] = c["v"]
    new, held = centers.copy(), total[:, d] > 0  # a cluster without points keeps its center
    new[held] = total[held, :d] / total[held, d : d + 1]
    return new, int(total[:, d + 1].sum())


def kmeans(points: DataFrame, centers: np.ndarray, iterations: int = 10_000) -> tuple[DataFrame, np.ndarray]:
    """(assignment, centers) once no point changes its center; raises where that takes more than the given number of passes.

    The assignment tells the end, since sums of doubles differ in their last
    bits by the order in which partitions arrive: of equal assignments the
    centers are equal, but the sums need not be.
    """
    if not len(centers):
        return assign(points, centers), centers
    points, before = materialize(points.select("id", "vector"), "kmeans-points"), None  # read once a pass
    for _ in range(iterations):
        new, changed = _pass(points, centers, before)
        if not changed:
            return assign(points, centers), centers
        before, centers = centers, new
    raise RuntimeError(f"k-means: {changed} points still changed their center in pass {iterations}")


def farthest_first(points: DataFrame, k: int, first: int) -> list[int]:
    """ids of k points: the given one, then again and again the point farthest from those chosen, ties to the smaller id."""
    chosen = [first]
    near = points.withColumn("gap", squared_distance(F.col("vector"), seeds(points, [first])[0]))
    while len(chosen) < k:
        far = near.agg(F.max(F.struct("gap", (-F.col("id")).alias("less"))).alias("m")).first()["m"]
        chosen.append(-far["less"])
        near = near.withColumn("gap", F.least("gap", squared_distance(F.col("vector"), seeds(points, [chosen[-1]])[0])))
        if len(chosen) % 8 == 0:
            near = materialize(near, "farthest-first")
    return chosen


def agreement(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, jaccard): for each known cluster its greatest Jaccard similarity with a found one."""
    cells = assigned.select("id", "cluster").join(truth.select("id", "label"), "id").groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("both"))
    cells = materialize(cells, "agreement")
    found = cells.groupBy("cluster").agg(F.sum("both").alias("found"))
    known = cells.groupBy("label").agg(F.sum("both").alias("known"))
    scored = cells.join(found, "cluster").join(known, "label").withColumn("j", F.col("both") / (F.col("found") + F.col("known") - F.col("both")))
    return scored.groupBy("label").agg(F.round(F.max("j"), 6).alias("jaccard"))


def gram(points: DataFrame, d: int) -> np.ndarray:
    """The d x d matrix of the points' inner products, summed per batch before anything is sent."""

    def sums(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"dim": np.arange(d), "row": list(total)})

    parts = points.select("vector").mapInPandas(sums, "dim int, row array<double>")
    cells = parts.select("dim", F.posexplode("row").alias("j", "v")).groupBy("dim", "j").agg(F.sum("v").alias("v")).collect()  # d * d numbers
    out = np.zeros((d, d))
    for c in cells:
        out[c["dim"], c["j"]] = c["v"]
    return out


def _axes(points: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(d x m axes, m singular values) in falling order, each axis' greatest loading positive; None without points."""
    first = points.select(F.size("vector").alias("d")).first()
    if first is None:
        return None
    values, axes = np.linalg.eigh(gram(points, first["d"]))
    order = values.argsort()[::-1][:m]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    return axes, np.sqrt(np.maximum(values[order], 0))


def _times(points: DataFrame, matrix: np.ndarray, name: str) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("array<double>")
    def product(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_numpy()).astype(np.float64) @ shared.value)) if len(vectors) else vectors

    return points.select("id", product("vector").alias(name))


def svd(points: DataFrame, m: int) -> tuple[DataFrame, np.ndarray]:
    """((id, reduced), singular values): the points' first m coordinates U * S, not centered."""
    found = _axes(points, m)
    if found is None:
        return points.select("id", F.array().cast("array<double>").alias("reduced")), np.zeros(0)
    return _times(points, found[0], "reduced"), found[1]


def reconstructed(points: DataFrame, m: int) -> DataFrame:
    """(id, vector): the points at their full width out of the m greatest singular values."""
    found = _axes(points, m)
    return points.select("id", "vector") if found is None else _times(points, found[0] @ found[0].T, "vector")


def without_hot_scale(points: DataFrame, k: int) -> DataFrame:
    """Synthetic points with the one-hot part divided by the deviation sqrt(1 / k), as before their reduction."""
    return points.withColumn("vector", F.transform("vector", lambda x, i: F.when(i < k, x / F.lit((1 / k) ** 0.5)).otherwise(x)))
