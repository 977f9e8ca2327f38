"""Lloyd iterations over DataFrames: k-means, k-median and their versions with z outliers left out."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.functions.distance import Point
from robustclust.functions.ranks import hash_uniform
from robustclust.operators import costs, joins, kernels, sampling
from robustclust.sources.points import NotFittedError, validate, weighted


def step(points: DataFrame, centers: list[Point], z: int = 0, median: bool = False) -> DataFrame:
    """center, pos, value: one assignment and update."""
    near = costs.mark_outliers(points, centers, z) if z else joins.assign(points, centers)
    return costs.median_update(near) if median else costs.mean_update(near)


def iterate(points: DataFrame, centers: list[Point], z: int = 0, median: bool = False, most: int = kernels.MOST_ITERATIONS, tolerance: float = kernels.TOLERANCE) -> list[list[float]]:
    """Centers after at most ``most`` rounds; lost clusters are refilled with the farthest rows at the end."""
    k = len(centers)
    for _ in range(most):
        new = costs.update_rows(step(points, centers, z, median))
        if not new:
            break
        moved = math.sqrt(sum((a - b) ** 2 for x, y in zip(new, centers, strict=False) for a, b in zip(x, y, strict=True))) if len(new) == len(centers) else math.inf
        centers = new
        if moved <= tolerance:
            break
    while len(centers) < k:
        rows = costs.farthest_rows(joins.assign(points, centers), z + 1).orderBy("dist", F.col("id").desc()).limit(1).select("features", "dist").collect()
        if not rows or not rows[0]["dist"]:
            break
        centers = [*centers, list(rows[0]["features"])]
    return centers


def seeded(points: DataFrame, k: int, power: int, seed: int = 0, first: int | None = None) -> tuple[list[int], list[list[float]]]:
    """(drawn ids, their features) of k-means++ or k-median++ by hash draws: the first uniform, the rest by weight times
    distance to the power."""
    rows = weighted(points)
    if first is None:
        start = rows.withColumn("_u", hash_uniform(seed, "id")).orderBy("_u", "id").limit(1).select("id").collect()
        first = start[0]["id"]
    ids, centers = [first], joins.centers_of(points, [first])
    for i in range(1, k):
        mass = joins.assign(rows, centers).withColumn("_m", F.greatest("weight", F.lit(0.0)) * F.pow("dist", F.lit(float(power))))
        got = sampling.by_weight(mass, "_m", 1, seed + i).collect()
        if not got:
            break
        ids.append(got[0]["id"])
        centers = [*centers, *joins.centers_of(points, ids[-1:])]
    return ids, centers


def hashed_start(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    rows = points.withColumn("_u", hash_uniform(seed, "id")).orderBy("_u", "id").limit(k).select("features").collect()
    return [list(r["features"]) for r in rows]


@dataclass
class LloydModel:
    """Fitted centers; ``transform`` assigns, ``cost`` scores any point set."""

    n_clusters: int
    n_outliers: int = 0
    median: bool = False
    init: str | list = "++"
    seed: int = 0
    max_iter: int = kernels.MOST_ITERATIONS
    centers: list[list[float]] | None = None

    def fit(self, points: DataFrame) -> LloydModel:
        validate(points)
        points = points.cache()
        if not isinstance(self.init, str):
            start = [list(map(float, c)) for c in self.init]
        elif self.init == "random":
            start = hashed_start(points, self.n_clusters, self.seed)
        else:
            start = seeded(points, self.n_clusters, 1 if self.median else 2, self.seed)[1]
        self.centers = iterate(points, start, self.n_outliers, self.median, self.max_iter)
        points.unpersist()
        return self

    def _fitted(self) -> list[list[float]]:
        if self.centers is None:
            raise NotFittedError("fit the model first")
        return self.centers

    def transform(self, points: DataFrame) -> DataFrame:
        return joins.assign(points, self._fitted())

    def predict(self, points: DataFrame) -> DataFrame:
        return self.transform(points).select("id", "center")

    def cost(self, points: DataFrame, remove_outliers: int | None = None) -> float:
        gone = self.n_outliers if remove_outliers is None else int(remove_outliers)
        return costs.cost_without(points, self._fitted(), gone, 1 if self.median else 2).first()["cost"]


def KMeans(n_clusters: int, init="++", seed: int = 0) -> LloydModel:
    return LloydModel(n_clusters, 0, False, init, seed)


def KZMeans(n_clusters: int, n_outliers: int, init="random", seed: int = 0) -> LloydModel:
    return LloydModel(n_clusters, n_outliers, False, init, seed)


def KMedian(n_clusters: int, init="++", seed: int = 0) -> LloydModel:
    return LloydModel(n_clusters, 0, True, init, seed)


def KZMedian(n_clusters: int, n_outliers: int, init="random", seed: int = 0) -> LloydModel:
    return LloydModel(n_clusters, n_outliers, True, init, seed)
