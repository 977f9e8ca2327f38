"""Coresets and outlier summaries as objects: ``fit`` draws, the properties give what was drawn as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.functions.distance import Point
from robustclust.operators import coresets, costs, estimators, joins, sampling
from robustclust.sources.points import NotFittedError, validate, weighted


@dataclass(kw_only=True)
class _Drawn:
    seed: int = 0
    rows: DataFrame | None = field(default=None, repr=False)

    def _fitted(self) -> DataFrame:
        if self.rows is None:
            raise NotFittedError("fit the sampler first")
        return self.rows

    @property
    def samples(self) -> DataFrame:
        """machine_id, id, features of what was drawn."""
        return self._fitted().select("machine_id", "id", "features")

    @property
    def sample_weights(self) -> DataFrame:
        """machine_id, id, weight."""
        return self._fitted().select("machine_id", "id", "weight")

    @property
    def sample_indices(self) -> DataFrame:
        """machine_id, id."""
        return self._fitted().select("machine_id", "id")


def _sited(points: DataFrame) -> DataFrame:
    return points if "machine_id" in points.columns else points.withColumn("machine_id", F.lit(0))


@dataclass
class DistributedCoreset(_Drawn):
    """A sensitivity sample of all sites around their own centers, which join it with what their samples leave over.

    ``cost_func`` makes costs of distances (the power ``p`` where none is given); ``pre_clustering`` gives a site's centers.
    """

    sample_size: int = 100
    p: float = 2
    cost_func: Callable | None = None
    n_pre_clusters: int = 2
    pre_clustering: Callable = estimators.local_means

    def fit(self, points: DataFrame) -> DistributedCoreset:
        model = estimators.DistributedLp(n_pre_clusters=self.n_pre_clusters, p=self.p, cost_func=self.cost_func, pre_clustering=self.pre_clustering, seed=self.seed)
        rows, _, _, m = model._prepare(_sited(points))
        assigned, centers = model._pre_cluster(rows, m)
        self.rows = coresets.coreset(assigned, centers, self.sample_size, self.n_pre_clusters, self.seed)
        return self

    @property
    def center_rows(self) -> DataFrame:
        """machine_id, id (a center's index), features, weight of the local centers in the coreset."""
        return self._fitted().where("is_center").drop("is_center")


@dataclass
class Coreset(_Drawn):
    """A sensitivity sample around given centers, drawn with replacement by weighted cost; rows of no cost are never drawn."""

    sample_size: int = 100
    p: float = 2
    cost_func: Callable | None = None

    def fit(self, points: DataFrame, centers: list[Point]) -> Coreset:
        validate(points)
        near = joins.assign(weighted(points).withColumn("machine_id", F.lit(0)), centers)
        near = near.withColumn("cost", F.greatest("weight", F.lit(0.0)) * costs.raised(self.cost_func or self.p))
        chance = coresets.probabilities(near, 1.0 / self.sample_size).select("id", F.col("weight").alias("each"))
        times = sampling.by_weight(near, "cost", self.sample_size, self.seed).groupBy("id").agg(F.count("*").alias("times"))
        drawn = near.join(times, "id").join(chance, "id")
        self.rows = drawn.select("machine_id", "id", "features", (F.col("times") * F.col("weight") * F.col("each")).alias("weight"))
        return self


@dataclass
class DistributedSummary(_Drawn):
    """Outlier summaries of all sites, each with its share of the outliers (all of them against an adversary)."""

    n_clusters: int = 8
    n_outliers: int = 0
    alpha: float = 2
    beta: float = 0.45
    augmented: bool = False
    adversary: bool = False

    def fit(self, points: DataFrame) -> DistributedSummary:
        rows, _, _, m = estimators._Base(seed=self.seed)._prepare(_sited(points))
        self.rows = coresets.summarize_sites(rows, self.n_clusters, self.n_outliers, m, self.alpha, self.beta, self.augmented, self.adversary, self.seed)
        return self

    @property
    def left_over(self) -> DataFrame:
        """machine_id, id, features of the rows that no round covered: the summary's outlier candidates."""
        return self._fitted().where("round = -1").select("machine_id", "id", "features")


@dataclass
class SummaryOutliers(DistributedSummary):
    """The outlier summary of one point set; larger sets are split, and each part may hold all outliers."""

    def fit(self, points: DataFrame) -> SummaryOutliers:
        self.adversary = True
        super().fit(weighted(points).withColumn("machine_id", F.lit(0)))
        return self
