"""Distributed estimators: sites report small summaries, the coordinator (the driver) solves on their union.

Points carry a machine_id; a site's rows are one group. Sites beyond ``local_data_size`` rows are split first, so no
task holds more than that, and only summaries reach the driver (their sizes are bounded by k, z, m and epsilon).
Algorithms that need no site's rows together (``WHOLE_SITES``) keep the sites they are given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.operators import coresets, costs, joins, kcenter, kernels, partition, sampling
from robustclust.sources.points import NotFittedError, validate, weighted


@dataclass
class _Base:
    n_clusters: int = 8
    n_outliers: int = 0
    epsilon: float = 0.1
    delta: float = 0.01
    seed: int = 0
    local_data_size: int = 10_000
    centers: np.ndarray | None = field(default=None, repr=False)
    communication_cost: int = 0
    opt: float | None = None

    def _prepare(self, points: DataFrame, split: bool = True) -> tuple[DataFrame, int, int, int]:
        """The weighted points with their numbers of rows, features and sites; ``split``: larger sites are split first."""
        d = validate(points)
        points = weighted(points)
        sizes = {r["machine_id"]: r["n"] for r in points.groupBy("machine_id").agg(F.count("*").alias("n")).collect()}  # one row a site
        if split and sizes and max(sizes.values()) > self.local_data_size:
            points = partition.split_sites(points, self.local_data_size)
            m = points.select("machine_id").distinct().count()
        else:
            m = len(sizes)
        return points.cache(), sum(sizes.values()), d, m

    def _few(self, points: DataFrame, n: int) -> bool:
        """With hardly more points than outliers the first few are the centers."""
        if n > (1 + self.epsilon) * self.n_outliers:
            return False
        rows = points.orderBy("machine_id", "id").limit(min(self.n_clusters, n)).select("features").collect()
        self.centers = np.array([r["features"] for r in rows], float)
        self.communication_cost = self.centers.size
        return True

    @property
    def cluster_centers(self) -> np.ndarray:
        if self.centers is None:
            raise NotFittedError("fit the model first")
        return self.centers

    def transform(self, points: DataFrame) -> DataFrame:
        return joins.assign(points, self.cluster_centers.tolist())


def _arrays(rows: list, features: str = "features", weight: str = "weight") -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[features] for r in rows], float), np.array([r[weight] for r in rows], float)


#: algorithms that send a fixed number of rows a site, found without holding a site in a task
WHOLE_SITES = ("moseley", "random", "random_charikar")


@dataclass
class DistributedKZCenter(_Base):
    """algorithm: auto, multiplicative, additive, moseley, random or random_charikar."""

    algorithm: str = "multiplicative"
    sample_size: int | None = None

    def fit(self, points: DataFrame) -> DistributedKZCenter:
        solvers = {
            "auto": self._auto,
            "multiplicative": self._multiplicative,
            "additive": self._additive,
            "moseley": self._moseley,
            "random": self._random,
            "random_charikar": self._random_charikar,
        }
        if self.algorithm not in solvers:
            raise ValueError(f"no algorithm {self.algorithm}")
        points, n, d, m = self._prepare(points, self.algorithm not in WHOLE_SITES)
        if n and not self._few(points, n):
            solvers[self.algorithm](points, n, d, m)
        points.unpersist()
        return self

    def _auto(self, points, n, d, m) -> None:
        (self._additive if self.n_outliers > self.epsilon * n else self._multiplicative)(points, n, d, m)

    def _reduce(self, x: np.ndarray, w: np.ndarray, z: float, dense: float = 2, remove: float = 4, guess: float | None = None) -> None:
        found, self.opt = kernels.charikar(x, self.n_clusters, z, w, max(self.delta, 1e-3), dense, remove, guess, seed=self.seed)
        self.centers = kernels.padded(found.centers, x, self.n_clusters)

    def _probe(self, points: DataFrame, r: float, m: int) -> tuple[int, float]:
        found = kcenter.covering(points, r, self.n_clusters, self.n_outliers, m, self.epsilon).select("machine_id", "balls", "covered").distinct()
        row = found.agg(F.sum("balls").alias("b"), F.sum("covered").alias("c")).first()
        return row["b"] or 0, row["c"] or 0.0

    def _multiplicative(self, points, n, d, m) -> None:
        """A binary search on the radius of a greedy covering of every site; the balls' centers are then clustered."""
        k, z = self.n_clusters, self.n_outliers
        high = joins.diameter_over_sites(points, joins.base_points(points, 10, self.seed)).first()["upper"]
        total = points.agg(F.sum("weight").alias("w")).first()["w"]
        most, need = k * m * (1 + 1 / self.epsilon), max(total - (1 + self.epsilon) * z, 1)
        low = 0.0
        while high > (1 + self.delta) * low and high > 1e-3:
            r = (low + high) / 2
            balls, covered = self._probe(points, r, m)
            low, high = (r, high) if balls > most or covered < need else (low, r)
        rows = kcenter.covering(points, high, k, z, m, self.epsilon).collect()
        x, w = _arrays(rows, "center", "mass")
        self.communication_cost = costs.communication(len(rows), d)
        self._reduce(x, w, (1 + self.epsilon) * z, guess=5 * high)

    def additive_size(self, n: int, d: int, m: int) -> int:
        k, z, e = self.n_clusters, self.n_outliers, self.epsilon
        s = k * d * np.log(1 / self.delta)
        s = max(m * k, s / e**2 * np.log(max(s / e, np.e)))
        return int(max(k + 1, min(m * (k + z) / 2, n / m, m * k * (1 + 1 / e), s)))

    def _additive(self, points, n, d, m) -> None:
        """Uniform samples, dealt to sites by size, are clustered with a proportional number of outliers."""
        t = self.sample_size or self.additive_size(n, d, m)
        shares = sampling.multinomial_shares(points, t, self.seed)
        rows = sampling.with_replacement(points, shares, self.seed).select("features").collect()  # about t rows
        x = np.array([r["features"] for r in rows], float)
        self.communication_cost = costs.communication(len(rows), d)
        self._reduce(x, np.ones(len(x)), self.n_outliers * t / n + self.epsilon * t / 2)

    def _moseley(self, points, n, d, m) -> None:
        """k + z farthest-first points of each site, with the number of rows nearest to each."""
        rows = kcenter.counted_picks(points, self.n_clusters + self.n_outliers, d)
        x, w = _arrays(rows)
        self.communication_cost = costs.communication(len(rows), d, len(rows))
        self._reduce(x, w, self.n_outliers, 5, 11)

    def _uniform(self, points, d) -> np.ndarray:
        rows = sampling.without_replacement(points, self.n_clusters + self.n_outliers, self.seed).orderBy("machine_id", "id").select("features").collect()
        self.communication_cost = costs.communication(len(rows), d)
        return np.array([r["features"] for r in rows], float)

    def _random(self, points, n, d, m) -> None:
        x = self._uniform(points, d)
        self.centers = x[np.random.default_rng(self.seed).choice(len(x), min(self.n_clusters, len(x)), replace=False)]

    def _random_charikar(self, points, n, d, m) -> None:
        x = self._uniform(points, d)
        self._reduce(x, np.ones(len(x)), self.n_outliers, 1, 3)

    def cost(self, points: DataFrame, remove_outliers: int | None = None) -> float:
        gone = int((1 + self.epsilon) * self.n_outliers) if remove_outliers is None else int(remove_outliers)
        return costs.center_cost(points, self.cluster_centers.tolist(), gone).first()["radius"]


Local = Callable[[np.ndarray, int, int, int], np.ndarray]


def local_means(x: np.ndarray, k: int, z: int, seed: int) -> np.ndarray:
    return kernels.lloyd(x, k, z=z, init="random" if z else "++", seed=seed)


def local_median(x: np.ndarray, k: int, z: int, seed: int) -> np.ndarray:
    return kernels.lloyd(x, k, z=z, center=kernels.weighted_median, init="random" if z else "++", seed=seed)


@dataclass
class DistributedKZLp(_Base):
    """(k,z)-clustering with distances to the power p: coresets for a grid of radius guesses, then min-max location.

    ``pre_clustering`` (points, k, z, seed) -> centers runs on every site and may be any callable.
    """

    p: float = 2
    #: what a distance costs, on arrays and on columns (``lambda d: d * d``); the power p where none is given
    cost_func: Callable | None = None
    #: (points, weights, k, z, seed) -> centers at the coordinator, instead of the min-max location or the local method
    central_solver: Callable | None = None
    n_pre_clusters: int = 2
    coreset_ratio: float = 10
    pre_clustering: Local = local_means
    radius_low: float = 0.1
    radius_high: float | None = None

    def fit(self, points: DataFrame) -> DistributedKZLp:
        points, n, d, m = self._prepare(points)
        if n and not self._few(points, n):
            limits = self._limits(points)
            assigned, centers = self._pre_cluster(points, m)
            size = self.coreset_size(n, d, len(limits))
            sets = self._coresets(assigned, centers, limits, size)
            self.communication_cost = sum(costs.communication(len(x), d, len(x) + 1) + 2 for x, _, _ in sets)
            self._solve(sets, limits)
        points.unpersist()
        return self

    def _limits(self, points: DataFrame) -> list[float | None]:
        high = self.radius_high or joins.diameter_over_sites(points, joins.base_points(points, 2, self.seed)).first()["upper"]
        if self.cost_func is None:
            return coresets.radius_grid(self.radius_low, high, self.epsilon, self.p)
        return [float(self.cost_func(r)) for r in coresets.radius_grid(self.radius_low, high, self.epsilon, 1)]

    def coreset_size(self, n: int, d: int, guesses: int) -> int:
        k = self.n_clusters
        return int(max(min((k * d + np.log(1 / self.delta)) / self.epsilon**2, n / (self.coreset_ratio * guesses)), 10 * k))

    def _pre_cluster(self, points: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
        """(machine_id, id, features, center, cost; machine_id, center, features) from one clustering of each site."""
        k, z, p, seed, local = self.n_pre_clusters, self.n_outliers // m, self.cost_func or self.p, self.seed, self.pre_clustering

        def run(site: pd.DataFrame) -> pd.DataFrame:
            site = site.sort_values("id")
            x, no = np.stack(site["features"]), int(site["machine_id"].iloc[0])
            c = local(x, k, z, seed + no)
            owner, d = kernels.nearest(x, c)
            rows = {"machine_id": no, "id": site["id"].to_numpy(), "features": list(x), "center": owner.astype(np.int32), "cost": kernels.raised(d, p), "is_center": False}
            heads = {"machine_id": no, "id": -1 - np.arange(len(c)), "features": list(c), "center": np.arange(len(c), dtype=np.int32), "cost": 0.0, "is_center": True}
            return pd.concat([pd.DataFrame(rows), pd.DataFrame(heads)])

        schema = "machine_id int, id long, features array<double>, center int, cost double, is_center boolean"
        both = points.select("machine_id", "id", "features").groupBy("machine_id").applyInPandas(run, schema).cache()
        return both.where("not is_center").drop("is_center"), both.where("is_center").select("machine_id", "center", "features")

    def _coresets(self, assigned: DataFrame, centers: DataFrame, limits: list[float | None], size: int) -> list:
        """(features, weights, whether sampled) of the coreset for each guess, brought to the coordinator in one job."""
        capped = coresets.capped_costs(assigned, [np.inf if v is None else v for v in limits])
        told: dict[int, list] = {}
        for r in coresets.coreset(capped, centers, size, self.n_pre_clusters, self.seed).collect():
            told.setdefault(r["guess_id"], []).append(r)
        out = []
        for i in range(len(limits)):
            rows = sorted(told.get(i, []), key=lambda r: (r["machine_id"], r["is_center"], r["id"]))
            out.append((*_arrays(rows), np.array([not r["is_center"] for r in rows], bool)))
        return out

    def _solve(self, sets, limits) -> None:
        if self.central_solver:  # on all coresets together: each guess's weights count an equal share
            x, w = np.concatenate([x for x, _, _ in sets]), np.concatenate([w for _, w, _ in sets]) / len(sets)
            self.centers = np.asarray(self.central_solver(x, w, self.n_clusters, self.n_outliers, self.seed), float)
            return
        sampled = np.unique(np.concatenate([x[s] for x, _, s in sets]), axis=0)
        open_, self.opt = kernels.minmax_facilities([x for x, _, _ in sets], [w for _, w, _ in sets], limits, sampled, self.n_clusters, (1 + self.epsilon) * self.n_outliers, self.cost_func or self.p)
        self.centers = sampled[open_]

    def cost(self, points: DataFrame, remove_outliers: int | None = None) -> float:
        gone = self.n_outliers if remove_outliers is None else int(remove_outliers)
        return costs.cost_without(points, self.cluster_centers.tolist(), gone, self.cost_func or self.p).first()["cost"]


def DistributedKZMeans(**options) -> DistributedKZLp:
    return DistributedKZLp(**{"p": 2, "pre_clustering": local_means} | options)


def DistributedKZMedian(**options) -> DistributedKZLp:
    return DistributedKZLp(**{"p": 1, "pre_clustering": local_median} | options)


@dataclass
class DistributedLp(DistributedKZLp):
    """Without outliers: a single coreset, and a weighted local method as the coordinator's solver."""

    def _limits(self, points: DataFrame) -> list[float | None]:
        return [None]

    def _solve(self, sets, limits) -> None:
        x, w, _ = sets[0]
        if self.central_solver:
            self.centers = np.asarray(self.central_solver(x, w, self.n_clusters, 0, self.seed), float)
            return
        center = kernels.weighted_mean if self.p == 2 else kernels.weighted_median
        self.centers = kernels.lloyd(x, self.n_clusters, w, center=center, seed=self.seed)


def BELDistributedKMeans(**options) -> DistributedLp:
    return DistributedLp(**{"p": 2, "pre_clustering": local_means} | options)


def BELDistributedKMedian(**options) -> DistributedLp:
    return DistributedLp(**{"p": 1, "pre_clustering": local_median} | options)


@dataclass
class CAZDistributed(_Base):
    """Outlier summaries of the sites, clustered by k-means-- or k-median-- at the coordinator."""

    median: bool = False
    alpha: float = 2
    beta: float = 0.45
    augmented: bool = False
    adversary: bool = False
    #: (points, weights, k, z, seed) -> centers at the coordinator, instead of the iterations without the z farthest rows
    central_solver: Callable | None = None
    #: what a distance costs; its square, or with ``median`` itself, where none is given
    cost_func: Callable | None = None

    def fit(self, points: DataFrame) -> CAZDistributed:
        points, n, d, m = self._prepare(points)
        if n and not self._few(points, n):
            rows = coresets.summarize_sites(points, self.n_clusters, self.n_outliers, m, self.alpha, self.beta, self.augmented, self.adversary, self.seed).orderBy("machine_id", "id").collect()
            x, w = _arrays(rows)
            self.communication_cost = costs.communication(len(rows), d, len(rows))
            center = kernels.weighted_median if self.median else kernels.weighted_mean
            if self.central_solver:
                self.centers = np.asarray(self.central_solver(x, w, self.n_clusters, self.n_outliers, self.seed), float)
            else:
                self.centers = kernels.lloyd(x, self.n_clusters, w, self.n_outliers, center, "random", self.seed)
        points.unpersist()
        return self

    def cost(self, points: DataFrame, remove_outliers: int | None = None) -> float:
        gone = self.n_outliers if remove_outliers is None else int(remove_outliers)
        return costs.cost_without(points, self.cluster_centers.tolist(), gone, self.cost_func or (1 if self.median else 2)).first()["cost"]


def CAZDistributedKZMeans(**options) -> CAZDistributed:
    return CAZDistributed(median=False, **options)


def CAZDistributedKZMedian(**options) -> CAZDistributed:
    return CAZDistributed(median=True, **options)


def marginal_costs(points: DataFrame, k: int, z: int) -> DataFrame:
    """machine_id, q, cost: what the q-th outlier of a site is worth, from one farthest-first run of k + z + 1 points."""
    picks = kcenter.farthest_first_sites(points, k + z + 1)
    grid = picks.where(F.col("pick") > k).select("machine_id", (F.col("pick") - k).alias("q"), F.col("dist").alias("cost"))
    zero = points.select("machine_id").distinct().select("machine_id", F.lit(0).alias("q"), F.lit(0.0).alias("cost"))
    return grid.unionByName(zero)


def hull_costs(grid: list[tuple[int, float]], z: int) -> list[float]:
    """Costs for every budget 0..z from the lower convex hull of some of them."""
    chain = kernels.lower_hull(grid)
    return np.interp(np.arange(z + 1), [q for q, _ in chain], [c for _, c in chain]).tolist()


def threshold(grid: DataFrame, z: int, m: int, rho: float) -> DataFrame:
    """cost: the (min(floor(rho z), m z) + 1)-th greatest cell of the grid."""
    if rho >= m:
        raise ValueError("rho must be below the number of sites")
    rank = min(int(rho * z), m * z) + 1
    return grid.orderBy(F.col("cost").desc(), "machine_id", "q").limit(rank).agg(F.min("cost").alias("cost"))


def budgets(grid: DataFrame, level: float) -> DataFrame:
    """machine_id, outliers: the greatest budget of each site whose cell reaches the level."""
    reached = F.max(F.when(F.col("cost") >= level, F.col("q")))
    return grid.groupBy("machine_id").agg(F.coalesce(reached, F.lit(0)).cast("int").alias("outliers"))


@dataclass
class GuhaDistributedKZCenter(_Base):
    """Budgets of outliers are dealt to the sites by their marginal costs; local results are clustered centrally."""

    rho: float = 2
    return_outliers: bool = False
    use_epsilon_net: bool = False

    def fit(self, points: DataFrame) -> GuhaDistributedKZCenter:
        points, n, d, m = self._prepare(points)
        if n and not self._few(points, n):
            k, z = self.n_clusters, self.n_outliers
            grid = marginal_costs(points, k, z).cache()
            told = grid
            if self.use_epsilon_net:
                wanted, cells = kernels.budget_grid(z, self.rho), {}
                for r in grid.where(F.col("q").isin(wanted)).collect():
                    cells.setdefault(r["machine_id"], []).append((r["q"], r["cost"]))
                dense = [(s, q, c) for s, own in cells.items() for q, c in enumerate(hull_costs(own, z))]
                told = points.sparkSession.createDataFrame(dense, "machine_id int, q int, cost double")
            level = threshold(told, z, m, min(self.rho, m - 1e-9) if m > 1 else 0.5).first()["cost"]
            own = {r["machine_id"]: r["outliers"] for r in budgets(told, level).collect()}
            rows = self._local(points, own)
            x, w = _arrays(rows)
            told_cells = len(kernels.budget_grid(z, self.rho)) if self.use_epsilon_net else z + 1
            self.communication_cost = costs.communication(len(rows), d, len(rows) + m * told_cells)
            found, self.opt = kernels.charikar(x, k, z, w, max(self.delta, 1e-3), 1, 3, grid=True, seed=self.seed)
            self.centers = kernels.padded(found.centers, x, k)
            grid.unpersist()
        points.unpersist()
        return self

    def _local(self, points: DataFrame, own: dict[int, int]) -> list:
        k, delta, seed, every = self.n_clusters, max(self.delta, 1e-2), self.seed, self.return_outliers

        def run(site: pd.DataFrame) -> pd.DataFrame:
            site = site.sort_values("id")
            x, w, t = np.stack(site["features"]), site["weight"].to_numpy(), own[int(site["machine_id"].iloc[0])]
            if every:
                order, _ = kernels.farthest_first(x, 2 * k + t, 0)
                owner, _ = kernels.nearest(x, x[order])
                return pd.DataFrame({"features": list(x[order]), "weight": np.bincount(owner, minlength=len(order)).astype(float)})
            found, _ = kernels.charikar(x, k, t, w, delta, 1, 3, grid=True, seed=seed)
            return pd.DataFrame({"features": list(found.centers), "weight": found.weights})

        return points.select("machine_id", "id", "features", "weight").groupBy("machine_id").applyInPandas(run, "features array<double>, weight double").collect()

    def cost(self, points: DataFrame, remove_outliers: int | None = None) -> float:
        gone = int((1 + self.epsilon) * self.n_outliers) if remove_outliers is None else int(remove_outliers)
        return costs.center_cost(points, self.cluster_centers.tolist(), gone).first()["radius"]


def robust_facility_location(clients: list[DataFrame], facilities: DataFrame, limits: list[float], k: int = 8, z: float = 0, p: float = 2) -> tuple[list[int], float]:
    """(facility ids, value) of the min-max location over client sets (features, weight); all are coordinator-sized."""
    rows = facilities.select("id", "features").orderBy("id").collect()
    sets = [_arrays(weighted(c).select("features", "weight").collect()) for c in clients]
    open_, value = kernels.minmax_facilities([x for x, _ in sets], [w for _, w in sets], limits, np.array([r["features"] for r in rows], float), k, z, p)
    return [rows[i]["id"] for i in open_], value


def measure(name: str, model, points: DataFrame, z: int) -> dict:
    """Fit and score a model: seconds, communication cost, costs with 0 and with z points removed."""
    import time

    began = time.perf_counter()
    model.fit(points)
    seconds = time.perf_counter() - began
    return {"name": name, "seconds": seconds, "communication_cost": model.communication_cost, "cost_all": model.cost(points, 0), "cost_without_outliers": model.cost(points, z)}
