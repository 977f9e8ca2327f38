"""Sensitivity-sampling coresets and outlier summaries, by site."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from robustclust.sources.points import weighted


def probabilities(costs: DataFrame, normalizer: float = 1.0) -> DataFrame:
    """id, prob, weight: sampling chances by cost and the weight of a sample (normalizer over chance); cost 0 is never drawn."""
    total = costs.agg(F.sum("cost").alias("t")).first()["t"] or 0.0
    prob = F.col("cost") / F.lit(float(total))
    return costs.where("cost > 0").select("id", prob.alias("prob"), (F.lit(float(normalizer)) / prob).alias("weight"))


def _keys(costs: DataFrame) -> list[str]:
    """A site, or a site for each guessed radius."""
    return ["guess_id", "machine_id"] if "guess_id" in costs.columns else ["machine_id"]


def quotas(costs: DataFrame, size: int, centers_a_site: int) -> DataFrame:
    """machine_id, site_cost, share: floor(t * cost of the site / total cost), t = max(m, size - m * centers a site)."""
    keys = _keys(costs)
    sites = costs.groupBy(*keys).agg(F.sum("cost").alias("site_cost"))
    every = Window.partitionBy(*keys[:-1])  # one row a site
    m = F.count("*").over(every)
    told = sites.select(*keys, "site_cost", F.greatest(m, F.lit(size) - m * centers_a_site).cast("long").alias("t"), F.sum("site_cost").over(every).alias("total"))
    share = F.when(F.col("total") > 0, F.floor(F.col("t") * F.col("site_cost") / F.col("total"))).otherwise(0)
    return told.select(*keys, "site_cost", share.cast("long").alias("share"), "t", "total")


def sample_sites(costs: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """machine_id, draw, id, weight: each site draws its share with replacement by cost. A site's draws go to one task."""
    keys = _keys(costs)
    rows = costs.join(shares, keys).where("share > 0")

    def run(site: pd.DataFrame) -> pd.DataFrame:
        from hashlib import md5

        site = site.sort_values("id")
        m, share = int(site["machine_id"].iloc[0]), int(site["share"].iloc[0])
        cost = site["cost"].to_numpy()
        cum = np.cumsum(cost)
        u = np.array([int(md5(f"{seed}:{m}:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 for i in range(1, share + 1)])
        at = np.minimum(np.searchsorted(cum, u * cum[-1], "right"), len(cum) - 1)
        drawn = {"draw": np.arange(1, share + 1), "id": site["id"].to_numpy()[at], "weight": site["total"].iloc[0] / (site["t"].iloc[0] * cost[at])}
        return pd.DataFrame({k: np.full(share, site[k].iloc[0], np.int32) for k in keys} | drawn)

    schema = ", ".join(f"{k} int" for k in keys) + ", draw long, id long, weight double"
    return rows.select(*keys, "id", "cost", "share", "t", "total").groupBy(*keys).applyInPandas(run, schema)


def center_weights(assigned: DataFrame, sampled: DataFrame) -> DataFrame:
    """machine_id, center, weight: rows of a local cluster less the weights of its samples, draws counted (may be negative)."""
    keys = _keys(assigned)
    size = assigned.groupBy(*keys, "center").agg(F.count("*").cast("double").alias("n"))
    taken = sampled.join(assigned.select(*keys, "id", "center"), [*keys, "id"]).groupBy(*keys, "center").agg(F.sum("weight").alias("w"))
    return size.join(taken, [*keys, "center"], "left").select(*keys, "center", (F.col("n") - F.coalesce("w", F.lit(0.0))).alias("weight"))


def coreset(assigned: DataFrame, local_centers: DataFrame, size: int, centers_a_site: int, seed: int = 0) -> DataFrame:
    """machine_id, id, features, weight, is_center. assigned: machine_id, id, features, center, cost; local_centers: machine_id, center, features.

    With a guess_id there is a coreset for each guess, all made in one pass.
    """
    keys = _keys(assigned)
    sampled = sample_sites(assigned, quotas(assigned, size, centers_a_site), seed).groupBy(*keys, "id").agg(F.sum("weight").alias("weight"))
    samples = sampled.join(assigned.select(*keys, "id", "features"), [*keys, "id"]).select(*keys, "id", "features", "weight", F.lit(False).alias("is_center"))
    weights = center_weights(assigned, sampled)
    centers = weights.join(local_centers, ["machine_id", "center"])
    return samples.unionByName(centers.select(*keys, F.col("center").cast("long").alias("id"), "features", "weight", F.lit(True).alias("is_center")))


def radius_grid(low: float, high: float, eps: float, p: float) -> list[float]:
    """Guesses (low (1 + eps)^i)^p up to the upper bound."""
    n = int(np.floor(np.log(high / low) / np.log1p(eps))) if high > low else 0
    return [(low * (1 + eps) ** i) ** p for i in range(max(1, n))]


def capped_costs(costs: DataFrame, limits: list[float]) -> DataFrame:
    """guess_id, id, cost for every guessed radius: all guesses in one pass."""
    table = F.array(*[F.struct(F.lit(i).alias("guess_id"), F.lit(float(v)).alias("limit")) for i, v in enumerate(limits)])
    keep = [c for c in costs.columns if c != "cost"]
    return costs.select(*keep, "cost", F.explode(table).alias("g")).select(F.col("g.guess_id").alias("guess_id"), *keep, F.least("cost", F.col("g.limit")).alias("cost"))


def summarize_sites(points: DataFrame, k: int, z: int, m: int, alpha: float = 2, beta: float = 0.45, augmented: bool = False, adversary: bool = False, seed: int = 0) -> DataFrame:
    """machine_id, id, features, weight, round: an outlier summary of every site with its share of the outliers."""
    from robustclust.operators import kernels

    budget = z if adversary else 2 * z // m

    def run(site: pd.DataFrame) -> pd.DataFrame:
        site = site.sort_values("id")
        ids, no = site["id"].to_numpy(), int(site["machine_id"].iloc[0])
        x = np.stack(site["features"])
        got, weight, rounds = kernels.outlier_summary(x, ids, k, budget, alpha, beta, seed + no, augmented)
        at = np.searchsorted(ids, got)
        return pd.DataFrame({"machine_id": np.full(len(got), no, np.int32), "id": got, "features": list(x[at]), "weight": weight, "round": rounds.astype(np.int32)})

    return weighted(points).select("machine_id", "id", "features").groupBy("machine_id").applyInPandas(run, "machine_id int, id long, features array<double>, weight double, round int")


def first_two(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """client, first, second, d1, d2: the two nearest of the facilities (coordinator-sized) for every point. No shuffle."""
    from robustclust.operators import kernels

    rows = facilities.select("id", "features").orderBy("id").collect()
    table = points.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["features"] for r in rows], float)))

    def run(frames):
        ids, f = table.value
        for frame in frames:
            if len(frame):
                d = kernels.distances(np.stack(frame["features"]), f)
                two = np.argsort(d, axis=1, kind="stable")[:, :2]
                near = np.take_along_axis(d, two, axis=1)
                yield pd.DataFrame({"client": frame["id"], "first": ids[two[:, 0]], "second": ids[two[:, 1]], "d1": near[:, 0], "d2": near[:, 1]})

    return points.select("id", "features").mapInPandas(run, "client long, first long, second long, d1 double, d2 double")


def closing_costs(two: DataFrame) -> DataFrame:
    """facility, increase: what closing each facility that is some client's first choice costs, from ``first_two``."""
    from robustclust.operators import kernels

    def run(frames):
        for frame in frames:
            if len(frame):
                ids, at = np.unique(frame["first"].to_numpy(), return_inverse=True)
                table = kernels.closing_costs(at, (frame["d2"] - frame["d1"]).to_numpy(), np.zeros(len(frame), int), 1, len(ids))
                yield pd.DataFrame({"facility": ids, "increase": table[0]})

    parts = two.select("first", "d1", "d2").mapInPandas(run, "facility long, increase double")
    return parts.groupBy("facility").agg(F.sum("increase").alias("increase"))
