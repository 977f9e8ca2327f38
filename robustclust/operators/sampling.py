"""Hash-drawn samples: uniform without and with replacement, multinomial shares, and weighted by inverse distribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustclust.functions.ranks import hash_uniform, row_numbers, running_sum
from robustclust.operators import kernels


def without_replacement(points: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows of each site, in hash order: per-site lists of the least hashes are merged, not sorted."""
    keyed = points.withColumn("_u", hash_uniform(seed, "id"))
    rank = F.row_number().over(Window.partitionBy("machine_id").orderBy("_u", "id"))
    return keyed.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_u", "_rank")


def draws(sites: DataFrame, size: Column, seed: int) -> DataFrame:
    """machine_id, draw, u: a hash uniform for each of a site's draws."""
    return sites.where(size > 0).select("machine_id", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("draw")).withColumn("u", hash_uniform(seed, "machine_id", "draw"))


def with_replacement(points: DataFrame, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """machine_id, draw, id, features; sizes: machine_id, draws. Rows are ranked by site and id over ranges of bounded size."""
    ranked = row_numbers(points, "machine_id", ["id"], "rank").select("rank", "id", "features")
    counts = points.groupBy("machine_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("machine_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)  # one row a site
    drawn = draws(sizes, F.col("draws"), seed).join(counts, "machine_id").withColumn("rank", F.col("before") + F.floor(F.col("u") * F.col("n")) + 1)
    return drawn.join(ranked, "rank").select("machine_id", "draw", "id", "features")


def multinomial_shares(points: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """machine_id, draws: ``total`` draws dealt to sites by their size; a site that got none gets one."""
    counts = points.groupBy("machine_id").agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.orderBy("machine_id").rowsBetween(Window.unboundedPreceding, 0))
    table = counts.select("machine_id", "n", cum.alias("hi"), F.sum("n").over(Window.partitionBy()).alias("all"))  # one row a site
    slots = points.sparkSession.range(1, total + 1).select(hash_uniform(seed, "id").alias("u"))
    ends = [(r["machine_id"], r["hi"], r["all"]) for r in table.orderBy("hi").collect()]  # one row a site
    hi, every = np.array([e[1] for e in ends]), float(ends[-1][2]) if ends else 0.0

    @F.pandas_udf("int")
    def site(u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(hi, u.to_numpy() * every, "right").astype(np.int32))

    met = slots.groupBy(site("u").alias("at")).agg(F.count("*").alias("got"))
    named = points.sparkSession.createDataFrame([(i, e[0]) for i, e in enumerate(ends)], "at int, machine_id int")
    met = met.join(F.broadcast(named), "at").select("machine_id", "got")
    return counts.join(met, "machine_id", "left").select("machine_id", F.greatest(F.coalesce("got", F.lit(0)), F.lit(1)).cast("long").alias("draws"))


def by_weight(points: DataFrame, weight: str, size: int, seed: int = 0) -> DataFrame:
    """draw, id: ``size`` rows with replacement, by weight. A draw u takes the first row whose running weight exceeds u * total.

    The draws (a number each) are told to the tasks, which find theirs among their rows' shares by binary search.
    """
    rows = points.where(F.col(weight) > 0)
    summed = running_sum(rows, "id", [], F.col(weight), "hi").select("id", F.col(weight).cast("double").alias("w"), F.col("hi").cast("double").alias("hi"))
    total = float(rows.agg(F.sum(weight)).first()[0] or 0)
    at = np.array([kernels.hash_uniform(seed, j) * total for j in range(1, size + 1)])
    order = np.argsort(at, kind="stable")
    told = points.sparkSession.sparkContext.broadcast((at[order], order + 1))

    def run(frames):
        where, draw = told.value
        for frame in frames:
            hi = frame["hi"].to_numpy()
            first, end = np.searchsorted(where, hi - frame["w"].to_numpy(), "left"), np.searchsorted(where, hi, "left")
            took = np.maximum(end - first, 0)
            slot = np.repeat(first - np.concatenate([[0], np.cumsum(took)[:-1]]), took) + np.arange(took.sum()) if len(took) else first
            yield pd.DataFrame({"draw": draw[slot], "id": np.repeat(frame["id"].to_numpy(), took)})

    return summed.mapInPandas(run, "draw long, id long")
