"""Clustering costs: sums, trimmed and thresholded sums, order statistics, and center updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustclust.functions.distance import Point
from robustclust.functions.ranks import range_cuts, range_number, row_numbers
from robustclust.operators.joins import assign

#: outliers up to which the farthest rows are found by bounded heaps; more are found by a global rank
HEAP_ROWS = 100_000


def _weight(df: DataFrame) -> Column:
    return F.coalesce("weight", F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)


def raised(p) -> Column:
    """The distance to a power, or what a cost function makes of it."""
    return p(F.col("dist")) if callable(p) else F.pow("dist", F.lit(float(p)))


def farthest_rows(assigned: DataFrame, z: int, by: str = "dist") -> DataFrame:
    """The z rows of greatest ``by`` (ties: lowest id): a bounded top-z or, for many, those of the first z ranks."""
    if z <= HEAP_ROWS:
        return assigned.orderBy(F.col(by).desc(), "id").limit(int(z))
    return row_numbers(assigned, by, ["id"], "_rank", descending=True).where(F.col("_rank") <= int(z)).drop("_rank")


def point_costs(points: DataFrame, centers: list[Point], p: float = 2, limit: float | None = None) -> DataFrame:
    """id, cost of every point: its distance to the power p, at most ``limit``, times its weight where no limit is set."""
    near = assign(points, centers)
    power = raised(p)
    value = power * _weight(points) if limit is None else _weight(points) * F.least(power, F.lit(float(limit)))
    return near.select("id", value.alias("cost"))


def lp_cost(points: DataFrame, centers: list[Point], p: float = 2, z: int = 0, limit: float | None = None) -> DataFrame:
    """cost: the sum without the z greatest weighted terms, or with a limit the capped sum less z times the limit."""
    each = point_costs(points, centers, p, limit)
    total = each.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    if limit is not None:
        return total.select((F.col("cost") - F.lit(float(z * limit))).alias("cost"))
    if not z:
        return total
    top = farthest_rows(each, z, "cost").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("top"))
    return total.crossJoin(top).select((F.col("cost") - F.col("top")).alias("cost"))


def means_cost(points: DataFrame, centers: list[Point], z: int = 0, limit: float | None = None) -> DataFrame:
    return lp_cost(points, centers, 2, z, limit)


def median_cost(points: DataFrame, centers: list[Point], z: int = 0, limit: float | None = None) -> DataFrame:
    return lp_cost(points, centers, 1, z, limit)


def cost_without(points: DataFrame, centers: list[Point], removed: int, p: float = 2) -> DataFrame:
    """cost after the ``removed`` farthest rows by plain distance are gone."""
    near = assign(points, centers).withColumn("cost", raised(p) * _weight(points))
    total = near.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    if not removed:
        return total
    top = farthest_rows(near, removed).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("top"))
    return total.crossJoin(top).select((F.col("cost") - F.col("top")).alias("cost"))


def center_cost(points: DataFrame, centers: list[Point], removed: int) -> DataFrame:
    """radius: the (removed + 1)-th greatest distance to the nearest center."""
    return farthest_rows(assign(points, centers), removed + 1).agg(F.min("dist").alias("radius"))


def mark_outliers(points: DataFrame, centers: list[Point], z: int) -> DataFrame:
    """The assigned points with is_outlier: the z farthest rows by unweighted distance."""
    near = assign(points, centers)
    far = farthest_rows(near, z).select("id", F.lit(True).alias("is_outlier"))
    far = F.broadcast(far) if z <= 50_000 else far
    return near.join(far, "id", "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))


def cluster_sizes(points: DataFrame, centers: list[Point]) -> DataFrame:
    """center, members, mass; empty clusters have no row."""
    near = assign(points, centers)
    return near.groupBy("center").agg(F.count("*").alias("members"), F.sum(_weight(points)).alias("mass"))


def mean_update(assigned: DataFrame) -> DataFrame:
    """center, pos, value: weighted means of the rows that aren't outliers; clusters without weight vanish."""
    rows = assigned.where(~F.col("is_outlier")) if "is_outlier" in assigned.columns else assigned
    parts = rows.select("center", _weight(rows).alias("_w"), F.posexplode("features").alias("pos", "v"))
    mean = parts.groupBy("center", "pos").agg(F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum("_w").alias("w"))
    return mean.where(F.abs("w") > 1e-12).select("center", "pos", (F.col("s") / F.col("w")).alias("value"))


def median_update(assigned: DataFrame) -> DataFrame:
    """center, pos, value: lower weighted medians by coordinate, of weights that aren't negative.

    Weights are summed by ranges of values first; only the range that holds a median is ordered, so no task orders a
    whole cluster.
    """
    rows = assigned.where(~F.col("is_outlier")) if "is_outlier" in assigned.columns else assigned
    parts = rows.select("center", _weight(rows).alias("_w"), F.posexplode("features").alias("pos", "v"))
    cuts = range_cuts(parts, "v")
    if not cuts:  # so few rows that a window may hold a cluster's
        order = Window.partitionBy("center", "pos")
        mass = parts.groupBy("center", "pos", "v").agg(F.sum("_w").alias("w"))
        cum = F.sum("w").over(order.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = mass.select("center", "pos", "v", cum.alias("cum"), F.sum("w").over(order).alias("total"))
        return ranked.where(2 * F.col("cum") >= F.col("total")).groupBy("center", "pos").agg(F.min("v").alias("value"))
    ranged = parts.withColumn("_range", range_number(cuts, "v"))
    by = Window.partitionBy("center", "pos")
    sums = ranged.groupBy("center", "pos", "_range").agg(F.sum("_w").alias("w"))  # some numbers a cluster and coordinate
    cum = F.sum("w").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    told = sums.select("center", "pos", "_range", (cum - F.col("w")).alias("before"), cum.alias("cum"), F.sum("w").over(by).alias("total"))
    half = told.where(2 * F.col("cum") >= F.col("total")).groupBy("center", "pos").agg(F.min(F.struct("_range", "before", "total")).alias("h"))
    half = half.select("center", "pos", F.col("h._range").alias("_range"), "h.before", "h.total")
    mass = ranged.join(half, ["center", "pos", "_range"]).groupBy("center", "pos", "v", "before", "total").agg(F.sum("_w").alias("w"))
    inner = F.col("before") + F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = mass.select("center", "pos", "v", "total", inner.alias("cum"))
    return ranked.where(2 * F.col("cum") >= F.col("total")).groupBy("center", "pos").agg(F.min("v").alias("value"))


def update_rows(update: DataFrame) -> list[list[float]]:
    """Centers of an update, in order of their index (k rows of d numbers)."""
    table: dict[int, dict[int, float]] = {}
    for r in update.collect():
        table.setdefault(r["center"], {})[r["pos"]] = r["value"]
    return [[row[j] for j in sorted(row)] for _, row in sorted(table.items())]


def communication(rows: int, features: int, extra: int = 0) -> int:
    """Numbers sent to the coordinator: rows of features, and weights or indices besides."""
    return rows * features + extra


def running_minimum(grid: DataFrame) -> DataFrame:
    """site, q, cost: the least cost at or before each budget q of a site."""
    order = Window.partitionBy("machine_id").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("cost", F.min("cost").over(order))
