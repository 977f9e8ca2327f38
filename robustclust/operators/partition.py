"""Dealing points to logical sites (machine_id), and set operations on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from robustclust.functions.ranks import hash_uniform, row_numbers


def evenly(points: DataFrame, m: int, seed: int | None = None) -> DataFrame:
    """Adds machine_id: blocks of n // m rows by id (or by hash order with a seed); the last takes the remainder."""
    n = points.count()
    size = max(1, n // m)
    keyed = points.withColumn("_key", F.col("id").cast("double") if seed is None else hash_uniform(seed, "id"))
    ranked = row_numbers(keyed, "_key", ["id"], "_rank", rows=n)
    site = F.least(F.floor((F.col("_rank") - 1) / size), F.lit(m - 1)).cast("int")
    return ranked.withColumn("machine_id", site).drop("_key", "_rank")


def cut_points(n: int, m: int, seed: int) -> list[int]:
    """m - 1 hash-drawn cut points in 0..n, sorted: parts may be empty."""
    from hashlib import md5

    draw = [int(md5(f"{seed}:cut:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 for i in range(m - 1)]
    return sorted(int(u * n) for u in draw)


def arbitrarily(points: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Adds machine_id: hash order cut at random places."""
    n = points.count()
    cuts = cut_points(n, m, seed)
    keyed = points.withColumn("_key", hash_uniform(seed, "id"))
    ranked = row_numbers(keyed, "_key", ["id"], "_rank", rows=n)
    site = sum(((F.col("_rank") > c).cast("int") for c in cuts), F.lit(0))
    return ranked.withColumn("machine_id", site.cast("int")).drop("_key", "_rank")


def split_sites(points: DataFrame, most: int = 10_000) -> DataFrame:
    """Splits every site of more than ``most`` rows evenly into ceil(n / most) sites; sites are renumbered from 0.

    Rows are ranked by site and id over ranges of bounded size, so no task holds an oversized site.
    """
    sizes = points.groupBy("machine_id").agg(F.count("*").alias("_n"))
    parts = sizes.withColumn("_parts", F.ceil(F.col("_n") / most).cast("long"))
    earlier = Window.orderBy("machine_id").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    numbered = parts.withColumn("_first", before("_parts")).withColumn("_before", before("_n"))  # one row a site
    ranked = row_numbers(points, "machine_id", ["id"], "_rank")
    ranked = ranked.join(F.broadcast(numbered) if numbered.count() <= 100_000 else numbered, "machine_id")
    rank = F.col("_rank") - F.col("_before") - 1
    block = F.greatest(F.floor(F.col("_n") / F.col("_parts")), F.lit(1))
    sub = F.least(F.floor(rank / block), F.col("_parts") - 1)
    return ranked.withColumn("machine_id", (F.col("_first") + sub).cast("int")).drop("_n", "_parts", "_first", "_before", "_rank")


def union_sites(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("id"), "id", "left_anti")


def within(points: DataFrame, wanted: DataFrame) -> DataFrame:
    return points.join(wanted.select("id").distinct(), "id", "left_semi")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def facilities(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct sampled (machine_id, id) with their features looked up."""
    return points.join(samples.select("machine_id", "id").distinct(), ["machine_id", "id"], "left_semi").select("machine_id", "id", "features")
