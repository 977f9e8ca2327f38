"""Hash uniforms, and global ranks and running sums that need no single-partition window."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a range, which a window orders in one task
ROWS_PER_RANGE = 250_000


def hash_uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5: the same in every engine and for every partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def range_cuts(df: DataFrame, key: str, tie: str | None = None, rows: int | None = None) -> list[tuple[float, float]]:
    """Cut points (key, tie) of ranges of about ``ROWS_PER_RANGE`` rows: constants, so ranges are stable across jobs.

    A value that fills whole ranges is cut by its rows' ties.
    """
    n = df.count() if rows is None else rows
    ranges = -(-n // ROWS_PER_RANGE)
    if ranges < 2:
        return []
    found = df.approxQuantile(key, [i / ranges for i in range(1, ranges)], min(0.002, 0.2 / ranges))
    cuts = []
    for value, times in sorted(Counter(found).items()):
        cuts.append((value, -math.inf))
        if times > 1 and tie:
            inner = df.where(F.col(key) == value).approxQuantile(tie, [i / (times + 1) for i in range(1, times + 1)], 0.02)
            cuts += [(value, t) for t in sorted(set(inner))]
    return cuts


def range_number(cuts: list[tuple[float, float]], key: str, tie: str | None = None) -> Column:
    """Which of the ranges a row is in: how many cut points lie before its (key, tie)."""
    if not cuts:
        return F.lit(0)
    keys = np.array([c[0] for c in cuts])
    ties = np.array([c[1] for c in cuts])

    @F.pandas_udf("int")
    def number(k: pd.Series, t: pd.Series) -> pd.Series:
        k, t = k.to_numpy(float), t.to_numpy(float)
        out, end = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.unique(out[end > out]):  # rows whose value is cut by ties
            own = np.flatnonzero((out == i) & (end > out))
            out[own] += np.searchsorted(ties[i : end[own[0]]], t[own], "left")
        return pd.Series(out.astype(np.int32))

    return number(F.col(key).cast("double"), F.col(tie).cast("double") if tie else F.lit(0.0))


def running_sum(df: DataFrame, key: str, ties: list[str], value: Column, out: str, descending: bool = False, rows: int | None = None) -> DataFrame:
    """Adds the running sum of ``value`` in order of (key, ties); windows are per range, offsets are one number a range.

    In descending order ties are still ascending, so they cut no range.
    """
    tie = ties[0] if ties and not descending else None
    cuts = range_cuts(df, key, tie, rows)
    order = [F.col(key).desc() if descending else F.col(key).asc(), *ties]
    if not cuts:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    part, val = f"_{out}_range", f"_{out}_value"
    dealt = df.withColumn(part, range_number(cuts, key, tie)).withColumn(val, value)
    of_ranges = dealt.groupBy(part).agg(F.sum(val).alias("s"))
    sums, kind = {r[part]: r["s"] for r in of_ranges.collect()}, dict(of_ranges.dtypes)["s"]
    before, total = {}, {"double": 0.0, "bigint": 0}.get(kind, Decimal(0))  # of one type, as the column is
    for p in sorted(sums, reverse=descending):
        before[p] = total
        total += sums[p] or 0
    window = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), f"{part}_no int, {part}_before {kind}"))
    summed = dealt.withColumn(out, F.sum(val).over(window)).join(told, F.col(part) == F.col(f"{part}_no"))
    return summed.withColumn(out, F.col(out) + F.col(f"{part}_before")).drop(part, val, f"{part}_no", f"{part}_before")


def row_numbers(df: DataFrame, key: str, ties: list[str], out: str, descending: bool = False, rows: int | None = None) -> DataFrame:
    """Adds the 1-based global rank by (key, ties)."""
    return running_sum(df, key, ties, F.lit(1).cast("long"), out, descending, rows)
