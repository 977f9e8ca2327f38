"""Column builders for distances between dense feature arrays, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[float]


def vector(values: Point) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def lp_distance(a: Column, b: Column, p: float) -> Column:
    """The Euclidean distance to the power p (1 <= p <= 2), not the L_p norm."""
    if not 1 <= p <= 2:
        raise ValueError("p must be between 1 and 2")
    return F.pow(distance(a, b), F.lit(float(p)))


def unrolled(features: Sequence[Column], centers: Sequence[Point]) -> list[Column]:
    """The distance to each center in plain arithmetic over single numbers, which is compiled with its stage."""
    each = []
    for c in centers:
        total = F.lit(0.0)
        for x, v in zip(features, c, strict=True):
            total = total + (x - F.lit(float(v))) * (x - F.lit(float(v)))
        each.append(F.sqrt(total))
    return each


def nearest(features: Column, centers: Sequence[Point]) -> Column:
    """struct(d, c): distance to and index of the nearest center; of equals the lowest index. Map-only."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), vector(c).alias("f")) for i, c in enumerate(centers)])
    return F.array_min(F.transform(table, lambda c: F.struct(distance(features, c["f"]).alias("d"), c["i"].alias("c"))))
