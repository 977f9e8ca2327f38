"""Point sets: DataFrames of id long, features array<double>, optional weight double and machine_id int."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustclust.functions.ranks import hash_uniform

SCHEMA = "id long, features array<double>"


class NotFittedError(ValueError):
    """A model was asked for results before it was fitted."""


def validate(points: DataFrame) -> int:
    """The number of features; raises if widths differ or a value is null or not a number. One pass."""
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v))
    row = points.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.max((F.col("features").isNull() | bad).cast("int")).alias("bad")).first()
    if row["bad"]:
        raise ValueError("features must be numbers")
    if row["lo"] != row["hi"]:
        raise ValueError(f"points have from {row['lo']} to {row['hi']} features")
    return row["hi"] or 0


def weighted(points: DataFrame) -> DataFrame:
    """With a weight: 1 where none is given."""
    return points.withColumn("weight", F.coalesce("weight", F.lit(1.0)) if "weight" in points.columns else F.lit(1.0))


def with_sites(points: DataFrame, m: int) -> DataFrame:
    """With a logical site each, by id."""
    return points.withColumn("machine_id", F.pmod("id", F.lit(m)).cast("int"))


# ---- tables of numbers -------------------------------------------------------------------------------------------


def from_columns(table: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """A point set from numeric columns; only these columns are read."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return table.select(F.col(key).cast("long").alias("id"), F.array(*[v.cast("double") for v in values]).alias("features"))


def from_array(table: DataFrame, key: str, column: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("features"))


TABLES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "emb": ("embeddings", lambda t: from_array(t, "vec_id", "embedding")),
    "events2d": ("events", lambda t: from_columns(t, "event_id", "value", F.hour("ts"))),
    "cust1d": ("customer", lambda t: from_columns(t, "c_custkey", "c_acctbal")),
    "orders1d": ("orders", lambda t: from_columns(t, "o_orderkey", "o_totalprice")),
    "part2d": ("part", lambda t: from_columns(t, "p_partkey", "p_size", "p_retailprice")),
    "line4d": ("lineitem", lambda t: from_columns(t, "l_orderkey", "l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)),
    "nation2d": ("nation", lambda t: from_columns(t, "n_nationkey", "n_nationkey", "n_regionkey")),
}


def table_points(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registered point set over the Parquet tables of a folder."""
    if name not in TABLES:
        raise NotImplementedError(f"no point set {name}; there are {', '.join(TABLES)}")
    table, make = TABLES[name]
    return make(spark.read.parquet(f"{folder}/{table}.parquet"))


# ---- matrix files ------------------------------------------------------------------------------------------------


def _mat_elements(raw: bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # a small element keeps size and data in eight bytes
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == 15 else -size % 8)


#: fixed values: numeric types of level 5 MAT files
MAT_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}


def read_mat(raw: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a little-endian level 5 MAT file."""
    if raw[126:128] != b"IM":
        raise ValueError("only little-endian level 5 MAT files are read")
    out = {}
    for kind, body in _mat_elements(raw, 128, len(raw)):
        if kind == 15:
            body = zlib.decompress(body)
            kind, body = next(_mat_elements(body, 0, len(body)))
        if kind != 14:
            continue
        parts = list(_mat_elements(body, 0, len(body)))
        if parts[0][1][0] not in range(6, 16):  # only numeric classes
            continue
        shape = np.frombuffer(parts[1][1], "<i4")
        out[parts[2][1].rstrip(b"\0").decode()] = np.frombuffer(parts[3][1], MAT_TYPES[parts[3][0]]).astype(float).reshape(shape, order="F")
    return out


def _matrix(path: str, raw: bytes, key: str | None) -> np.ndarray:
    if path.endswith(".mat"):
        found = read_mat(raw)
        return found[key] if key else next(iter(found.values()))
    loaded = np.load(io.BytesIO(raw), allow_pickle=False)
    return loaded if isinstance(loaded, np.ndarray) else loaded[key or loaded.files[0]]


def matrix_points(spark: SparkSession, path: str, key: str | None = None, columns: int | None = None, per_file: int = 1 << 32) -> DataFrame:
    """Rows of .npy, .npz or .mat matrices as points; ids number the rows of each file, files by their path.

    ``columns`` keeps the first features only. Any folder that Spark reads will do; one file is one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = sorted(r["path"] for r in files.select("path").collect())  # file names only
    number = {p: i for i, p in enumerate(order)}

    def rows(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                x = np.atleast_2d(_matrix(name, bytes(content), key))[:, :columns]
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096].astype(float)
                    yield pd.DataFrame({"id": number[name] * per_file + np.arange(lo, lo + len(part)), "features": list(part)})

    return files.mapInPandas(rows, SCHEMA)


#: fixed values: the data sets known by name, as (file, key, number of features kept)
DATASETS = {
    "spambase": ("spambase.npz", "features", None),
    "letter": ("letter.npz", "features", None),
    "pendigits": ("pendigits.npz", "features", None),
    "skin": ("skin.npz", "features", None),
    "parkinsons": ("parkinsons.mat", "Features_only", None),
    "higgs": ("higgs.npy", None, None),
    "gas": ("gas.npy", None, None),
    "power": ("power.npy", None, None),
    "covertype": ("covertype.npz", "features", 10),
}


def dataset(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A data set by name from matrix files in ``folder``."""
    if name not in DATASETS:
        raise NotImplementedError(f"no data set {name}; there are {', '.join(DATASETS)}")
    file, key, columns = DATASETS[name]
    return matrix_points(spark, f"{folder}/{file}", key, columns)


# ---- generators --------------------------------------------------------------------------------------------------


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number by Box and Muller from two hash uniforms."""
    u, v = hash_uniform(seed, *parts), hash_uniform(seed + 7919, *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)


def _normals(seed: int, d: int, scale: Column | float, *parts: Column | str) -> Column:
    return F.array(*[normal(seed, *parts, F.lit(j)) * scale for j in range(d)])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_outliers(points: DataFrame, z: int, factor: float = 10, seed: int = 0) -> DataFrame:
    """Appends z shifted copies of hash-drawn rows; is_outlier marks them, source_id names the row copied."""
    d = validate(points)
    size = points.agg(F.avg(F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v))).alias("m"), F.max("id").alias("top")).first()
    drawn = points.withColumn("_u", hash_uniform(seed, "id")).orderBy("_u", "id").limit(z).withColumn("_n", F.row_number().over(_by("_u")))
    moved = drawn.select((F.lit(size["top"]) + F.col("_n")).alias("id"), add(F.col("features"), _normals(seed + 1, d, float(np.sqrt(factor * size["m"])), "id")).alias("features"), F.lit(True).alias("is_outlier"), F.col("id").alias("source_id"))
    return points.select("id", "features", F.lit(False).alias("is_outlier"), F.lit(None).cast("long").alias("source_id")).unionByName(moved)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column, "id")  # over the z drawn rows only


def gaussian_mixture(spark: SparkSession, n: int, k: int, z: int, d: int, means: list[list[float]] | None = None, covariance: float | None = None, factor: float = 50, seed: int = 0, shares: list[float] | None = None) -> DataFrame:
    """n points of an isotropic mixture with uneven drawn (or given) shares of its clusters; z of them are shifted far away."""
    rng = np.random.default_rng(seed)
    means = means if means is not None else (rng.normal(size=(k, d)) * factor / 5).tolist()
    spread = float(np.sqrt(covariance if covariance is not None else factor / 15))
    cuts = np.sort(rng.random(k - 1)).tolist() if shares is None else np.cumsum(shares)[:-1].tolist()
    u = hash_uniform(seed, "id")
    cluster = sum((u >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in means])
    base = spark.range(n).withColumn("cluster", cluster).withColumn("features", add(table[F.col("cluster")], _normals(seed + 1, d, spread, "id")))
    far = base.select("id").withColumn("_u", hash_uniform(seed + 2, "id")).orderBy("_u", "id").limit(z).select("id", F.lit(True).alias("is_outlier"))
    size = float(np.linalg.norm(np.array(means), axis=1).mean() + 1)
    marked = base.join(far, "id", "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
    shifted = add(F.col("features"), _normals(seed + 3, d, float(np.sqrt(factor * size)), "id"))
    return marked.select("id", F.when(F.col("is_outlier"), shifted).otherwise(F.col("features")).alias("features"), "cluster", "is_outlier")
