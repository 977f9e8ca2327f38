"""Connected components of a distributed edge list: spanning forests by partition, then star steps.

Every partition first keeps a spanning forest of its own edges. What is left goes through one task where it is at most
``LOCAL_EDGES`` edges (a checked bound), else through alternating large-star and small-star steps, in which nodes of
very many edges are told to all tasks instead of gathering their edges in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.session import lean, staged, unstaged

#: edges (16 bytes each) that one task may hold
LOCAL_EDGES = 500_000
#: rows above which a key is hot
HOT_ROWS = 500
EDGES = "a long, b long"


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) by hooking larger roots to smaller ones and jumping pointers."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(jumped := root[root], root):
            root = jumped


def _stars(frames):
    """The forest of a partition as stars, in bounded pieces: each piece's edges join those kept so far."""
    held = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    for frame in frames:
        if len(held) > LOCAL_EDGES:
            yield held
            held = held[:0]
        both = pd.concat([held, frame])
        nodes, root = roots_of(both["a"].to_numpy(), both["b"].to_numpy())
        other = nodes != root
        held = pd.DataFrame({"a": nodes[other], "b": root[other]})
    yield held


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, value: str, total: int, salt: str, alone=None) -> DataFrame:
    """A left join on a unique key: keys of many rows (no more than 2000 can be hot) are broadcast, the rest is shuffled.

    ``alone``: a condition of rows whose key is not on the right; they scatter, too.
    """
    hot = F.col(rows) > max(HOT_ROWS, total // 2000)
    some = F.broadcast(right.where(hot).select(F.col(key).alias("_hot"), F.col(value).alias("_hot_value")))
    rest = right.where(~hot).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    known = left.join(some, left[key] == F.col("_hot"), "left")
    # rows that have their value already scatter instead of meeting at their key
    meets = F.col("_hot").isNull() if alone is None else F.col("_hot").isNull() & ~alone
    known = known.withColumn("_at", F.when(meets, F.col(key)).otherwise(F.xxhash64(salt, key).cast(left.schema[key].dataType)))
    out = known.join(rest, F.col("_at") == F.col("_key"), "left")
    return out.withColumn(value, F.coalesce("_hot_value", "_value")).drop("_hot", "_hot_value", "_key", "_value", "_at")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def _star_steps(pairs: DataFrame, before: tuple, most_rounds: int) -> DataFrame:
    """Alternating steps until nothing changes: each node hangs on its component's least."""
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges")).select("a", F.least("a", "m").alias("m"), "edges")
        up = spread_join(both.where("b > a"), least, "a", "edges", "m", 2 * before[0], "b")
        large = up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges"))
        down = spread_join(large, lower, "a", "edges", "m", 2 * before[0], "b")
        small = down.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(lower.select("a", F.col("m").alias("b")))
        old, pairs = pairs, staged(small.distinct(), "cc")
        unstaged(old)
        after = _signature(pairs)
        if after == before:
            return pairs
        before = after
    raise RuntimeError("components did not settle")


def connected(edges: DataFrame, most_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, root for every node of ``edges`` (a, b longs); root is the component's smallest node."""
    pairs = staged(edges.where("a <> b").mapInPandas(lean(_stars), EDGES), "cc")
    before = _signature(pairs)
    if before[0] > local_edges:
        pairs = _star_steps(pairs, before, most_rounds)
    else:
        old, pairs = pairs, staged(pairs.coalesce(1).mapInPandas(lean(_stars), EDGES), "cc")
        unstaged(old)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
