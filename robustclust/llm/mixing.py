"""Mixing sources to target weights: pivotal dependent rounding in a distributed reduction tree.

A source's target over its size gives every document the same expected copies. The whole part is taken; the fractions
are rounded by pivotal steps: two documents exchange words (fraction times size) at random, without changing either's
expectation, until one fraction is 0 or 1. The words of a source therefore stay exactly at target until a single
fractional document is left. Level by level, hash buckets of about ``fan_in`` documents of a source are reduced to one
residual each, so no task holds more than a bucket, however large a source is.

Defined results: a null text has size 0 and takes 0; a null source is the last source; every row is rounded by itself,
rows alike in all columns too (they are numbered); an empty table gives no rows; a text of any length is one document;
extra columns take part in telling rows apart and are returned as they are, whatever their names (``apply_mix`` adds
``copies``, with an underscore if there is such a column). Random numbers are hashes of the rows: reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustclust.llm.session import BROADCAST_IDS, free_name, lean, scratch, staged, unstaged

#: sources up to which their targets are broadcast (one short row each)
BROADCAST_SOURCES = 100_000
SALTS = 64
KEYS = ["doc_id", "source", "size", "row_key", "number"]


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII whitespace: the number of places where such a run begins."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.replace(squeezed, F.lit("w"), F.lit("")))).cast("long")


def water_fill(sizes: list[tuple[str | None, int]], weights=(1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Target words of each source: shares by weight of all words, stopped at ``most`` times the source's size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, active = float(sum(size.values())), [s for s, _ in order]
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in active}
            break
        out |= {s: most * size[s] for s in over}
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in out]
    return out


def pivotal(frac: list[float], size: list[float], u: list[float]) -> list[float]:
    """One pass of pivotal steps; at most one entry stays strictly between 0 and 1."""
    held = -1
    for j in range(len(frac)):
        if not 0.0 < frac[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - frac[i]) * size[i], frac[j] * size[j])
        down = min(frac[i] * size[i], (1 - frac[j]) * size[j])
        if u[j] * (up + down) < down:
            i_full, j_none = (1 - frac[i]) * size[i] <= up, frac[j] * size[j] <= up
            frac[i], frac[j] = 1.0 if i_full else frac[i] + up / size[i], 0.0 if j_none else frac[j] - up / size[j]
        else:
            i_none, j_full = frac[i] * size[i] <= down, (1 - frac[j]) * size[j] <= down
            frac[i], frac[j] = 0.0 if i_none else frac[i] - down / size[i], 1.0 if j_full else frac[j] + down / size[j]
        held = next((x for x in (i, j) if 0.0 < frac[x] < 1.0), -1)
    return frac


def _uniform(seed: int, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed + level), *KEYS), 11) / float(1 << 53)


def _reduce(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["u", "doc_id", "size", "row_key", "number"], kind="stable")
    group["frac"] = pivotal(group["frac"].tolist(), group["size"].astype(float).tolist(), group["u"].tolist())
    return group.drop(columns=["bucket", "u"])


def row_key(docs: DataFrame) -> Column:
    """A hash of a whole row; rows of one doc_id, source and size are told apart by it."""
    unordered = lambda kind: "map<" in kind or "variant" in kind
    return F.xxhash64(*[F.to_json(F.col(f"`{name}`")) if unordered(kind) else F.col(f"`{name}`") for name, kind in docs.dtypes])


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, fan_in: int = 512, seed: int = 17) -> DataFrame:
    """doc_id, source, size, row_key, number (of rows alike), source_size, target, copies: one row per row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        return keep(_mixed(docs, weights, most, fan_in, seed), "mix")


def _mixed(docs: DataFrame, weights, most: float, fan_in: int, seed: int) -> DataFrame:
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key(docs).alias("row_key"))
    alike = sized.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("n"))
    units = staged(alike.select("doc_id", "source", "size", "row_key", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("number")), "mix-units")
    totals = units.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("units")).collect()  # one row a source
    targets = water_fill([(r["source"], r["words"]) for r in totals], weights, most)
    rows = [(r["source"], r["words"], float(targets[r["source"]]), targets[r["source"]] / r["words"] if r["words"] else 0.0, -(-r["units"] // fan_in)) for r in totals]
    spark = docs.sparkSession
    per_source = spark.createDataFrame(rows, "s string, source_size long, target double, ratio double, buckets int")
    if len(rows) <= BROADCAST_SOURCES:
        joined = units.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("s")))
    else:
        salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = units.withColumn("salt_u", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt_u") == F.col("salt"))).drop("salt", "salt_u")
    whole = F.floor("ratio")
    state = joined.select(*KEYS, "source_size", "target", "buckets", whole.cast("long").alias("base"), F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(0.0).alias("frac"))
    schema = state.schema
    done, level, most_buckets = [], 0, max((r[4] for r in rows), default=0)
    while most_buckets:
        bucket = F.pmod(F.xxhash64(F.lit(seed + 1000 * level), "doc_id", "size", "row_key", "number"), F.greatest("buckets", F.lit(1)))
        dealt = state.withColumn("u", _uniform(seed, level)).withColumn("bucket", bucket)
        reduced = staged(dealt.groupBy("source", "bucket").applyInPandas(lean(_reduce), schema), f"mix-level{level}")
        if not level:
            unstaged(units)
        open_ = (F.col("frac") > 0) & (F.col("frac") < 1)
        done.append(reduced.where(~open_))
        state = reduced.where(open_)
        if most_buckets == 1:
            break
        state = state.withColumn("buckets", F.ceil(F.col("buckets") / fan_in).cast("int"))
        most_buckets, level = -(-most_buckets // fan_in), level + 1
    last = state.withColumn("frac", (_uniform(seed, 77) < F.col("frac")).cast("double"))  # one document a source at most
    out = last
    for part in done:
        out = out.unionByName(part)
    return out.select(*KEYS, "source_size", "target", (F.col("base") + F.col("frac").cast("long")).alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents taken at least once, with a column ``copies``.

    Of rows alike in all columns those with the lowest numbers take the copies that the group has.
    """
    fresh = {name: free_name(docs.columns, name) for name in ("_id", "_key", "_copies", "copies")}
    with scratch(docs.sparkSession) as keep:
        chosen = mix(docs, **options).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list("copies")).alias("copies"))
        chosen = keep(chosen.where(F.array_max("copies") > 0).select(F.col("doc_id").alias(fresh["_id"]), F.col("row_key").alias(fresh["_key"]), F.col("copies").alias(fresh["_copies"])), "mix-chosen")
    count, repeats = chosen.agg(F.count("*"), F.max(F.size(fresh["_copies"]))).first()
    keyed = docs.withColumn(free_name([*docs.columns, *fresh.values()], "_row"), row_key(docs))
    name = keyed.columns[-1]
    few = F.broadcast(chosen) if count <= BROADCAST_IDS else chosen
    taken = keyed.join(few, keyed["doc_id"].eqNullSafe(chosen[fresh["_id"]]) & (keyed[name] == chosen[fresh["_key"]]))
    if (repeats or 0) > 1:
        taken = taken.dropDuplicates(["doc_id", name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return taken.select(*columns, F.explode(fresh["_copies"]).alias(fresh["copies"])).where(F.col(fresh["copies"]) > 0)
