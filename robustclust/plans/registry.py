"""The registry of queries and their SQL equivalents: every operator on the driver's tables, with explicit parameters.

Where a query names centers by id, those ids are its initial centers; assignment and aggregation run over all points.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustclust.operators import coresets, costs, estimators, joins, kcenter, kernels, lloyd, partition, sampling
from robustclust.plans import sql as q
from robustclust.sources import points as src

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

K, Z, SITES, SEED = 8, 50, 4, 11
LINE_CENTERS = [[5, 10, 2, 2], [15, 20, 4, 4], [25, 30, 6, 6], [35, 40, 8, 2], [45, 50, 2, 6], [10, 60, 5, 1], [30, 70, 1, 5], [48, 90, 9, 8]]


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def emb(spark, d) -> DataFrame:
    return src.table_points(spark, d, "emb")


def events(spark, d, weights: bool = False) -> DataFrame:
    rows = src.with_sites(src.table_points(spark, d, "events2d"), SITES)
    return rows.withColumn("weight", (1 + F.col("id") % 3).cast("double")) if weights else rows


def first_ids(points: DataFrame, k: int = K) -> list:
    return joins.centers_of(points, list(range(k)))


def r6(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


def values(df: DataFrame) -> DataFrame:
    return df.select("center", F.col("pos").cast("int").alias("pos"), r6("value"))


# ---- assignment and distances ------------------------------------------------------------------------------------

E8 = [q.EMB, q.centers("emb", K)]
V8 = [q.EV, q.centers("ev", K)]
EN, VN = [*E8, q.nearest("emb")], [*V8, q.nearest("ev")]
PAIR = "SELECT e.id, c.c AS query_id, {} AS dist FROM emb e, c"


@query(q.with_ctes(EN, "SELECT id, CAST(c AS INT) AS center, round(d, 6) AS dist FROM nr"))
def assign_nearest(spark, d):
    p = emb(spark, d)
    return joins.assign(p, first_ids(p)).select("id", "center", r6("dist"))


_LINE = ", ".join(f"({i}, {[float(v) for v in c]})" for i, c in enumerate(LINE_CENTERS))


@query(
    f"WITH p AS (SELECT row_number() OVER () AS id, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS f FROM lineitem), c(c, cf) AS (VALUES {_LINE}),\n"
    + q.nearest("p")
    + "\nSELECT CAST(c AS INT) AS center, CAST(count(*) AS BIGINT) AS members FROM nr GROUP BY c"
)
def assign_nearest_lineitem_hist(spark, d):
    p = src.table_points(spark, d, "line4d")
    return joins.assign(p, LINE_CENTERS).groupBy("center").agg(F.count("*").alias("members"))


def _pairs(spark, d, kind, p=1.0):
    pts = emb(spark, d)
    return joins.pairs(pts, pts.where(F.col("id") < K), kind, p).select("id", "query_id", r6("dist"))


@query(q.with_ctes(E8, PAIR.format("round(list_distance(e.f, c.cf), 6)")))
def pairwise_dist(spark, d):
    return _pairs(spark, d, "l2")


@query(q.with_ctes(E8, PAIR.format("round(power(list_distance(e.f, c.cf), 2), 6)")))
def pairwise_sqdist(spark, d):
    return _pairs(spark, d, "squared")


@query(q.with_ctes(E8, PAIR.format("round(power(list_distance(e.f, c.cf), 1.5), 6)")))
def pairwise_lp15(spark, d):
    return _pairs(spark, d, "lp", 1.5)


# ---- balls, neighbours, extent -----------------------------------------------------------------------------------


@query(q.with_ctes(E8, "SELECT c.c AS query_id, e.id, round(list_distance(e.f, c.cf), 6) AS dist FROM emb e, c WHERE list_distance(e.f, c.cf) <= 1.3"))
def ball_members(spark, d):
    p = emb(spark, d)
    return joins.ball(p, p.where(F.col("id") < K), 1.3).select("query_id", "id", r6("dist"))


@query(q.with_ctes([q.EMB], "SELECT a.id AS query_id, CAST(count(*) AS BIGINT) AS members FROM emb a, emb b WHERE list_distance(a.f, b.f) <= 1.3 GROUP BY a.id"))
def ball_counts(spark, d):
    p = emb(spark, d)
    return joins.ball_counts(p, p, 1.3)


@query(
    q.with_ctes(
        E8,
        "SELECT query_id, CAST(r AS BIGINT) AS rank, id, round(d, 6) AS dist FROM (SELECT c.c AS query_id, e.id, list_distance(e.f, c.cf) AS d, row_number() OVER (PARTITION BY c.c ORDER BY list_distance(e.f, c.cf), e.id) AS r FROM emb e, c) WHERE r <= 5",
    )
)
def knn_k5(spark, d):
    p = emb(spark, d)
    return joins.knn(p, p.where(F.col("id") < K), 5).select("query_id", "rank", "id", r6("dist"))


@query(q.with_ctes(EN, "SELECT id, round(d, 6) AS dist FROM nr ORDER BY d DESC, id LIMIT 1"))
def farthest_point(spark, d):
    p = emb(spark, d)
    return joins.farthest(p, first_ids(p)).select("id", r6("dist"))


_FAR = "far AS (SELECT c.c, max(list_distance(p.f, c.cf)) AS d FROM {} p, c GROUP BY c.c)"


@query(q.with_ctes([q.EMB, q.centers("emb", 5), _FAR.format("emb")], "SELECT round(min(d), 6) AS lower, round(2 * min(d), 6) AS upper FROM far"))
def diameter_bounds(spark, d):
    p = emb(spark, d)
    return joins.diameter(p, first_ids(p, 5)).select(r6("lower"), r6("upper"))


@query(q.with_ctes([q.EV, q.centers("ev", 5), _FAR.format("ev")], "SELECT round(max(d), 6) AS lower, round(2 * min(d), 6) AS upper FROM far"))
def diameter_distributed(spark, d):
    p = events(spark, d)
    return joins.diameter_over_sites(p, first_ids(p, 5)).select(r6("lower"), r6("upper"))


_NEAR = "nb AS (SELECT a.id AS a, b.id AS b FROM emb a, emb b WHERE list_distance(a.f, b.f) <= 1.2)"


@query(q.with_ctes([q.EMB, _NEAR], "SELECT a AS id, CAST(count(*) AS DOUBLE) AS mass FROM nb GROUP BY a ORDER BY mass DESC, id LIMIT 1"))
def densest_ball(spark, d):
    return joins.densest_ball(emb(spark, d), 1.2)


_GONE = "gone AS (SELECT b.id FROM emb a, emb b WHERE a.id = 0 AND list_distance(a.f, b.f) <= 1.35), lf AS (SELECT * FROM emb WHERE id NOT IN (SELECT id FROM gone))"
_LEFT = _NEAR.replace("FROM emb a, emb b", "FROM lf a, lf b")


@query(q.with_ctes([q.EMB, _GONE, _LEFT], "SELECT a AS id, CAST(count(*) AS DOUBLE) AS mass FROM nb GROUP BY a ORDER BY mass DESC, id LIMIT 1"))
def densest_ball_except(spark, d):
    p = emb(spark, d)
    return joins.densest_ball(p, 1.2, removed=joins.ball(p, p.where("id = 0"), 1.35))


_FAC = "fac AS (SELECT vec_id AS id FROM embeddings WHERE label = 3)"


def _facilities(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("label = 3").select(F.col("vec_id").alias("id"))


@query(q.with_ctes([q.EMB, _NEAR, _FAC], "SELECT a AS id, CAST(count(*) AS DOUBLE) AS mass FROM nb WHERE a IN (SELECT id FROM fac) GROUP BY a ORDER BY mass DESC, id LIMIT 1"))
def dense_ball_facilities(spark, d):
    return joins.densest_ball(emb(spark, d), 1.2, facilities=_facilities(spark, d))


@query(q.with_ctes([q.EMB, _NEAR, _FAC], "SELECT a AS id, CAST(count(*) AS DOUBLE) AS mass FROM nb WHERE a IN (SELECT id FROM fac) GROUP BY a HAVING count(*) >= 5 ORDER BY id LIMIT 1"))
def dense_ball_first(spark, d):
    return joins.densest_ball(emb(spark, d), 1.2, facilities=_facilities(spark, d), least=5)


@query(q.with_ctes([q.EMB, _GONE], "SELECT id FROM lf"))
def set_difference(spark, d):
    p = emb(spark, d)
    return partition.without(p, joins.ball(p, p.where("id = 0"), 1.35)).select("id")


# ---- costs -------------------------------------------------------------------------------------------------------


def _cost(df: DataFrame, name: str = "cost", digits: int = 3) -> DataFrame:
    return df.select(F.round(name, digits).alias(name))


@query(q.with_ctes(VN, "SELECT round(sum(d * d), 1) AS cost FROM nr"))
def means_cost(spark, d):
    p = events(spark, d)
    return _cost(costs.means_cost(p, first_ids(p)), digits=1)


@query(q.with_ctes(VN, "SELECT round(sum(d), 3) AS cost FROM nr"))
def median_cost(spark, d):
    p = events(spark, d)
    return _cost(costs.median_cost(p, first_ids(p)))


@query(q.with_ctes(VN, "SELECT round(sum(power(d, 1.5)), 3) AS cost FROM nr"))
def lp_cost_p15(spark, d):
    p = events(spark, d)
    return _cost(costs.lp_cost(p, first_ids(p), 1.5))


@query(q.with_ctes(VN, f"SELECT round(sum(d * d), 1) AS cost FROM (SELECT d FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) > {Z})"))
def means_cost_trimmed(spark, d):
    p = events(spark, d)
    return _cost(costs.means_cost(p, first_ids(p), Z), digits=1)


@query(q.with_ctes(VN, f"SELECT round(sum(w * d), 3) AS cost FROM (SELECT w, d FROM nr QUALIFY row_number() OVER (ORDER BY w * d DESC, id) > {Z})"))
def median_cost_weighted_trimmed(spark, d):
    p = events(spark, d, True)
    return _cost(costs.median_cost(p, first_ids(p), Z))


@query(q.with_ctes(VN, f"SELECT round(sum(w * least(d * d, 400)) - {Z} * 400, 1) AS cost FROM nr"))
def means_cost_threshold(spark, d):
    p = events(spark, d, True)
    return _cost(costs.means_cost(p, first_ids(p), Z, 400), digits=1)


@query(q.with_ctes(VN, "SELECT id, round(w * d * d, 6) AS cost FROM nr"))
def cost_elementwise(spark, d):
    p = events(spark, d, True)
    return costs.point_costs(p, first_ids(p)).select("id", r6("cost"))


@query(q.with_ctes(VN, f"SELECT round(sum(w * d * d), 1) AS cost FROM (SELECT w, d FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) > {Z})"))
def cost_without_farthest(spark, d):
    p = events(spark, d, True)
    return _cost(costs.cost_without(p, first_ids(p), Z), digits=1)


def _kth(rank: int) -> str:
    return q.with_ctes(VN, f"SELECT round(d, 6) AS radius FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) = {rank}")


@query(_kth(Z + 1))
def kzcenter_cost(spark, d):
    p = events(spark, d)
    return _cost(costs.center_cost(p, first_ids(p), Z), "radius", 6)


@query(_kth(int(1.1 * Z) + 1))
def kzcenter_cost_eps(spark, d):
    p = events(spark, d)
    return _cost(costs.center_cost(p, first_ids(p), int(1.1 * Z)), "radius", 6)


@query(q.with_ctes(VN, f"SELECT id, CAST(c AS INT) AS center, row_number() OVER (ORDER BY d DESC, id) <= {Z} AS is_outlier FROM nr"))
def outliers_topz(spark, d):
    p = events(spark, d)
    return costs.mark_outliers(p, first_ids(p), Z).select("id", "center", "is_outlier")


@query(q.with_ctes(VN, "SELECT CAST(c AS INT) AS center, CAST(count(*) AS BIGINT) AS members, CAST(sum(w) AS DOUBLE) AS mass FROM nr GROUP BY c"))
def cluster_sizes(spark, d):
    p = events(spark, d, True)
    return costs.cluster_sizes(p, first_ids(p))


# ---- updates and iterations --------------------------------------------------------------------------------------

_VALUES = "SELECT CAST(c AS INT) AS center, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM uv"
_INLIERS = f"il AS (SELECT * FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) > {Z})"


@query(q.with_ctes([*VN, *q.update("nr", "u", False, "w")], _VALUES))
def weighted_mean_update(spark, d):
    p = events(spark, d, True)
    return values(costs.mean_update(joins.assign(p, first_ids(p))))


@query(q.with_ctes([*VN, *q.update("nr", "u", True, "w")], _VALUES))
def weighted_median_update(spark, d):
    p = events(spark, d, True)
    return values(costs.median_update(joins.assign(p, first_ids(p))))


@query(q.with_ctes([*VN, _INLIERS, *q.update("il", "u", False, "w")], _VALUES))
def kmeansmm_step(spark, d):
    p = events(spark, d, True)
    return values(lloyd.step(p, first_ids(p), Z))


@query(q.with_ctes([*VN, _INLIERS, *q.update("il", "u", True, "w")], _VALUES))
def kmedianmm_step(spark, d):
    p = events(spark, d, True)
    return values(lloyd.step(p, first_ids(p), Z, True))


def center_rows(spark: SparkSession, centers) -> DataFrame:
    rows = [(i, j, float(v)) for i, c in enumerate(centers) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "center int, pos int, value double").select("center", "pos", r6("value"))


def _rounds(spark, p, k, z, median):
    p = p.cache()
    out = center_rows(spark, lloyd.iterate(p, first_ids(p, k), z, median, most=3, tolerance=0))
    p.unpersist()
    return out


@query(q.lloyd("emb", 5, 3))
def kmeans_3iter(spark, d):
    return _rounds(spark, emb(spark, d), 5, 0, False)


@query(q.lloyd("emb", 5, 3, 10))
def kmeansmm_3iter(spark, d):
    return _rounds(spark, emb(spark, d), 5, 10, False)


@query(q.lloyd("ev", 5, 3, 0, True))
def kmedian_3iter(spark, d):
    return _rounds(spark, events(spark, d), 5, 0, True)


@query(q.lloyd("ev", 5, 3, 10, True))
def kmedianmm_3iter(spark, d):
    return _rounds(spark, events(spark, d), 5, 10, True)


# ---- partitioners and samples ------------------------------------------------------------------------------------

_N = "(SELECT count(*) FROM ev)"


def _even(order: str, m: int) -> str:
    return q.with_ctes([q.EV], f"SELECT id, CAST(least((row_number() OVER (ORDER BY {order}) - 1) // ({_N} // {m}), {m - 1}) AS INT) AS machine_id FROM ev")


@query(_even("id", 7))
def partition_even(spark, d):
    return partition.evenly(events(spark, d).drop("machine_id"), 7).select("id", "machine_id")


@query(_even(f"{q.uniform(SEED, 'id')}, id", 7))
def partition_even_shuffled(spark, d):
    return partition.evenly(events(spark, d).drop("machine_id"), 7, SEED).select("id", "machine_id")


_CUTS = f"cut AS (SELECT CAST(floor({q.uniform(SEED, chr(39) + 'cut' + chr(39), 'i')} * {_N}) AS BIGINT) AS at FROM range(0, 4) r(i)), rk AS (SELECT id, row_number() OVER (ORDER BY {q.uniform(SEED, 'id')}, id) AS r FROM ev)"


@query(q.with_ctes([q.EV, _CUTS], "SELECT id, CAST((SELECT count(*) FROM cut WHERE r > cut.at) AS INT) AS machine_id FROM rk"))
def partition_arbitrary(spark, d):
    return partition.arbitrarily(events(spark, d).drop("machine_id"), 5, SEED).select("id", "machine_id")


@query(
    q.with_ctes(
        [q.EV, "s AS (SELECT m, count(*) AS n, CAST(ceil(count(*) / 600.0) AS BIGINT) AS k FROM ev GROUP BY m)", "o AS (SELECT m, n, k, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)"],
        "SELECT id, CAST(b + least((row_number() OVER (PARTITION BY ev.m ORDER BY id) - 1) // greatest(n // k, 1), k - 1) AS INT) AS machine_id FROM ev JOIN o ON ev.m = o.m",
    )
)
def machine_multiply(spark, d):
    return partition.split_sites(events(spark, d), 600).select("id", "machine_id")


@query(q.with_ctes([q.EV], "SELECT m AS machine_id, CAST(f[2] AS INT) AS hour, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY m, f[2]"))
def distinct_counts(spark, d):
    return partition.distinct_counts(events(spark, d).withColumn("hour", F.col("features")[1].cast("int")), "machine_id", "hour")


@query(q.with_ctes([q.EV], f"SELECT m AS machine_id, id FROM ev QUALIFY row_number() OVER (PARTITION BY m ORDER BY {q.uniform(SEED, 'id')}, id) <= 20"))
def sample_wo_replacement(spark, d):
    return sampling.without_replacement(events(spark, d), 20, SEED).select("machine_id", "id")


_RANKED = "rk AS (SELECT m, id, row_number() OVER (PARTITION BY m ORDER BY id) AS r FROM ev), n AS (SELECT m, count(*) AS n FROM ev GROUP BY m)"


@query(
    q.with_ctes(
        [q.EV, _RANKED, f"dr AS (SELECT n.m, CAST(j AS INT) AS draw, CAST(floor({q.uniform(SEED, 'n.m', 'j')} * n.n) AS BIGINT) + 1 AS r FROM n, range(1, 26) g(j))"],
        "SELECT dr.m AS machine_id, draw, rk.id FROM dr JOIN rk ON rk.m = dr.m AND rk.r = dr.r",
    )
)
def sample_with_replacement(spark, d):
    p = events(spark, d)
    sizes = p.select("machine_id").distinct().withColumn("draws", F.lit(25))
    return sampling.with_replacement(p, sizes, SEED).select("machine_id", "draw", "id")


@query(
    q.with_ctes(
        [q.EV, "n AS (SELECT m, count(*) AS n, sum(count(*)) OVER (ORDER BY m) AS hi, sum(count(*)) OVER () AS t FROM ev GROUP BY m)", f"g AS (SELECT n.m, count(*) AS k FROM range(1, 101) r(j) JOIN n ON {q.uniform(SEED, 'j')} * t < hi AND {q.uniform(SEED, 'j')} * t >= hi - n GROUP BY n.m)"],
        "SELECT n.m AS machine_id, CAST(greatest(coalesce(k, 0), 1) AS BIGINT) AS draws FROM n LEFT JOIN g ON n.m = g.m",
    )
)
def sample_multinomial_alloc(spark, d):
    return sampling.multinomial_shares(events(spark, d), 100, SEED)


@query(
    q.with_ctes(
        [q.EV, "cu AS (SELECT id, w, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER () AS t FROM ev)"],
        f"SELECT CAST(j AS BIGINT) AS draw, id FROM range(1, 61) r(j) JOIN cu ON {q.uniform(SEED, 'j')} * t < hi AND {q.uniform(SEED, 'j')} * t >= hi - w",
    )
)
def sample_weighted(spark, d):
    return sampling.by_weight(events(spark, d, True), "weight", 60, SEED)


def _seeding(spark, d, power):
    p = emb(spark, d).cache()
    ids, _ = lloyd.seeded(p, 4, power, SEED, first=0)
    p.unpersist()
    return spark.createDataFrame(list(enumerate(ids)), "pick int, id long")


@query(q.seeding("emb", 4, 2, SEED))
def kmeanspp_init(spark, d):
    return _seeding(spark, d, 2)


@query(q.seeding("emb", 4, 1, SEED))
def kmedianpp_init(spark, d):
    return _seeding(spark, d, 1)


# ---- (k,z)-center ------------------------------------------------------------------------------------------------


@query(q.with_ctes([q.EMB, *q.farthest_first("emb", 6, False)], f"SELECT pick, id, round(d, 6) AS dist FROM ({q.all_picks(6)})"))
def greedy_kcenter_k6(spark, d):
    return kcenter.farthest_first(emb(spark, d), 6, 0).select("pick", "id", r6("dist"))


@query(q.with_ctes([q.EV, *q.farthest_first("ev", 5, True)], f"SELECT m AS machine_id, pick, id, round(d, 6) AS dist FROM ({q.all_picks(5)})"))
def greedy_kcenter_per_site(spark, d):
    return kcenter.farthest_first_sites(events(spark, d), 5).select("machine_id", "pick", "id", r6("dist"))


def _cover_sql(k: int, dense: float, remove: float) -> str:
    parts = [q.EMB, "pd AS (SELECT a.id AS a, b.id AS b, list_distance(a.f, b.f) AS d FROM emb a, emb b)", "a0 AS (SELECT id FROM emb)"]
    for i in range(k):
        live = f"a IN (SELECT id FROM a{i}) AND b IN (SELECT id FROM a{i})"
        parts.append(f"b{i} AS (SELECT a AS id FROM pd WHERE d <= {dense} AND {live} GROUP BY a ORDER BY count(*) DESC, a LIMIT 1)")
        parts.append(f"x{i} AS (SELECT b FROM pd WHERE a = (SELECT id FROM b{i}) AND d <= {remove} AND b IN (SELECT id FROM a{i}))")
        parts.append(f"a{i + 1} AS (SELECT id FROM a{i} WHERE id NOT IN (SELECT b FROM x{i}))")
    rows = " UNION ALL ".join(f"SELECT CAST(0 AS INT) AS machine_id, CAST({i} AS INT) AS pick, (SELECT id FROM b{i}) AS id, CAST((SELECT count(*) FROM x{i}) AS DOUBLE) AS mass" for i in range(k))
    return q.with_ctes(parts, rows)


@query(_cover_sql(4, 1.2, 1.26))
def charikar_cover_fixed_r(spark, d):
    """One site of any size; rounds in which nothing is left have no id."""
    found = kcenter.cover(emb(spark, d), 4, 0.6, 2, 2.1)
    rounds = spark.range(4).select(F.col("id").cast("int").alias("pick"))
    return rounds.join(found, "pick", "left").select(F.lit(0).alias("machine_id"), "pick", "id", F.coalesce("mass", F.lit(0.0)).alias("mass"))


@query(q.covering(23, 20.0, 0.1 * 20 / (3 * SITES)))
def covering_fixed_r(spark, d):
    found = kcenter.covering(events(spark, d), 20.0, 3, 20, SITES, 0.1)
    return found.select("machine_id", "mass", "balls", "covered", F.posexplode("center").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    """WITH x AS (SELECT n_nationkey AS id, [CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS f FROM nation),
e AS (SELECT a.id AS a, b.id AS b, least(list_distance(x.f, a.f), list_distance(x.f, b.f)) AS d, x.id FROM x a, x b, x WHERE a.id < b.id),
r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a, b ORDER BY d DESC, id) AS r FROM e)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d, 6) AS radius FROM r WHERE r = 3 ORDER BY round(d, 9), a, b LIMIT 1"""
)
def brute_kcenter_tiny(spark, d):
    model = kcenter.KZCenter("brute", 2, 2).fit(src.table_points(spark, d, "nation2d"))
    return spark.createDataFrame([(*model.center_ids, round(float(model.radius), 6))], "a long, b long, radius double")


# ---- coresets and summaries --------------------------------------------------------------------------------------

C4 = [q.EV, q.centers("ev", 4), q.nearest("ev"), "co AS MATERIALIZED (SELECT id, m, f, c, d * d AS cost FROM nr)"]
_QUOTA = "st AS (SELECT m, sum(cost) AS sc, sum(sum(cost)) OVER () AS total, greatest(count(*) OVER (), 200 - 4 * count(*) OVER ()) AS t FROM co GROUP BY m), qu AS (SELECT m, sc, total, t, CAST(floor(t * sc / total) AS BIGINT) AS share FROM st)"
_DRAWN = f"cu AS (SELECT m, id, c, cost, sum(cost) OVER (PARTITION BY m ORDER BY id) AS hi FROM co WHERE cost > 0), dr AS (SELECT qu.m, CAST(j AS BIGINT) AS draw, {q.uniform(SEED, 'qu.m', 'j')} * sc AS pos, total, t FROM qu, range(1, 1000) r(j) WHERE j <= share), sm AS (SELECT cu.m, draw, id, c, total / (t * cost) AS w FROM dr JOIN cu ON cu.m = dr.m AND pos < hi AND pos >= hi - cost)"


def _assigned(spark, d):
    p = events(spark, d)
    return joins.assign(p, first_ids(p, 4)).withColumn("cost", F.col("dist") * F.col("dist"))


@query(q.with_ctes(C4, "SELECT id, round(cost / (SELECT sum(cost) FROM co), 9) AS prob FROM co WHERE cost > 0"))
def coreset_probs(spark, d):
    return coresets.probabilities(_assigned(spark, d)).select("id", F.round("prob", 9).alias("prob"))


@query(q.with_ctes([*C4, _QUOTA], "SELECT m AS machine_id, round(sc, 3) AS site_cost, share FROM qu"))
def coreset_quotas(spark, d):
    return coresets.quotas(_assigned(spark, d), 200, 4).select("machine_id", F.round("site_cost", 3).alias("site_cost"), "share")


def _sampled(spark, d):
    rows = _assigned(spark, d)
    return rows, coresets.sample_sites(rows, coresets.quotas(rows, 200, 4), SEED)


@query(q.with_ctes([*C4, _QUOTA, _DRAWN], "SELECT m AS machine_id, draw, id, round(w, 3) AS weight FROM sm"))
def coreset_sample(spark, d):
    return _sampled(spark, d)[1].select("machine_id", "draw", "id", F.round("weight", 3).alias("weight"))


@query(
    q.with_ctes(
        [*C4, _QUOTA, _DRAWN, "s AS (SELECT m, c, sum(w) AS w FROM sm GROUP BY m, c)", "n AS (SELECT m, c, count(*) AS n FROM co GROUP BY m, c)"],
        "SELECT n.m AS machine_id, CAST(n.c AS INT) AS center, round(n - coalesce(w, 0), 3) AS weight FROM n LEFT JOIN s ON n.m = s.m AND n.c = s.c",
    )
)
def coreset_center_weights(spark, d):
    rows, sampled = _sampled(spark, d)
    return coresets.center_weights(rows, sampled).select("machine_id", "center", F.round("weight", 3).alias("weight"))


@query(
    q.with_ctes(
        [*C4, "li AS (SELECT CAST(i AS INT) AS i, power(0.1 * power(1.5, i), 2) AS l FROM range(0, CAST(floor(ln(1000 / 0.1) / ln(1.5)) AS BIGINT)) r(i))"],
        "SELECT i AS guess_id, round(sum(least(cost, l)), 4) AS cost FROM co, li GROUP BY i",
    )
)
def coreset_radius_grid(spark, d):
    limits = coresets.radius_grid(0.1, 1000, 0.5, 2)
    capped = coresets.capped_costs(_assigned(spark, d).select("id", "cost"), limits)
    return capped.groupBy("guess_id").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query(q.summary(5, 20, SITES, SEED, 14, False))
def summary_outliers_full(spark, d):
    return coresets.summarize_sites(events(spark, d), 5, 20, SITES, seed=SEED).select("machine_id", "id", "weight", "round")


@query(q.summary(5, 20, SITES, SEED, 14, True))
def summary_augmented(spark, d):
    return coresets.summarize_sites(events(spark, d), 5, 20, SITES, augmented=True, seed=SEED).select("machine_id", "id", "weight", "round")


# ---- outlier budgets of sites ------------------------------------------------------------------------------------

_GRID = [q.EV, *q.farthest_first("ev", 7, True), f"gr AS (SELECT m, pick - 2 AS q, d AS cost FROM ({q.all_picks(7)}) WHERE pick > 2 UNION ALL SELECT DISTINCT m, 0, 0.0 FROM ev)"]
_LEVEL = "lv AS (SELECT min(cost) AS v FROM (SELECT cost FROM gr ORDER BY cost DESC, m, q LIMIT 9))"


def _grid(spark, d):
    return estimators.marginal_costs(events(spark, d), 2, 4)


@query(q.with_ctes(_GRID, "SELECT m AS machine_id, CAST(q AS INT) AS q, round(cost, 6) AS cost FROM gr"))
def guha_grid(spark, d):
    return _grid(spark, d).select("machine_id", "q", r6("cost"))


@query(q.with_ctes([*_GRID, _LEVEL], "SELECT round(v, 6) AS cost FROM lv"))
def guha_threshold(spark, d):
    return estimators.threshold(_grid(spark, d), 4, SITES, 2).select(r6("cost"))


@query(q.with_ctes([*_GRID, _LEVEL], "SELECT m AS machine_id, CAST(coalesce(max(CASE WHEN cost >= v THEN q END), 0) AS INT) AS outliers FROM gr, lv GROUP BY m"))
def guha_budgets(spark, d):
    grid = _grid(spark, d).cache()
    return estimators.budgets(grid, estimators.threshold(grid, 4, SITES, 2).first()["cost"])


@query(q.with_ctes(_GRID, "SELECT m AS machine_id, CAST(q AS INT) AS q, round(min(cost) OVER (PARTITION BY m ORDER BY q), 6) AS cost FROM gr"))
def guha_running_minimum(spark, d):
    return costs.running_minimum(_grid(spark, d)).select("machine_id", "q", r6("cost"))


_LINE_AT = "CASE WHEN a.q = b.q THEN a.cost ELSE a.cost + (b.cost - a.cost) * (x.q - a.q) / (b.q - a.q) END"


@query(
    q.with_ctes(
        [*_GRID, "gm AS MATERIALIZED (SELECT * FROM gr)"],
        f"SELECT x.m AS machine_id, CAST(x.q AS INT) AS q, round(min({_LINE_AT}), 6) AS cost FROM gm x JOIN gm a ON a.m = x.m AND a.q <= x.q JOIN gm b ON b.m = x.m AND b.q >= x.q GROUP BY x.m, x.q",
    )
)
def lower_hull(spark, d):
    cells: dict = {}
    for r in _grid(spark, d).collect():  # m (z + 1) cells
        cells.setdefault(r["machine_id"], []).append((r["q"], r["cost"]))
    rows = [(s, i, round(float(c), 6)) for s, own in cells.items() for i, c in enumerate(estimators.hull_costs(own, 4))]
    return spark.createDataFrame(rows, "machine_id int, q int, cost double")


# ---- facility location -------------------------------------------------------------------------------------------

_TWO = [q.EMB, "fa AS (SELECT id AS c, f AS cf FROM emb WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 3))"]
_TWO.append("rk AS (SELECT e.id AS client, c, list_distance(e.f, cf) AS d, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.f, cf), c) AS r FROM emb e, fa)")
_TWO.append("tw AS (SELECT client, max(CASE WHEN r = 1 THEN c END) AS first, max(CASE WHEN r = 2 THEN c END) AS second, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM rk WHERE r <= 2 GROUP BY client)")


def _two(spark, d):
    p = emb(spark, d)
    return coresets.first_two(p, partition.within(p, _facilities(spark, d)))


@query(q.with_ctes(_TWO, "SELECT client, first, second, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM tw"))
def facility_first_second_nearest(spark, d):
    return _two(spark, d).select("client", "first", "second", r6("d1"), r6("d2"))


@query(q.with_ctes(_TWO, "SELECT first AS facility, round(sum(d2 - d1), 6) AS increase FROM tw GROUP BY first"))
def facility_removal_costs(spark, d):
    return coresets.closing_costs(_two(spark, d)).select("facility", r6("increase"))


_NATION = "na AS (SELECT n_nationkey AS id, [CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS f FROM nation)"
_CAPPED = "SELECT p.id, l, least(min(power(list_distance(p.f, c.f), 2)), l) AS v FROM na p, {}, (VALUES (4.0), (16.0)) g(l) GROUP BY p.id, l"


@query(q.with_ctes([_NATION, f"ea AS ({_CAPPED.format('(SELECT f FROM na WHERE id < 3) c')})"], "SELECT round(max(v), 6) AS cost FROM (SELECT l, sum(v) - 2 * l AS v FROM ea GROUP BY l)"))
def facility_minmax_cost(spark, d):
    """The cost that the min-max location minimises, of given facilities; client sets and facilities are coordinator-sized."""
    rows = src.table_points(spark, d, "nation2d").orderBy("id").collect()
    x = np.array([r["features"] for r in rows], float)
    value = kernels.minmax_value([x, x], [np.ones(len(x))] * 2, [4.0, 16.0], x[:3], 2, 2)
    return spark.createDataFrame([(round(float(value), 6),)], "cost double")


# ---- communication -----------------------------------------------------------------------------------------------


@query(q.with_ctes([q.EV], f"SELECT CAST(2 * count(*) AS BIGINT) AS numbers FROM (SELECT id FROM ev QUALIFY row_number() OVER (PARTITION BY m ORDER BY {q.uniform(SEED, 'id')}, id) <= 25)"))
def comm_cost_random(spark, d):
    sample = sampling.without_replacement(events(spark, d), 25, SEED)
    return sample.agg(F.sum(F.size("features")).cast("long").alias("numbers"))


@query(q.with_ctes([*C4, _QUOTA], "SELECT CAST(sum(share) * 3 + count(*) * 4 * 3 AS BIGINT) AS numbers FROM qu"))
def comm_cost_coreset(spark, d):
    shares = coresets.quotas(_assigned(spark, d), 200, 4)
    return shares.agg((F.sum("share") * 3 + F.count("*") * 4 * 3).cast("long").alias("numbers"))


# ---- estimators --------------------------------------------------------------------------------------------------


#: what every estimator promises on ``events``: centers among its values, and a cost within a factor of the first rows' cost
_BOX = "bx AS (SELECT min(f[1]) AS a0, max(f[1]) AS a1, min(f[2]) AS b0, max(f[2]) AS b1 FROM ev)"
_SENT = {
    "random": "(SELECT CAST(2 * sum(least(n, 23)) AS BIGINT) FROM (SELECT count(*) AS n FROM ev GROUP BY m))",
    "moseley": "(SELECT CAST(3 * sum(least(n, 23)) AS BIGINT) FROM (SELECT count(*) AS n FROM ev GROUP BY m))",
}


def _fit_sql(first: str, sent: str = "") -> str:
    """center, pos, low, high, baseline, inside, within (and communication_cost, if it follows from the table) a center."""
    parts = [q.EV, q.centers("ev", 3), q.nearest("ev"), _BOX]
    return q.with_ctes(
        parts,
        f"SELECT CAST(i AS INT) AS center, CAST(j AS INT) AS pos, round(CASE WHEN j = 0 THEN a0 ELSE b0 END, 6) AS low, round(CASE WHEN j = 0 THEN a1 ELSE b1 END, 6) AS high, round({first}, 3) AS baseline, true AS inside, true AS within{sent} "
        "FROM range(0, 3) x(i), range(0, 2) y(j), bx",
    )


_RADIUS = "(SELECT d FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) = {})"
_TRIMMED = "(SELECT sum(power(d, {})) FROM (SELECT d FROM nr QUALIFY row_number() OVER (ORDER BY d DESC, id) > {}))"


def _checked(spark, d, model, gone: int, factor: float, power: int | None, sent: bool) -> DataFrame:
    """The fitted centers' ranges and costs: ``inside`` if the center's coordinate is among the values, ``within`` if the
    model's cost without ``gone`` rows is at most ``factor`` times that of the first three rows as centers."""
    p = events(spark, d).cache()
    centers = np.asarray(model.fit(p).cluster_centers, float)
    base = first_ids(p, 3)
    cost = costs.center_cost(p, base, gone) if power is None else costs.cost_without(p, base, gone, power)
    baseline = cost.first()[0]
    box = p.agg(*[f(F.col("features")[j]).alias(f"{n}{j}") for j in range(2) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    within = bool(model.cost(p, gone) <= factor * baseline + 1e-9)
    rows = []
    for i, c in enumerate(centers.tolist()):
        for j, v in enumerate(c):
            low, high = box[f"lo{j}"], box[f"hi{j}"]
            rows.append((i, j, round(low, 6), round(high, 6), round(baseline, 3), low - 1e-9 <= v <= high + 1e-9, within, *([int(model.communication_cost)] if sent else [])))
    p.unpersist()
    return spark.createDataFrame(rows, "center int, pos int, low double, high double, baseline double, inside boolean, within boolean" + (", communication_cost long" if sent else ""))


def _estimator(name: str, make, gone: int, factor: float, power: int | None = None, sent: str | None = None):
    def run(spark, d):
        return _checked(spark, d, make(), gone, factor, power, sent is not None)

    run.__name__ = name
    first = _RADIUS.format(gone + 1) if power is None else _TRIMMED.format(power, gone)
    query(_fit_sql(first, f", {_SENT[sent]} AS communication_cost" if sent else ""))(run)


for _a, _factor, _sent in (("multiplicative", 1.5, None), ("additive", 1.5, None), ("moseley", 1.5, "moseley"), ("random", 3, "random"), ("random_charikar", 3, "random"), ("auto", 1.5, None)):
    _estimator(f"fit_kzcenter_{_a}", lambda a=_a: estimators.DistributedKZCenter(3, 20, algorithm=a, delta=0.1, seed=SEED), 22, _factor, None, _sent)
_estimator("fit_guha", lambda: estimators.GuhaDistributedKZCenter(3, 20, seed=SEED), 22, 1.5)
_estimator("fit_guha_net", lambda: estimators.GuhaDistributedKZCenter(3, 20, seed=SEED, use_epsilon_net=True, return_outliers=True), 22, 1.5)
_estimator("fit_caz_means", lambda: estimators.CAZDistributedKZMeans(n_clusters=3, n_outliers=20, seed=SEED), 20, 1, 2)
_estimator("fit_caz_median", lambda: estimators.CAZDistributedKZMedian(n_clusters=3, n_outliers=20, seed=SEED), 20, 1, 1)
_estimator("fit_kzmeans", lambda: estimators.DistributedKZMeans(n_clusters=3, n_outliers=20, seed=SEED), 20, 1, 2)
_estimator("fit_kzmedian", lambda: estimators.DistributedKZMedian(n_clusters=3, n_outliers=20, seed=SEED), 20, 1, 1)
_estimator("fit_bel_means", lambda: estimators.BELDistributedKMeans(n_clusters=3, epsilon=0.3, seed=SEED), 0, 1, 2)
_estimator("fit_bel_median", lambda: estimators.BELDistributedKMedian(n_clusters=3, epsilon=0.3, seed=SEED), 0, 1, 1)

_BEST = (
    "co AS (SELECT a.id AS a, b.id AS b, c.id AS c, l, sum(least(power(least(list_distance(p.f, a.f), list_distance(p.f, b.f), list_distance(p.f, c.f)), 2), l)) - 2 * l AS v "
    "FROM na p, na a, na b, na c, (VALUES (4.0), (16.0)) g(l) WHERE a.id < b.id AND b.id < c.id GROUP BY a.id, b.id, c.id, l)"
)


@query(q.with_ctes([_NATION, _BEST], "SELECT CAST(3 AS INT) AS facilities, round(min(v), 6) AS optimum, true AS within FROM (SELECT max(v) AS v FROM co GROUP BY a, b, c)"))
def fit_robust_fl(spark, d):
    """The min-max location on the nations, against the best of all triples."""
    p = src.table_points(spark, d, "nation2d")
    chosen, value = estimators.robust_facility_location([p, p], p, [4.0, 16.0], 3, 2, 2)
    best = min_over_triples(p, [4.0, 16.0], 2, 2)
    return spark.createDataFrame([(len(chosen), round(best, 6), bool(best - 1e-9 <= value <= 3 * best))], "facilities int, optimum double, within boolean")


def min_over_triples(points: DataFrame, limits: list[float], z: float, p: float) -> float:
    """The least min-max cost of three facilities among a few points: all triples are tried."""
    x = np.array([r["features"] for r in points.orderBy("id").collect()], float)
    each = [np.ones(len(x))] * len(limits)
    return min(kernels.minmax_value([x] * len(limits), each, limits, x[list(t)], z, p) for t in combinations(range(len(x)), 3))


@query(q.with_ctes(E8, "SELECT CAST(i AS INT) AS center, true AS is_row, true AS covers FROM range(0, 4) x(i)"))
def local_charikar(spark, d):
    """Centers of the single-site solver: each is a row, and the balls of the radius found cover all but the outliers.

    A table of more rows than a site holds is sampled to one by hash, as the solver is for one bounded site.
    """
    p = emb(spark, d)
    n, most = p.count(), 10_000
    site = p if n <= most else p.orderBy(F.xxhash64("id"), "id").limit(most)
    model = kcenter.KZCenter("charikar_grid", 4, 10).fit(site)
    rows = {tuple(r["features"]) for r in site.join(F.broadcast(spark.createDataFrame([(c.tolist(),) for c in model.cluster_centers], "features array<double>")), "features", "left_semi").collect()}
    reach = costs.center_cost(site, model.cluster_centers.tolist(), 10).first()["radius"]
    covers = bool(reach <= 4 * model.radius + 1e-9)
    return spark.createDataFrame([(i, tuple(c.tolist()) in rows, covers) for i, c in enumerate(model.cluster_centers)], "center int, is_row boolean, covers boolean")


# ---- generators --------------------------------------------------------------------------------------------------


_MEANS, _SHARES = [[0.0, 0.0, 0.0], [40.0, 0.0, 10.0], [0.0, 40.0, -10.0], [-40.0, 5.0, 30.0]], [0.4, 0.3, 0.2, 0.1]
_FAR_OFF = sum(sum(v * v for v in m) ** 0.5 for m in _MEANS) / 4 + 1
_CLUSTER = "CASE WHEN u >= 0.9 THEN 3 WHEN u >= 0.7 THEN 2 WHEN u >= 0.4 THEN 1 ELSE 0 END"


def _mixture_sql(seed: int = SEED) -> str:
    means = ", ".join(str([float(v) for v in m]) for m in _MEANS)
    parts = [
        f"b AS (SELECT range AS id, {q.uniform(seed, 'range')} AS u, row_number() OVER (ORDER BY {q.uniform(seed + 2, 'range')}, range) <= 20 AS o FROM range(0, 2000))",
        f"cl AS (SELECT id, o, {_CLUSTER} AS cluster FROM b)",
        f"v AS (SELECT id, o, cluster, pos, [{means}][cluster + 1][pos + 1] + {q.normal(seed + 1, 'id', 'pos')} * {(50 / 15) ** 0.5} AS x, {q.normal(seed + 3, 'id', 'pos')} * {(50 * _FAR_OFF) ** 0.5} AS shift FROM cl, range(0, 3) g(pos))",
    ]
    return q.with_ctes(parts, "SELECT id, CAST(cluster AS INT) AS cluster, o AS is_outlier, CAST(pos AS INT) AS pos, round(x + CASE WHEN o THEN shift ELSE 0 END, 6) AS value FROM v")


@query(_mixture_sql())
def gaussian_mixture_rows(spark, d):
    rows = src.gaussian_mixture(spark, 2000, 4, 20, 3, means=_MEANS, shares=_SHARES, seed=SEED)
    return rows.select("id", "cluster", "is_outlier", F.posexplode("features").alias("pos", "value")).withColumn("value", F.round("value", 6))


def _outliers_sql(seed: int = SEED) -> str:
    parts = [
        q.EV,
        "s AS (SELECT avg(sqrt(f[1] * f[1] + f[2] * f[2])) AS m, max(id) AS top FROM ev)",
        f"dr AS (SELECT id AS source_id, f, row_number() OVER (ORDER BY {q.uniform(seed, 'id')}, id) AS n FROM ev QUALIFY n <= 20)",
        "nu AS (SELECT top + n AS id, source_id, f, m FROM dr, s)",
        f"mv AS (SELECT id, source_id, pos, f[pos + 1] + {q.normal(seed + 1, 'source_id', 'pos')} * sqrt(10 * m) AS value FROM nu, range(0, 2) g(pos))",
    ]
    old = "SELECT id, false AS is_outlier, CAST(-1 AS BIGINT) AS source_id, CAST(pos AS INT) AS pos, round(f[pos + 1], 6) AS value FROM ev, range(0, 2) g(pos)"
    return q.with_ctes(parts, f"{old} UNION ALL SELECT id, true, source_id, CAST(pos AS INT), round(value, 6) FROM mv")


@query(_outliers_sql())
def add_outliers_rows(spark, d):
    rows = src.add_outliers(events(spark, d).drop("machine_id"), 20, seed=SEED)
    return rows.select("id", "is_outlier", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.posexplode("features").alias("pos", "value")).withColumn("value", F.round("value", 6))
