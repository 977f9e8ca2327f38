import io

import numpy as np
import pytest
from planted import GRID, GRID_CENTERS, center_error, frame, planted, sites
from pyspark.sql import functions as F

from robustclust.functions import ranks
from robustclust.operators import coresets, costs, estimators, joins, kcenter, kernels, lloyd, partition, samplers, sampling
from robustclust.sources import points as src


def test_grid_costs(spark):
    p = frame(spark, GRID)
    assert costs.means_cost(p, GRID_CENTERS).first()["cost"] == 16
    assert costs.median_cost(p, GRID_CENTERS).first()["cost"] == 16
    assert costs.center_cost(p, GRID_CENTERS, 3).first()["radius"] == 1


def test_partitioners_keep_every_row(spark):
    p = frame(spark, np.random.default_rng(0).normal(size=(11, 2)))
    even = {r["machine_id"]: r["count"] for r in partition.evenly(p, 4).groupBy("machine_id").count().collect()}
    assert even == {0: 2, 1: 2, 2: 2, 3: 5}
    assert partition.evenly(p, 20).count() == 11
    assert partition.arbitrarily(p, 5, 3).count() == 11
    split = partition.split_sites(partition.evenly(p, 2), 3)
    assert split.groupBy("machine_id").count().agg(F.max("count")).first()[0] <= 3 and split.count() == 11


def test_balls_and_neighbours(spark):
    p = frame(spark, planted())
    at = spark.createDataFrame([(0, [5.0, 30.0])], "id long, features array<double>")
    assert {r["id"] for r in joins.ball(p, at, 2).collect()} == set(range(4, 44))
    near = joins.knn(p, at, 41).collect()
    d = sorted(r["dist"] for r in near)
    assert d[-1] == 5 and d[-2] < 1.5
    assert joins.densest_ball(p, 2).first()["mass"] == 40
    far = joins.farthest(p, [[0.0, 30.0]]).first()
    assert far["id"] in (2, 3) and abs(far["dist"] - np.hypot(30, 80)) < 1e-9


def test_diameter_bounds(spark):
    p = frame(spark, planted(outliers=False))
    row = joins.diameter(p, joins.base_points(p, 5)).first()
    assert row["lower"] >= 2 * np.hypot(5, 30) - 2 * np.sqrt(2) and row["upper"] >= 2 * row["lower"] - 1e-9


def test_assignment_paths_agree(spark, monkeypatch):
    p = frame(spark, planted())
    a = {r["id"]: (r["center"], round(r["dist"], 9)) for r in joins.assign(p, GRID_CENTERS).collect()}
    monkeypatch.setattr(joins, "LITERAL_NUMBERS", 0)
    assert a == {r["id"]: (r["center"], round(r["dist"], 9)) for r in joins.assign(p, GRID_CENTERS).collect()}


def test_validation(spark):
    with pytest.raises(ValueError):
        src.validate(frame(spark, [[1.0, 2.0], [1.0]]))
    with pytest.raises(ValueError):
        src.validate(frame(spark, [[float("nan")]]))
    with pytest.raises(src.NotFittedError):
        lloyd.KMeans(2).predict(frame(spark, GRID))
    with pytest.raises(ValueError):
        estimators.DistributedKZCenter(2, 1, algorithm="none").fit(frame(spark, GRID, np.zeros(16)))


def test_lloyd_models(spark):
    plain, noisy = frame(spark, planted(outliers=False)), frame(spark, planted())
    assert center_error(lloyd.KMeans(2, seed=1).fit(plain).centers) <= 3.001
    assert center_error(lloyd.KMedian(2, seed=1).fit(plain).centers) <= 6.001
    start = [[3.0, 20.0], [-3.0, -20.0]]
    model = lloyd.KZMeans(2, 2, init=start).fit(noisy)
    assert center_error(model.centers) <= 3.001 and model.cost(noisy) < model.cost(noisy, 0)
    assert center_error(lloyd.KZMedian(2, 2, init=start).fit(noisy).centers) <= 6.001
    assert model.predict(noisy).count() == 164


@pytest.mark.parametrize("algorithm", ["multiplicative", "additive", "moseley", "random_charikar", "auto"])
def test_distributed_center(spark, algorithm):
    x, site = sites()
    model = estimators.DistributedKZCenter(2, 2, algorithm=algorithm, sample_size=64, seed=3).fit(frame(spark, x, site))
    if algorithm != "random_charikar":  # a uniform sample promises nothing
        assert center_error(model.cluster_centers) <= 6.001
    assert model.communication_cost > 0


def test_random_and_guha(spark):
    x, site = sites()
    p = frame(spark, x, site)
    assert len(estimators.DistributedKZCenter(2, 2, algorithm="random").fit(p).cluster_centers) == 2
    for net in (False, True):
        model = estimators.GuhaDistributedKZCenter(2, 2, rho=1.5, use_epsilon_net=net, return_outliers=net).fit(p)
        assert center_error(model.cluster_centers) <= 6.1  # a blob lies within 6.09 of its center


def test_distributed_means_and_medians(spark):
    x, site = sites()
    p, (plain, plain_site) = frame(spark, x, site), sites(outliers=False)
    clean = frame(spark, plain, plain_site)
    assert center_error(estimators.DistributedKZMeans(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2).fit(p).cluster_centers) <= 6.001
    assert center_error(estimators.DistributedKZMedian(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2).fit(p).cluster_centers) <= 6.001
    assert center_error(estimators.BELDistributedKMeans(n_clusters=2, epsilon=0.3, coreset_ratio=5).fit(clean).cluster_centers) <= 6.001
    assert center_error(estimators.BELDistributedKMedian(n_clusters=2, epsilon=0.3, coreset_ratio=5).fit(clean).cluster_centers) <= 6.001


def test_every_sampled_point_may_become_a_center():
    """Far rows of hardly any weight, and a heavy row in a clump: 1650 candidates."""
    far = np.stack(np.meshgrid(np.arange(50), np.arange(29)), axis=-1).reshape(-1, 2) * 10.0 + 100
    x = np.vstack([np.stack([np.arange(200) / 1000, np.zeros(200)], axis=1), far])
    w = np.where(np.arange(len(x)) < 200, 1.0, 1e-6)
    w[78] = 1000
    model = estimators.DistributedKZMeans(n_clusters=1)
    model._solve([(x, w, np.ones(len(x), bool))], [100.0])
    assert model.cluster_centers.tolist() == [[0.078, 0.0]]


def test_summaries_of_sites(spark):
    x, site = sites()
    rows = coresets.summarize_sites(frame(spark, x, site), 2, 2, 2, beta=0.2).collect()
    kept = {tuple(r["features"]) for r in rows}
    assert (80.0, 0.0) in kept and (-80.0, 0.0) in kept and sum(r["weight"] for r in rows) >= len(x) * 0.9
    model = estimators.CAZDistributedKZMeans(n_clusters=2, n_outliers=2, seed=5).fit(frame(spark, x, site))
    assert len(model.cluster_centers) == 2 and model.cost(frame(spark, x, site)) >= 0


def test_few_points_are_their_own_centers(spark):
    p = frame(spark, GRID[:3], np.array([0, 1, 1]))
    assert len(estimators.DistributedKZCenter(2, 3).fit(p).cluster_centers) == 2


def test_coreset_keeps_outliers(spark):
    x, site = sites()
    p = joins.assign(frame(spark, x, site), [[5.0, 30.0], [-5.0, 30.0], [5.0, -30.0], [-5.0, -30.0]]).withColumn("cost", F.col("dist"))
    drawn = coresets.sample_sites(p, coresets.quotas(p, 40, 4), 1)
    weights = {r["id"]: r["weight"] for r in drawn.collect()}
    assert min(weights, key=weights.get) in (1, 83)
    assert coresets.probabilities(p.select("id", "cost")).agg(F.sum("prob")).first()[0] == pytest.approx(1)


def test_samples(spark):
    p = frame(spark, planted(), np.arange(164) % 3)
    assert sampling.without_replacement(p, 5).count() == 15
    shares = sampling.multinomial_shares(p, 30)
    assert shares.count() == 3 and sampling.with_replacement(p, shares).count() == shares.agg(F.sum("draws")).first()[0]
    heavy = p.withColumn("w", F.when(F.col("id") == 7, 1e9).otherwise(1.0))
    assert {r["id"] for r in sampling.by_weight(heavy, "w", 20).collect()} == {7}


def test_single_site_solver(spark):
    p = frame(spark, planted(5))
    assert center_error(kcenter.KZCenter("brute", 2, 2).fit(p).cluster_centers) <= 0.001
    model = kcenter.KZCenter("greedy_covering", 2, 2, guess=6.01, n_machines=2).fit(frame(spark, planted()))
    assert center_error(model.cluster_centers) <= 6.2 and model.n_covered > 150
    assert kcenter.KZCenter("greedy", 2, 0).fit(p).cost(p, 0) > 0
    with pytest.raises(ValueError):
        kcenter.KZCenter("other", 2, 2)


def test_matrix_files(spark, tmp_path):
    x = np.arange(24, dtype=float).reshape(8, 3)
    np.save(tmp_path / "gas.npy", x)
    np.savez(tmp_path / "covertype.npz", features=np.hstack([x] * 4))
    assert np.allclose(np.array([r["features"] for r in src.dataset(spark, "gas", str(tmp_path)).orderBy("id").collect()]), x)
    assert src.validate(src.dataset(spark, "covertype", str(tmp_path))) == 10
    with pytest.raises(NotImplementedError):
        src.dataset(spark, "unknown", str(tmp_path))


def _mat(name, x):
    def element(kind, body):
        return kind.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body + b"\0" * (-len(body) % 8)

    body = element(6, (6).to_bytes(8, "little")) + element(5, np.array(x.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, x.astype("<f8").tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + b"\0\1IM" + element(14, body)


def test_mat_files(spark, tmp_path):
    x = np.arange(6, dtype=float).reshape(2, 3)
    (tmp_path / "parkinsons.mat").write_bytes(_mat("Features_only", x))
    got = src.dataset(spark, "parkinsons", str(tmp_path)).orderBy("id").collect()
    assert np.allclose(np.array([r["features"] for r in got]), x)
    assert set(src.read_mat(_mat("a", x))) == {"a"} and io.BytesIO


def test_generators(spark):
    p = src.gaussian_mixture(spark, 200, 3, 5, 2, seed=1)
    assert p.where("is_outlier").count() == 5 and p.count() == 200
    more = src.add_outliers(frame(spark, planted()), 4, seed=2)
    assert more.count() == 168 and more.where("is_outlier and source_id is not null").count() == 4


def test_streaming_summaries(spark, tmp_path):
    from robustclust.streaming.summaries import summarizing

    frame(spark, planted()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.SCHEMA).parquet(str(tmp_path / "in"))
    writer = summarizing(stream, str(tmp_path / "out"), 2, 2, sites=2).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    writer.start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("weight >= 1").count() > 0


def test_cost_functions_and_solvers_are_pluggable(spark):
    x, site = sites()
    p = frame(spark, x, site)
    told = []

    def solver(rows, weights, k, z, seed):
        told.append((len(rows), k, z))
        return kernels.lloyd(rows, k, np.clip(weights, 0, None), z, init="random", seed=seed)

    plain = estimators.DistributedKZMeans(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2).fit(p)
    same = estimators.DistributedKZMeans(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2, cost_func=lambda d: d * d).fit(p)
    assert np.allclose(np.sort(plain.cluster_centers, axis=0), np.sort(same.cluster_centers, axis=0)) and plain.cost(p) == pytest.approx(same.cost(p))
    huber = lambda d: (1 + d * d) ** 0.5 - 1
    model = estimators.DistributedKZLp(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2, cost_func=huber).fit(p)
    assert center_error(model.cluster_centers) <= 6.1 and model.cost(p, 2) == pytest.approx(kernels.lp_cost(x, model.cluster_centers, huber, z=2))
    for make in (estimators.DistributedKZMeans, estimators.BELDistributedKMeans, estimators.CAZDistributedKZMeans):
        model = make(n_clusters=2, n_outliers=2, epsilon=0.3, seed=2, central_solver=solver).fit(p)
        assert len(model.cluster_centers) == 2
    assert [t[1] for t in told] == [2, 2, 2] and [t[2] for t in told] == [2, 0, 2]


def test_sampler_objects(spark):
    x, site = sites()
    p = frame(spark, x, site)
    with pytest.raises(src.NotFittedError):
        _ = samplers.Coreset().samples
    core = samplers.Coreset(40, seed=3).fit(p, [[5.0, 30.0], [-5.0, -30.0]])
    assert core.samples.count() == core.sample_weights.count() == core.sample_indices.count() <= 40
    weights = {r["id"]: r["weight"] for r in core.sample_weights.collect()}
    assert sum(weights.values()) == pytest.approx(len(x), rel=1.0)
    many = samplers.DistributedCoreset(60, seed=3).fit(p)
    assert many.samples.join(p, ["id", "features"], "left_semi").count() > 0 and many.center_rows.count() <= 4
    assert many.sample_weights.agg(F.sum("weight")).first()[0] == pytest.approx(len(x))
    one = samplers.SummaryOutliers(n_clusters=2, n_outliers=2, beta=0.2, seed=1).fit(p)
    assert {(80.0, 0.0), (-80.0, 0.0)} <= {tuple(r["features"]) for r in one.samples.collect()} and one.left_over.count() > 0
    parts = samplers.DistributedSummary(n_clusters=2, n_outliers=2, beta=0.2, seed=1).fit(p)
    assert parts.samples.select("machine_id").distinct().count() == 2


def test_dense_balls_are_kept_up_to_date():
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(60, 2)), rng.integers(1, 5, 60).astype(float)
    inside = kernels.distances(x, x) <= 0.8
    balls = kernels.DenseBalls(inside, w)
    for _ in range(5):
        p = balls.heaviest()
        left = np.where(balls.alive, w, 0)
        assert balls.mass[balls.alive] == pytest.approx((inside @ left)[balls.alive]) and (inside @ left)[p] == max((inside @ left)[balls.alive])
        before = balls.mass.copy()
        balls.remove(balls.alive & inside[p])
        assert (balls.mass[~balls.changed] == before[~balls.changed]).all()


@pytest.mark.parametrize("d", [1, 2, 17])
def test_ball_index_loses_no_pair(d):
    rng = np.random.default_rng(d)
    x, q = rng.integers(-3, 4, (700, d)).astype(float), rng.integers(-3, 4, (90, d)).astype(float)
    for radius in (0.0, 1.0, 2.5):
        at, to, dist = kernels.BallIndex(q).within(x, radius, block=64)
        want = kernels.distances(x, q)
        assert sorted(zip(at.tolist(), to.tolist(), strict=True)) == [tuple(r) for r in np.argwhere(want <= radius).tolist()]
        assert np.array_equal(dist, want[at, to])
    assert len(kernels.BallIndex(np.zeros((0, d))).within(x, 1.0)[0]) == 0


def test_blocks_of_queries_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = frame(spark, rng.integers(0, 9, (300, 2)).astype(float))
    some = p.where("id % 3 = 0")
    counts, near = sorted(joins.ball_counts(p, some, 2.0).collect()), sorted(joins.knn(p, some, 4).collect())
    monkeypatch.setattr(joins, "QUERIES_A_BLOCK", 30)
    monkeypatch.setattr(joins, "POINTS_A_BLOCK", 100)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 40)
    assert counts == sorted(joins.ball_counts(p, some, 2.0).collect()) and near == sorted(joins.knn(p, some, 4).collect())
    x = np.array([r["features"] for r in p.orderBy("id").collect()])
    d = kernels.distances(x[::3], x)
    assert counts == [(3 * i, int(n)) for i, n in enumerate((d <= 2.0).sum(axis=1))]
    assert [r["id"] for r in near[:4]] == np.lexsort((np.arange(300), d[0]))[:4].tolist()


def test_ranks_over_many_ranges(spark, monkeypatch):
    """Ranges follow from the rows; a value that most rows share is cut by their ids."""
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 50)
    rows = spark.range(2000).select("id", F.when(F.col("id") % 5 == 0, F.col("id") / 7).otherwise(3.0).alias("v"), (F.col("id") % 4 + 1).alias("w")).repartition(5)
    told = {r["id"]: r for r in rows.collect()}
    for descending in (False, True):
        order = sorted(told, key=lambda i: (-told[i]["v"] if descending else told[i]["v"], i))
        got = {r["id"]: r["n"] for r in ranks.row_numbers(rows, "v", ["id"], "n", descending).collect()}
        assert got == {i: n for n, i in enumerate(order, 1)}
    sums = {r["id"]: r["s"] for r in ranks.running_sum(rows, "v", ["id"], F.col("w"), "s").collect()}
    total = 0
    for i in sorted(told, key=lambda i: (told[i]["v"], i)):
        total += told[i]["w"]
        assert sums[i] == total
    cuts = ranks.range_cuts(rows, "v", "id")
    parts = rows.groupBy(ranks.range_number(cuts, "v", "id").alias("r")).count().collect()
    assert max(r["count"] for r in parts) < 250
    medians = {r["center"]: r["value"] for r in costs.median_update(rows.select(F.lit(0).alias("center"), F.array("v").alias("features"), F.col("w").cast("double").alias("weight"))).collect()}
    half, run = sum(r["w"] for r in told.values()) / 2, 0
    for i in sorted(told, key=lambda i: told[i]["v"]):
        run += told[i]["w"]
        if run >= half:
            assert medians == {0: told[i]["v"]}
            break


def test_many_outliers_are_found_by_rank(spark, monkeypatch):
    p = joins.assign(frame(spark, planted()), GRID_CENTERS)
    want = {r["id"] for r in costs.farthest_rows(p, 30).collect()}
    monkeypatch.setattr(costs, "HEAP_ROWS", 10)
    assert {r["id"] for r in costs.farthest_rows(p, 30).collect()} == want and len(want) == 30


def test_one_site_with_most_rows_is_split_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 40)
    p = frame(spark, np.arange(600, dtype=float).reshape(300, 2), np.where(np.arange(300) % 10 == 0, np.arange(300) % 3, 7))
    split = partition.split_sites(p, 25)
    sizes = [r["count"] for r in split.groupBy("machine_id").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 25 + 11  # the last part of a site takes the remainder
    drawn = sampling.with_replacement(p, spark.createDataFrame([(7, 50), (1, 5)], "machine_id int, draws int"), 3).collect()
    site = {r["id"]: r["machine_id"] for r in p.collect()}
    assert len(drawn) == 55 and all(site[r["id"]] == r["machine_id"] for r in drawn)


def test_weighted_samples_over_many_ranges(spark, monkeypatch):
    p = frame(spark, np.random.default_rng(2).normal(size=(300, 2))).withColumn("weight", (1 + F.col("id") % 3).cast("double"))
    want = sorted(map(tuple, sampling.by_weight(p, "weight", 40, 3).collect()))
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 50)
    assert len(want) == 40 and sorted(map(tuple, sampling.by_weight(p, "weight", 40, 3).collect())) == want
    exact = ranks.running_sum(p.select("id", F.lit(1).cast("decimal(5,1)").alias("one")), "id", [], F.col("one"), "s")
    assert [int(r["s"]) for r in exact.orderBy("id").collect()] == list(range(1, 301))


def test_cover_of_a_point_set_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 3))
    p = frame(spark, x)
    want = kernels.cover(x, np.ones(400), 4, 0.5, 2, 2.1)
    for block in (20_000, 70):
        monkeypatch.setattr(joins, "QUERIES_A_BLOCK", block)
        got = kcenter.cover(p, 4, 0.5, 2, 2.1).orderBy("pick").collect()
        assert [r["id"] for r in got] == want.picks.tolist() and [r["mass"] for r in got] == want.weights.tolist()
    assert kcenter.cover(p, 4, 100.0).collect()[0]["mass"] == 400 and kcenter.cover(p, 4, 100.0).count() == 1


@pytest.mark.parametrize("algorithm", sorted(estimators.WHOLE_SITES))
def test_large_sites_send_what_small_ones_do(spark, algorithm):
    x = np.round(np.random.default_rng(4).normal(size=(300, 2)), 1)
    x[200:] = x[:100]
    p = src.with_sites(frame(spark, x), 3).repartition(5)
    make = lambda most: estimators.DistributedKZCenter(2, 4, algorithm=algorithm, seed=1, local_data_size=most).fit(p)
    small, large = make(10_000), make(20)
    assert small.communication_cost == large.communication_cost == 3 * 6 * (3 if algorithm == "moseley" else 2)
    assert np.array_equal(small.centers, large.centers)


def test_picks_are_counted_over_tasks(spark, monkeypatch):
    x = np.round(np.random.default_rng(7).normal(size=(90, 2)), 1)
    x[60:] = x[:30]
    p = frame(spark, x).withColumn("machine_id", F.when(F.col("id") < 84, F.col("id") % 2).otherwise(5).cast("int")).repartition(4)
    monkeypatch.setattr(kcenter, "BLOCK_ROWS", 7)
    got = kcenter.counted_picks(p, 9, 2)
    for m, ids in ((0, range(0, 84, 2)), (1, range(1, 84, 2)), (5, range(84, 90))):
        own = x[list(ids)]
        order, _ = kernels.farthest_first(own, 9, 0)
        owner, _ = kernels.nearest(own, own[order])
        mine = [r for r in got if r["machine_id"] == m]
        assert [r["features"] for r in mine] == own[order].tolist()
        assert [r["weight"] for r in mine] == np.bincount(owner, minlength=len(order)).tolist()
