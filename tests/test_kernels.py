import numpy as np
import pytest
from planted import CENTERS, center_error, planted, weights

from robustclust.operators import kernels


@pytest.mark.parametrize("weighted", [False, True])
def test_brute_finds_the_planted_centers(weighted):
    x = planted(5)
    chosen, _, sizes = kernels.brute_center(x, 2, 2, weights(x) if weighted else None)
    assert center_error(x[chosen]) <= 0.001
    if not weighted:
        assert sorted(sizes) == [11, 11]


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_charikar(grid, seed):
    x = planted(seed=seed)
    found, radius = kernels.charikar(x, 2, 2, weights(x), grid=grid, seed=seed)
    assert center_error(kernels.padded(found.centers, x, 2)) <= 6.001
    assert found.covered >= weights(x).sum() - 2 - 1e-6 and radius > 0


def test_duplicates_and_single_points_do_not_stall():
    x = np.zeros((6, 2))
    found, _ = kernels.charikar(x, 2, 1)
    assert np.allclose(found.centers[0], 0)
    assert len(kernels.padded(kernels.charikar(x[:1], 2, 0)[0].centers, x[:1], 2)) == 1


def test_farthest_first_covers():
    x = planted(outliers=False)
    order, d = kernels.farthest_first(x, 2, 0)
    assert len(order) == 2 and d.max() < 16.2


def test_covering():
    x = planted()
    assert center_error(kernels.covering(x, np.ones(len(x)), 6.01, 2, 2, 2, 0.1).centers) <= 6.2


@pytest.mark.parametrize("seed", range(3))
def test_means_and_medians(seed):
    plain, noisy = planted(outliers=False), planted()
    start = np.array([[3.0, 20.0], [-3.0, -20.0]])
    assert center_error(kernels.lloyd(plain, 2, weights(plain), seed=seed)) <= 3.001
    assert center_error(kernels.lloyd(noisy, 2, weights(noisy), 2, init=start)) <= 3.001
    assert center_error(kernels.lloyd(plain, 2, weights(plain), center=kernels.weighted_median, seed=seed)) <= 6.001
    assert center_error(kernels.lloyd(noisy, 2, weights(noisy), 2, kernels.weighted_median, start)) <= 6.001


def test_lower_weighted_median():
    assert kernels.weighted_median(np.array([[1.0], [2.0]]), np.array([1.0, 1.0]))[0] == 1
    assert kernels.weighted_median(np.array([[1.0], [2.0], [9.0]]), np.array([1.0, 1.0, 5.0]))[0] == 9
    assert kernels.weighted_mean(np.array([[1.0]]), np.array([0.0])) is None


def test_costs():
    x = np.array([[0.0], [1.0], [10.0]])
    assert kernels.lp_cost(x, np.array([[0.0]]), 2) == 101
    assert kernels.lp_cost(x, np.array([[0.0]]), 2, z=1) == 1
    assert kernels.lp_cost(x, np.array([[0.0]]), 2, z=1, limit=4) == 1


def test_minmax_facilities_pick_the_blobs():
    x = planted(10, outliers=False)
    open_, value = kernels.minmax_facilities([x, x], [np.ones(len(x))] * 2, [100.0, 400.0], x, 2, 0, 2)
    assert len(open_) == 2 and center_error(x[open_]) <= 6.001 and value > 0


def test_reverse_greedy_gives_up_when_every_closing_costs_too_much():
    costs = np.array([[0.0, 100.0], [100.0, 0.0]])
    assert kernels.reverse_greedy(costs, np.ones(2), np.zeros(2, int), 1, 1, 10.0) is None


@pytest.mark.parametrize("kept", [2, 3, 32])
def test_reverse_greedy_equals_the_plain_version(monkeypatch, kept):
    monkeypatch.setattr(kernels, "NEAREST_KEPT", kept)
    rng = np.random.default_rng(kept)
    for bound in (3.0, 20.0, 1e6):
        costs, w, site = rng.random((90, 60)), rng.uniform(-0.2, 2, 90), rng.integers(0, 4, 90)
        open_, urgency = list(range(60)), np.ones(4)
        while open_ is not None and len(open_) > 3:
            near = np.sort(costs[:, open_], axis=1)
            table = np.zeros((4, len(open_)))
            np.add.at(table, (site, costs[:, open_].argmin(axis=1)), w * (near[:, 1] - near[:, 0]))
            fits = np.flatnonzero((table <= bound / 2).all(axis=0))
            if len(fits):
                at = fits[(urgency @ table[:, fits]).argmin()]
                urgency *= (1 + 1 / bound) ** np.clip(table[:, at], 0, 50 * bound)
                open_.pop(at)
            else:
                open_ = None
        got = kernels.reverse_greedy(costs, w, site, 4, 3, bound)
        assert (got is None) == (open_ is None) and (got is None or got.tolist() == open_)


def test_summary_accounts_for_every_row():
    x, ids = planted(), np.arange(164)
    for augmented in (False, True):
        got, w, rounds = kernels.outlier_summary(x, ids, 2, 2, 2, 0.2, 0, augmented)
        assert len(got) == len(w) == len(rounds) and len(set(got)) == len(got)
        assert {2, 3} <= set(got.tolist())


def test_lower_hull_and_budgets():
    assert kernels.lower_hull([(0, 0), (1, 5), (2, 1), (4, 4)]) == [(0, 0), (2, 1), (4, 4)]
    assert kernels.budget_grid(3, 2) == [0, 2, 3] and kernels.budget_grid(0, 2) == [0]


def test_truth_shape():
    assert CENTERS.shape == (2, 2)


@pytest.mark.parametrize("n", [1, 63, 64, 130])
def test_counted_balls_pick_what_weighed_ones_do(n):
    """Rows that repeat, so that masses tie; weights of 1 are counted, others are summed."""
    x = np.round(np.random.default_rng(n).normal(size=(n, 2)) * 2)
    for r in (0.0, 0.5, 1.0, 5.0):
        d = kernels.distances(x, x)
        counted, summed = kernels.CountedBalls(d, r), kernels.DenseBalls(d <= r, np.ones(n))
        while summed.alive.any():
            p = counted.heaviest()
            assert p == summed.heaviest()
            gone = summed.alive & (d[p] <= 3 * r)
            counted.remove(gone), summed.remove(gone)


@pytest.mark.parametrize("d", [1, 2, 7, 8, 20])
def test_distances_add_coordinates_in_one_order(d):
    x, c = np.random.default_rng(d).normal(size=(50, d)), np.random.default_rng(d + 1).normal(size=(30, d))
    assert np.array_equal(kernels.distances(x, c), np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2)))
