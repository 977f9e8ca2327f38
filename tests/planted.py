"""Planted sets: two centers, two far outliers and four blobs around them; and a grid with known costs."""

import numpy as np

CENTERS = np.array([[0.0, 30.0], [0.0, -30.0]])
OUTLIERS = np.array([[80.0, 0.0], [-80.0, 0.0]])
BLOBS = np.array([[5.0, 30.0], [-5.0, 30.0], [5.0, -30.0], [-5.0, -30.0]])
GRID = np.array([[0, 1], [0, -1], [1, 0], [-1, 0], [0, 6], [0, 4], [1, 5], [-1, 5], [5, 1], [5, -1], [6, 0], [4, 0], [5, 6], [5, 4], [6, 5], [4, 5]], float)
GRID_CENTERS = [[0.0, 0.0], [0.0, 5.0], [5.0, 0.0], [5.0, 5.0]]


def planted(size=40, outliers=True, seed=0):
    noise = np.random.default_rng(seed).uniform(-1, 1, (size, 2))
    return np.vstack([CENTERS, *([OUTLIERS] if outliers else []), *(b + noise for b in BLOBS)])


def weights(x, seed=0):
    w = np.random.default_rng(seed + 1).uniform(1, 2, len(x))
    w[:4] = 1
    return w


def sites(size=40, outliers=True, seed=0):
    """(rows, site of each): each site has a center, an outlier and a blob of either side."""
    noise = np.random.default_rng(seed).uniform(-1, 1, (size, 2))
    parts = [[CENTERS[:1], OUTLIERS[:1] if outliers else OUTLIERS[:0], BLOBS[0] + noise, BLOBS[3] + noise], [CENTERS[1:], OUTLIERS[1:] if outliers else OUTLIERS[:0], BLOBS[1] + noise, BLOBS[2] + noise]]
    rows = [np.vstack(p) for p in parts]
    return np.vstack(rows), np.repeat([0, 1], [len(r) for r in rows])


def frame(spark, x, machine=None, weight=None):
    columns = "id long, features array<double>" + (", machine_id int" if machine is not None else "") + (", weight double" if weight is not None else "")
    rows = [(i, [float(v) for v in r], *([int(machine[i])] if machine is not None else []), *([float(weight[i])] if weight is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, columns)


def center_error(centers, truth=CENTERS):
    c = np.atleast_2d(np.array(centers, float))
    return max(float(np.sqrt(((c - t) ** 2).sum(axis=1)).min()) for t in truth)
