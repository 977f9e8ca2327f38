"""NumPy kernels for one site or for the coordinator: inputs are bounded (a site, a summary, a set of centers)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from itertools import combinations

import numpy as np

TOLERANCE, MOST_ITERATIONS = 1e-3, 300


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of x against rows of c, in slices of bounded memory."""
    x, c = np.atleast_2d(x), np.atleast_2d(c)
    out = np.empty((len(x), len(c)))
    step = max(1, (8 << 20) // max(1, c.size))
    for lo in range(0, len(x), step):
        rows = x[lo : lo + step]
        if 0 < c.shape[1] < 8:  # coordinate by coordinate: NumPy adds so few numbers in the same order
            total = np.square(rows[:, :1] - c[:, 0])
            for j in range(1, c.shape[1]):
                total += np.square(rows[:, j : j + 1] - c[:, j])
            np.sqrt(total, out=out[lo : lo + step])
        else:
            out[lo : lo + step] = np.sqrt(((rows[:, None, :] - c[None]) ** 2).sum(axis=2))
    return out


class BallIndex:
    """Rows in order of their widest coordinate: within a radius lie only rows of a slice of it."""

    def __init__(self, q: np.ndarray):
        self.axis = int(q.var(axis=0).argmax()) if q.size else 0
        self.order = np.argsort(q[:, self.axis], kind="stable") if q.size else np.zeros(0, np.int64)
        self.rows = q[self.order]
        self.line = self.rows[:, self.axis] if q.size else np.zeros(0)

    def within(self, x: np.ndarray, radius: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, indexed row, distance) of the pairs within the radius (inclusive)."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(self.rows) and len(x):
            turn = np.argsort(x[:, self.axis], kind="stable")
            reach = radius + 1e-9 * (1 + abs(radius))
            for lo in range(0, len(x), block):
                rows = turn[lo : lo + block]
                a = np.searchsorted(self.line, x[rows[0], self.axis] - reach, "left")
                b = np.searchsorted(self.line, x[rows[-1], self.axis] + reach, "right")
                if a < b:
                    at, to, d = within(x[rows], self.rows[a:b], radius)
                    parts.append((rows[at], self.order[to + a], d))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def within(x: np.ndarray, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of q, distance) of the pairs within a radius: a matrix product finds them, exact distances decide."""
    squares = (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None]
    slack = 1e-9 * (squares.max(initial=0.0) + 1)
    at, to = np.nonzero(squares - 2 * (x @ q.T) <= radius * radius + slack)
    d = np.empty(len(at))
    step = max(1, (4 << 20) // max(1, x.shape[1]))
    for lo in range(0, len(at), step):
        d[lo : lo + step] = np.sqrt(((x[at[lo : lo + step]] - q[to[lo : lo + step]]) ** 2).sum(axis=1))
    inside = d <= radius
    return at[inside], to[inside], d[inside]


def hash_uniform(*parts) -> float:
    """The number in [0, 1) that the column of the same name makes from these parts."""
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, c)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def ones(x: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    return np.ones(len(x)) if weight is None else np.asarray(weight, float)


# ---- centers -----------------------------------------------------------------------------------------------------


def farthest_first(x: np.ndarray, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(indices in picking order, distance of every point to them); of equals the lowest index."""
    picked, least = [first], distances(x, x[first])[:, 0]
    for _ in range(min(k, len(x)) - 1):
        picked.append(int(least.argmax()))
        least = np.minimum(least, distances(x, x[picked[-1]])[:, 0])
    return np.array(picked), least


@dataclass
class Cover:
    centers: np.ndarray
    weights: np.ndarray
    covered: float
    #: rows of the centers
    picks: np.ndarray | None = None


class DenseBalls:
    """The weight of every row's ball, kept up to date as rows go: only what went is subtracted."""

    def __init__(self, inside: np.ndarray, weight: np.ndarray):
        self.inside, self.weight = inside, weight.astype(float)
        self.alive = np.ones(len(weight), bool)
        self.mass = inside @ self.weight
        #: rows whose balls the last removal changed
        self.changed = np.zeros(len(weight), bool)

    def heaviest(self) -> int:
        """The row left with the heaviest ball; of balls equal but for rounding the first."""
        mass = np.where(self.alive, self.mass, -np.inf)
        return int(np.argmax(mass >= mass.max() - 1e-9 * max(1.0, abs(mass.max()))))

    def remove(self, gone: np.ndarray) -> None:
        columns = self.inside[:, gone]
        self.changed = columns.any(axis=1)
        self.mass = self.mass - columns @ self.weight[gone]
        self.alive = self.alive & ~gone


class CountedBalls:
    """As ``DenseBalls`` where every row weighs 1: balls are rows of bits, counted with what is left."""

    def __init__(self, d: np.ndarray, radius: float):
        n = len(d)
        self.alive, self.words = np.ones(n, bool), -(-n // 64)
        self.bits = np.zeros((n, self.words), np.uint64)
        step = max(1, (4 << 20) // max(1, n))
        for lo in range(0, n, step):
            packed = np.packbits(d[lo : lo + step] <= radius, axis=1)
            self.bits.view(np.uint8)[lo : lo + step, : packed.shape[1]] = packed

    def heaviest(self) -> int:
        left = np.zeros(self.words, np.uint64)
        packed = np.packbits(self.alive)
        left.view(np.uint8)[: len(packed)] = packed
        count = np.bitwise_count(self.bits & left).sum(axis=1, dtype=np.int64)
        return int(np.where(self.alive, count, -1).argmax())

    def remove(self, gone: np.ndarray) -> None:
        self.alive = self.alive & ~gone


def raised(d, p):
    """Distances to a power, or what a cost function makes of them; works on arrays and on columns."""
    return p(d) if callable(p) else d**p


def cover(x: np.ndarray, weight: np.ndarray, k: int, r: float, dense: float = 2, remove: float = 4, pairs: np.ndarray | None = None) -> Cover:
    """k rounds: the heaviest ball of radius dense * r among what is left, then the ball of remove * r goes."""
    d = distances(x, x) if pairs is None else pairs
    balls = CountedBalls(d, dense * r) if len(x) and (weight == 1).all() else DenseBalls(d <= dense * r, weight)
    centers, weights = [], []
    for _ in range(k):
        if not balls.alive.any():
            break
        p = balls.heaviest()
        gone = balls.alive & (d[p] <= remove * r)
        centers.append(p)
        weights.append(weight[gone].sum())
        balls.remove(gone)
    return Cover(x[centers], np.array(weights), float(np.sum(weights)), np.array(centers, int))


def radius_bounds(x: np.ndarray, weight: np.ndarray, seed: int = 0, tries: int = 10) -> tuple[float, float]:
    """Least distance to another point over some points, and twice the least farthest distance."""
    rng = np.random.default_rng(seed)
    if len(x) < 2:
        return 1e-9, 1e-9
    base = rng.choice(len(x), min(tries, len(x)), replace=False)
    base[0] = 0 if 0 not in base else base[0]
    chance = np.clip(weight, 0, None)
    chance = chance / chance.sum() if chance.sum() > 0 else None
    near = rng.choice(len(x), min(tries, len(x)), p=chance)
    d = distances(x[near], x)
    d[np.arange(len(near)), near] = np.inf
    high = 2 * distances(x[base], x).max(axis=1).min()
    return max(float(d.min()), high * 1e-6, 1e-12), max(float(high), 1e-12)


def padded(centers: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """At least min(k, n) centers: the farthest points from those there are follow."""
    centers = np.atleast_2d(centers) if len(centers) else x[:1]
    while len(centers) < min(k, len(x)):
        _, d = nearest(x, centers)
        centers = np.vstack([centers, x[d.argmax()]])
    return centers


def charikar(x, k: int, z: float, weight=None, delta: float = 0.05, dense: float = 2, remove: float = 4, guess: float | None = None, grid: bool = False, seed: int = 0):
    """(cover, radius): the best feasible cover of a binary search over radii, or over a geometric grid of them."""
    weight = ones(x, weight)
    low, high = radius_bounds(x, weight, seed)
    pairs, need = distances(x, x), weight.sum() - z
    best: tuple[Cover, float] | None = None

    def feasible(r: float) -> bool:
        nonlocal best
        found = cover(x, weight, k, r, dense, remove, pairs)
        ok = found.covered >= need - 1e-9
        if ok and (best is None or r < best[1]):
            best = (found, r)
        return ok

    if grid:
        radii = low * (1 + delta) ** np.arange(int(np.ceil(np.log(max(high / low, 1)) / np.log1p(delta))) + 2)
        a, b = 0, len(radii) - 1
        probe = int(np.searchsorted(radii, guess)) if guess else (a + b) // 2
        while a <= b:
            probe = min(max(probe, a), b)
            a, b = (a, probe - 1) if feasible(radii[probe]) else (probe + 1, b)
            probe = (a + b) // 2
    else:
        r = guess if guess and low < guess < high else (low + high) / 2
        while True:
            low, high = (low, r) if feasible(r) else (r, high)
            if high <= (1 + delta) * low:
                break
            r = (low + high) / 2
    if best is None:
        feasible(2 * high)
    if best is None:
        best = (cover(x, weight, k, 2 * high, dense, remove, pairs), 2 * high)
    return best


def brute_center(x: np.ndarray, k: int, z: float, weight=None) -> tuple[np.ndarray, float, np.ndarray]:
    """(indices, radius, inlier weight of each): exact over all sets of k points; the farthest go while z allows."""
    weight = ones(x, weight)
    d = distances(x, x)
    best = (None, np.inf, None)
    for chosen in combinations(range(len(x)), min(k, len(x))):
        near = d[:, chosen].min(axis=1)
        order = np.argsort(-near, kind="stable")
        gone = order[: int(np.searchsorted(np.cumsum(weight[order]), z, "left")) + 1] if z > 0 else order[:0]
        kept = np.ones(len(x), bool)
        kept[gone] = False
        radius = near[kept].max() if kept.any() else 0.0
        if radius < best[1] - 1e-12:
            owner = d[:, chosen].argmin(axis=1)
            best = (np.array(chosen), radius, np.bincount(owner[kept], weight[kept], minlength=len(chosen)))
    return best


def covering(x: np.ndarray, weight: np.ndarray, r: float, k: int, z: float, m: int, eps: float, facilities: int | None = None) -> Cover:
    """Greedy covering of a site: balls of 2r of weight eps * z / (k m) or more are taken, and 4r balls removed."""
    threshold = max(eps * z / (k * m), 1e-12)
    most = int(k * m * (1 + 1 / eps)) - m + 1
    picks, _ = farthest_first(x, min(len(x), facilities or int(k + z)), 0)
    d = distances(x[picks], x)
    alive, open_ = np.ones(len(x), bool), np.ones(len(picks), bool)
    centers, weights = [], []
    while alive.any() and len(centers) <= most:
        mass = np.where(open_ & alive[picks], (d <= 2 * r) @ (weight * alive), -1)
        p = int(mass.argmax())
        if mass[p] < threshold:
            break
        gone = alive & (d[p] <= 4 * r)
        centers.append(picks[p])
        weights.append(weight[gone].sum())
        alive[gone] = False
    picked = np.array(centers, int)
    return Cover(x[picked].reshape(len(centers), x.shape[1]), np.array(weights), float(np.sum(weights)), picked)


# ---- Lloyd iterations --------------------------------------------------------------------------------------------


def weighted_mean(x: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    total = w.sum()
    return None if abs(total) < 1e-12 else (x * w[:, None]).sum(axis=0) / total


def weighted_median(x: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Lower weighted median of each coordinate: the first value with half of the weight at or below it."""
    if not len(x):
        return None
    out = np.empty(x.shape[1])
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        total = np.cumsum(w[order])
        out[j] = x[order[min(int(np.argmax(2 * total >= total[-1])), len(order) - 1)], j]
    return out


def seeded_centers(x: np.ndarray, w: np.ndarray, k: int, power: int, seed: int) -> np.ndarray:
    """k-means++ (power 2) or k-median++ (power 1): the first uniform, the rest by weight times distance to the power."""
    rng = np.random.default_rng(seed)
    w = np.clip(w, 0, None)
    picked = [int(rng.integers(len(x)))]
    while len(picked) < min(k, len(x)):
        _, d = nearest(x, x[picked])
        chance = w * d**power
        if chance.sum() <= 0:
            picked.append(int(d.argmax()))
        else:
            picked.append(int(rng.choice(len(x), p=chance / chance.sum())))
    return x[picked]


def lloyd(x, k: int, weight=None, z: int = 0, center: Callable = weighted_mean, init: str | np.ndarray = "++", seed: int = 0, most: int = MOST_ITERATIONS) -> np.ndarray:
    """k-means, k-median and, with z > 0, their versions that leave the z farthest rows out of every update."""
    w = ones(x, weight)
    power = 2 if center is weighted_mean else 1
    if isinstance(init, np.ndarray):
        c = np.array(init, float)
    elif init == "random":
        c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    else:
        c = seeded_centers(x, w, k, power, seed)
    for _ in range(most):
        owner, d = nearest(x, c)
        inlier = np.ones(len(x), bool)
        if z > 0:
            inlier[np.argsort(-d, kind="stable")[: int(z)]] = False
        new = [m for j in range(len(c)) if (at := (owner == j) & inlier).any() and (m := center(x[at], w[at])) is not None]
        if not new:
            break
        new = np.array(new)
        still = len(new) == len(c) and np.linalg.norm(new - c) <= TOLERANCE
        c = new
        if still:
            break
    while len(c) < min(k, len(x)):  # lost clusters restart at the farthest rows that aren't outliers
        _, d = nearest(x, c)
        c = np.vstack([c, x[np.argsort(-d, kind="stable")[min(int(z), len(x) - 1)]]])
    return c


# ---- costs -------------------------------------------------------------------------------------------------------


def lp_cost(x, c, p: float, weight=None, z: int = 0, limit: float | None = None) -> float:
    _, d = nearest(x, c)
    w = ones(x, weight)
    if limit is not None:
        return float((w * np.minimum(raised(d, p), limit)).sum() - z * limit)
    return float(np.sort(w * raised(d, p))[: len(d) - int(z)].sum())


# ---- facility location -------------------------------------------------------------------------------------------


def slices(rows: int, columns: int) -> list[slice]:
    step = max(1, (2 << 20) // max(1, columns))
    return [slice(lo, lo + step) for lo in range(0, rows, step)]


NEAREST_KEPT = 32  # choices of a client held at once; more are found anew once these are closed


class Choices:
    """Clients' costs for all facilities: of each client only the least few are held; all are found in blocks.

    cost(clients, facilities) gives the costs of some clients (rows) for some facilities (columns).
    """

    def __init__(self, cost: Callable, clients: int, facilities: int):
        self.cost, self.facilities = cost, facilities
        self.order, self.costs = self.least(np.arange(clients), np.arange(facilities))

    def least(self, clients: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(facilities, costs): the cheapest open facilities of the clients, in order."""
        few = min(NEAREST_KEPT, len(open_))
        order, least = np.empty((len(clients), few), np.int32), np.empty((len(clients), few))
        for rows in slices(len(clients), len(open_)):
            costs = self.cost(clients[rows], open_)
            near = np.argpartition(costs, few - 1, axis=1)[:, :few] if few < len(open_) else np.tile(np.arange(few), (len(costs), 1))
            own = np.take_along_axis(costs, near, axis=1)
            by = np.argsort(own, axis=1, kind="stable")
            order[rows], least[rows] = open_[np.take_along_axis(near, by, axis=1)], np.take_along_axis(own, by, axis=1)
        return order, least


def reverse_greedy(costs: np.ndarray | Choices, weights: np.ndarray, site: np.ndarray, sets: int, k: int, bound: float) -> np.ndarray | None:
    """Facilities left after closing all but k, or None if every closing would cost some set more than bound / 2.

    costs: clients by facilities; site: the set of each client. Closing moves clients to their second choice; of the
    closable facilities that with the least increase, weighted by the sets' weights, goes, and sets that paid gain weight.
    A closing touches only the clients whose first or second choice it was.
    """
    choices = costs if isinstance(costs, Choices) else Choices(lambda rows, columns: costs[np.ix_(rows, columns)], *costs.shape)
    n = choices.facilities
    open_, urgency = np.ones(n, bool), np.ones(sets)
    if n <= k:
        return np.flatnonzero(open_)
    order, least = choices.order.copy(), choices.costs.copy()
    first, second = order[:, 0].copy(), order[:, 1].copy()
    rise = weights * (least[:, 1] - least[:, 0])
    table = closing_costs(first, rise, site, sets, n)
    closable = (table <= bound / 2).all(axis=0)
    firsts: list[set] = [set() for _ in range(n)]
    seconds: list[set] = [set() for _ in range(n)]
    for i, (a, b) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        firsts[a].add(i)
        seconds[b].add(i)
    for left in range(n - 1, k - 1, -1):
        total = np.where(closable, urgency @ table, np.inf)
        v = int(total.argmin())
        if not np.isfinite(total[v]):
            return None
        urgency *= (1 + 1 / bound) ** np.clip(table[:, v], 0, 50 * bound)
        open_[v] = closable[v] = False
        table[:, v] = 0
        if left == k:
            break
        moved = np.array(sorted(firsts[v] | seconds[v]), np.int64)
        if not len(moved):
            continue
        rest = open_[order[moved]]
        short = moved[rest.sum(axis=1) < 2]
        if len(short):
            found, own = choices.least(short, np.flatnonzero(open_))
            order[short], least[short] = v, np.inf  # v stays closed
            order[short, : found.shape[1]], least[short, : found.shape[1]] = found, own
            rest = open_[order[moved]]
        rows = np.arange(len(moved))
        a = rest.argmax(axis=1)
        rest[rows, a] = False
        b = rest.argmax(axis=1)
        for i, was, then, now, next_ in zip(moved.tolist(), first[moved].tolist(), second[moved].tolist(), order[moved, a].tolist(), order[moved, b].tolist(), strict=True):
            firsts[was].discard(i)
            seconds[then].discard(i)
            firsts[now].add(i)
            seconds[next_].add(i)
        first[moved], second[moved] = order[moved, a], order[moved, b]
        rise[moved] = weights[moved] * (least[moved, b] - least[moved, a])
        for f in np.unique(first[moved]).tolist():
            own = np.array(sorted(firsts[f]), np.int64)
            table[:, f] = np.bincount(site[own], rise[own], sets)
            closable[f] = (table[:, f] <= bound / 2).all()
    return np.flatnonzero(open_)


def minmax_value(clients: list[np.ndarray], weights: list[np.ndarray], limits: list[float], centers: np.ndarray, z: float, p: float) -> float:
    """The greatest of the client sets' costs: sum w * min(d^p, L) - z * L."""
    return max(lp_cost(x, centers, p, w, z, limit) for x, w, limit in zip(clients, weights, limits, strict=True))


def closing_costs(first: np.ndarray, rise: np.ndarray, site: np.ndarray, sets: int, n: int) -> np.ndarray:
    """sets by facilities: what each set pays if a facility closes and its clients go to their second choice."""
    table = np.zeros((sets, n))
    np.add.at(table, (site, first), rise)
    return table


def minmax_facilities(clients: list[np.ndarray], weights: list[np.ndarray], limits: list[float], facilities: np.ndarray, k: int, z: float, p: float) -> tuple[np.ndarray, float]:
    """(facility indices, value): least maximum over client sets of sum w * min(d^p, L) - z * L."""
    sizes = [len(x) for x in clients]
    site, w = np.repeat(np.arange(len(clients)), sizes), np.concatenate(weights)
    x, caps, every = np.concatenate(clients), np.repeat(np.array(limits, float), sizes), np.arange(len(facilities))

    def capped(rows, columns) -> np.ndarray:
        return np.minimum(raised(distances(x[rows], facilities[columns]), p), caps[rows, None])

    nudge = 1e-12 * (1 + max(float(capped(rows, every).max()) for rows in slices(len(x), len(every))))  # ties go to the lower facility
    choices = Choices(lambda rows, columns: capped(rows, columns) + columns * nudge, len(x), len(every))
    k = min(k, len(facilities))
    mass = [lim * np.clip(a, 0, None).sum() for lim, a in zip(limits, weights, strict=True)]
    low, high = max(4 * min(mass), 1e-9), max(8 * max(mass), 2e-9)

    def value(open_: np.ndarray) -> float:
        return minmax_value(clients, weights, limits, facilities[open_], z, p)

    best: tuple[np.ndarray, float] | None = None
    while high / low > 1.01:
        middle = (low + high) / 2
        open_ = reverse_greedy(choices, w, site, len(clients), k, middle)
        if open_ is None:
            low = middle
            continue
        high = middle
        got = value(open_)
        if best is None or got < best[1]:
            best = (open_, got)
    if best is None:
        open_ = reverse_greedy(choices, w, site, len(clients), k, 1e18)
        best = (open_, value(open_))
    return best


# ---- summaries ---------------------------------------------------------------------------------------------------


def outlier_summary(x: np.ndarray, ids: np.ndarray, k: int, z: float, alpha: float, beta: float, seed: int, augmented: bool = False):
    """(ids, weights, rounds): peel off what lies within the beta-quantile distance of a sample until 8 z rows are left.

    Augmented: more of the covered rows join the sample and all covered rows are counted anew; the rest keeps weight 1.
    Draws are hashes of seed, round and number. ``ids`` ascend.
    """
    left = np.arange(len(x))
    picks, weights, rounds, no = [], [], [], 0
    covered = []
    while len(left) > 8 * z and len(left):
        size = int(alpha * max(np.log(len(left)), k))
        s = np.unique([int(hash_uniform(seed, no, j) * len(left)) for j in range(1, max(1, size) + 1)])
        owner, d = nearest(x[left], x[left[s]])
        radius = np.sort(d)[int(np.ceil((len(left) - 1) * beta))]
        near = d <= radius
        count = np.bincount(owner[near], minlength=len(s))
        picks += left[s].tolist()
        weights += np.maximum(count, 1).tolist()
        rounds += [no] * len(s)
        gone = near.copy()
        gone[s] = True
        covered += left[gone].tolist()
        left, no = left[~gone], no + 1
    if augmented and picks and len(left) > len(picks):
        rest = np.setdiff1d(np.array(covered), np.array(picks))
        chance = sorted((hash_uniform(seed, "more", ids[r]), ids[r], r) for r in rest.tolist())
        more = np.array(sorted(r for _, _, r in chance[: len(left) - len(picks)]), int)
        picks += more.tolist()
        rounds += [no] * len(more)
        owner, _ = nearest(x[np.array(covered)], x[np.array(picks)])
        weights = np.bincount(owner, minlength=len(picks)).tolist()
    picks += left.tolist()
    weights += [1] * len(left)
    rounds += [-1] * len(left)
    picks = np.array(picks, int)
    return ids[picks], np.array(weights, float), np.array(rounds, int)


def lower_hull(vertices: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Lower convex hull by x: a monotone chain."""
    chain: list[tuple[float, float]] = []
    for p in sorted(vertices):
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
            chain.pop()
        chain.append(p)
    return chain


def budget_grid(z: int, rho: float) -> list[int]:
    """Outlier budgets 0, rho, rho^2, ... and z."""
    out, q = {0, z}, rho
    while q < z:
        out.add(int(q))
        q *= rho
    return sorted(out)
