"""Building blocks of the DuckDB equivalents. They share parameters with the Spark queries, never code that computes."""

from __future__ import annotations

EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
EV = "ev AS (SELECT event_id AS id, [value, CAST(hour(ts) AS DOUBLE)] AS f, CAST(event_id % 4 AS INT) AS m, 1.0 + event_id % 3 AS w FROM events)"


def centers(points: str, k: int) -> str:
    return f"c AS (SELECT id AS c, f AS cf FROM {points} WHERE id < {k})"


def nearest(points: str, name: str = "nr", table: str = "c") -> str:
    """The points with c and d of their nearest center."""
    return (
        f"{name} AS (SELECT * EXCLUDE (cf, r) FROM (SELECT p.*, {table}.c, {table}.cf, list_distance(p.f, {table}.cf) AS d, "
        f"row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.f, {table}.cf), {table}.c) AS r FROM {points} p, {table}) WHERE r = 1)"
    )


def uniform(seed: int, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"(CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 8) AS BIGINT) / 4294967296.0)"


def with_ctes(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def update(source: str, name: str, median: bool, weight: str = "1.0") -> list[str]:
    """(c, pos, v) of the new centers of an assigned table, and name: (c, cf) renumbered from 0."""
    flat = f"{name}f AS (SELECT c, {weight} AS w, unnest(f) AS v, unnest(range(0, len(f))) AS pos FROM {source})"
    if median:
        cum = f"{name}q AS (SELECT c, pos, v, sum(w) OVER (PARTITION BY c, pos ORDER BY v) AS cum, sum(w) OVER (PARTITION BY c, pos) AS total FROM {name}f)"
        value = f"{name}v AS (SELECT c, pos, min(v) AS v FROM {name}q WHERE 2 * cum >= total GROUP BY c, pos)"
        return [flat, cum, value, _lists(name)]
    return [flat, f"{name}v AS (SELECT c, pos, sum(w * v) / sum(w) AS v FROM {name}f GROUP BY c, pos)", _lists(name)]


def _lists(name: str) -> str:
    return f"{name} AS (SELECT dense_rank() OVER (ORDER BY c) - 1 AS c, list(v ORDER BY pos) AS cf FROM {name}v GROUP BY c)"


def lloyd(points: str, k: int, rounds: int, z: int = 0, median: bool = False) -> str:
    """Centers after some rounds from the first k ids, as c, pos, value."""
    base = EMB if points == "emb" else EV
    parts, table = [base, centers(points, k)], "c"
    for t in range(rounds):
        parts.append(nearest(points, f"n{t}", table))
        source = f"n{t}"
        if z:
            parts.append(f"i{t} AS (SELECT * FROM n{t} QUALIFY row_number() OVER (ORDER BY d DESC, id) > {z})")
            source = f"i{t}"
        parts += update(source, f"u{t}", median)
        table = f"u{t}"
    select = f"SELECT CAST(c AS INT) AS center, CAST(unnest(range(0, len(cf))) AS INT) AS pos, round(unnest(cf), 6) AS value FROM {table}"
    return with_ctes(parts, select)


def farthest_first(points: str, k: int, by_site: bool) -> list[str]:
    """g0, g1, ...: m, id, f, d of the picks of each site (or of one site 0); starts at the lowest id."""
    site = "m" if by_site else "0"
    parts = [f"pts AS (SELECT id, f, CAST({site} AS INT) AS m FROM {points})", "g0 AS (SELECT m, id, f, CAST(NULL AS DOUBLE) AS d FROM pts QUALIFY row_number() OVER (PARTITION BY m ORDER BY id) = 1)"]
    parts.append("l0 AS (SELECT p.m, p.id, p.f, list_distance(p.f, g.f) AS d FROM pts p JOIN g0 g ON p.m = g.m)")
    for i in range(1, k):
        parts.append(f"g{i} AS MATERIALIZED (SELECT m, id, f, d FROM l{i - 1} QUALIFY row_number() OVER (PARTITION BY m ORDER BY d DESC, id) = 1)")
        parts.append(f"l{i} AS MATERIALIZED (SELECT p.m, p.id, p.f, least(p.d, list_distance(p.f, g.f)) AS d FROM l{i - 1} p JOIN g{i} g ON p.m = g.m)")
    return parts


def all_picks(k: int) -> str:
    return " UNION ALL ".join(f"SELECT m, CAST({i} AS INT) AS pick, id, d FROM g{i}" for i in range(k))


def seeding(points: str, k: int, power: int, seed: int) -> str:
    """k-means++ (or k-median++) ids: pick, id."""
    parts = [EMB, f"p0 AS (SELECT e.id, e.f, list_distance(e.f, s.f) AS d FROM {points} e, (SELECT f FROM {points} WHERE id = 0) s)"]
    for i in range(1, k):
        parts.append(f"r{i} AS (SELECT id, f, d, power(d, {power}) AS m, sum(power(d, {power})) OVER (ORDER BY id) AS hi, sum(power(d, {power})) OVER () AS t FROM p{i - 1} WHERE d > 0)")
        parts.append(f"s{i} AS (SELECT id, f FROM r{i} WHERE {uniform(seed + i, '1')} * t < hi AND {uniform(seed + i, '1')} * t >= hi - m)")
        parts.append(f"p{i} AS (SELECT p.id, p.f, least(p.d, list_distance(p.f, s.f)) AS d FROM p{i - 1} p, s{i} s)")
    rows = " UNION ALL ".join(["SELECT CAST(0 AS INT) AS pick, CAST(0 AS BIGINT) AS id", *(f"SELECT CAST({i} AS INT) AS pick, id FROM s{i}" for i in range(1, k))])
    return with_ctes(parts, rows)


def summary(k: int, z: int, sites: int, seed: int, rounds: int, augmented: bool) -> str:
    """Outlier summaries of the sites of ``ev``: machine_id, id, weight, round. ``rounds``: more than any site needs."""
    least = 8 * (2 * z // sites)
    draw = f"(CAST('0x' || substr(md5(concat_ws(':', CAST({seed} + m AS VARCHAR), {{}}, {{}})), 1, 8) AS BIGINT) / 4294967296.0)"
    parts = [EV, "l0 AS MATERIALIZED (SELECT m, id, f FROM ev)"]
    for t in range(rounds):
        parts.append(f"z{t} AS MATERIALIZED (SELECT m, count(*) AS n, CAST(floor(2 * greatest(ln(count(*)), {k})) AS BIGINT) AS s FROM l{t} GROUP BY m HAVING count(*) > {least})")
        parts.append(f"r{t} AS MATERIALIZED (SELECT l.m, l.id, l.f, n, row_number() OVER (PARTITION BY l.m ORDER BY id) AS r FROM l{t} l JOIN z{t} z ON l.m = z.m)")
        at = draw.format(f"'{t}'", "CAST(j AS VARCHAR)").replace("+ m AS", "+ z.m AS")
        parts.append(f"s{t} AS MATERIALIZED (SELECT DISTINCT r.m, r.id AS c, r.f AS cf FROM z{t} z, range(1, 1000) g(j), r{t} r WHERE j <= s AND r.m = z.m AND r.r = CAST(floor({at} * z.n) AS BIGINT) + 1)")
        near = f"SELECT r.m, r.id, r.f, s.c, list_distance(r.f, s.cf) AS d, row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.f, s.cf), s.c) AS k FROM r{t} r JOIN s{t} s ON r.m = s.m"
        parts.append(f"n{t} AS MATERIALIZED (SELECT m, id, f, c, d FROM ({near}) WHERE k = 1)")
        rank = f"SELECT m, d, row_number() OVER (PARTITION BY m ORDER BY d) AS k, count(*) OVER (PARTITION BY m) AS n FROM n{t}"
        parts.append(f"q{t} AS MATERIALIZED (SELECT m, d AS q FROM ({rank}) WHERE k = CAST(ceil((n - 1) * CAST(0.45 AS DOUBLE)) AS BIGINT) + 1)")
        parts.append(f"h{t} AS MATERIALIZED (SELECT n.* FROM n{t} n JOIN q{t} q ON n.m = q.m AND n.d <= q.q)")
        parts.append(f"o{t} AS MATERIALIZED (SELECT s.m, s.c AS id, s.cf AS f, greatest(count(h.id), 1) AS w FROM s{t} s LEFT JOIN h{t} h ON h.c = s.c GROUP BY ALL)")
        left = f"SELECT n.m, n.id, n.f FROM n{t} n WHERE n.id NOT IN (SELECT id FROM h{t}) AND n.id NOT IN (SELECT c FROM s{t})"
        parts.append(f"l{t + 1} AS MATERIALIZED (SELECT m, id, f FROM l{t} WHERE m NOT IN (SELECT m FROM z{t}) UNION ALL {left})")
    picks = " UNION ALL ".join(f"SELECT m, id, f, w, {t} AS t FROM o{t}" for t in range(rounds))
    parts.append(f"picks AS MATERIALIZED ({picks})")
    rest = f"SELECT m AS machine_id, id, CAST(1 AS DOUBLE) AS weight, CAST(-1 AS INT) AS round FROM l{rounds}"
    if not augmented:
        return with_ctes(parts, f"SELECT m AS machine_id, id, CAST(w AS DOUBLE) AS weight, CAST(t AS INT) AS round FROM picks UNION ALL {rest}")
    parts.append(f"nl AS (SELECT e.m, (SELECT count(*) FROM l{rounds} l WHERE l.m = e.m) AS n_left, (SELECT count(*) FROM picks p WHERE p.m = e.m) AS n_picks, (SELECT coalesce(max(t), -1) + 1 FROM picks p WHERE p.m = e.m) AS t FROM (SELECT DISTINCT m FROM ev) e)")
    parts.append(f"cv AS MATERIALIZED (SELECT m, id, f FROM ev WHERE id NOT IN (SELECT id FROM l{rounds}))")
    parts.append("grow AS MATERIALIZED (SELECT * FROM nl WHERE n_picks > 0 AND n_left > n_picks)")
    chance = draw.format("'more'", "CAST(c.id AS VARCHAR)").replace("+ m AS", "+ c.m AS")
    parts.append(f"more AS MATERIALIZED (SELECT m, id, f, t FROM (SELECT c.m, c.id, c.f, g.t, n_left - n_picks AS wanted, row_number() OVER (PARTITION BY c.m ORDER BY {chance}, c.id) AS r FROM cv c JOIN grow g ON c.m = g.m WHERE c.id NOT IN (SELECT id FROM picks)) WHERE r <= wanted)")
    parts.append("ap AS MATERIALIZED (SELECT m, id, f, t FROM picks WHERE m IN (SELECT m FROM grow) UNION ALL SELECT m, id, f, t FROM more)")
    parts.append("aw AS MATERIALIZED (SELECT p, count(*) AS w FROM (SELECT c.id, a.id AS p, row_number() OVER (PARTITION BY c.id ORDER BY list_distance(c.f, a.f), a.t, a.id) AS r FROM cv c JOIN ap a ON c.m = a.m) WHERE r = 1 GROUP BY p)")
    grown = "SELECT ap.m AS machine_id, ap.id, CAST(coalesce(aw.w, 0) AS DOUBLE) AS weight, CAST(ap.t AS INT) AS round FROM ap LEFT JOIN aw ON aw.p = ap.id"
    plain = "SELECT m AS machine_id, id, CAST(w AS DOUBLE) AS weight, CAST(t AS INT) AS round FROM picks WHERE m NOT IN (SELECT m FROM grow)"
    return with_ctes(parts, f"{grown} UNION ALL {plain} UNION ALL {rest}")


def covering(picks: int, r: float, least: float) -> str:
    """Greedy covering of the sites of ``ev`` from their first farthest-first picks: machine_id, mass, balls, covered, pos, value."""
    parts = [EV, *farthest_first("ev", picks, True)]
    every = " UNION ALL ".join(f"SELECT m, {i} AS pick, id, f FROM g{i}" for i in range(picks))
    parts.append(f"pk AS MATERIALIZED ({every})")
    parts.append(f"pd AS MATERIALIZED (SELECT k.m, k.pick, k.id AS pid, p.id, list_distance(k.f, p.f) AS d FROM pk k JOIN pts p ON k.m = p.m WHERE list_distance(k.f, p.f) <= {4 * r})")
    parts.append("a0 AS MATERIALIZED (SELECT id FROM pts)")
    for t in range(picks):
        mass = f"SELECT m, pick, count(*) AS w FROM pd WHERE d <= {2 * r} AND id IN (SELECT id FROM a{t}) AND pid IN (SELECT id FROM a{t}) GROUP BY m, pick"
        parts.append(f"b{t} AS MATERIALIZED (SELECT m, pick FROM ({mass}) WHERE w >= {least} QUALIFY row_number() OVER (PARTITION BY m ORDER BY w DESC, pick) = 1)")
        parts.append(f"x{t} AS MATERIALIZED (SELECT pd.m, pd.pick, pd.id FROM pd JOIN b{t} b ON pd.m = b.m AND pd.pick = b.pick WHERE id IN (SELECT id FROM a{t}))")
        parts.append(f"a{t + 1} AS MATERIALIZED (SELECT id FROM a{t} WHERE id NOT IN (SELECT id FROM x{t}))")
    balls = " UNION ALL ".join(f"SELECT m, pick, count(*) AS mass FROM x{t} GROUP BY m, pick" for t in range(picks))
    parts.append(f"bl AS MATERIALIZED ({balls})")
    total = "SELECT m, pick, mass, count(*) OVER (PARTITION BY m) AS balls, sum(mass) OVER (PARTITION BY m) AS covered FROM bl"
    return with_ctes(parts, f"SELECT t.m AS machine_id, CAST(mass AS DOUBLE) AS mass, CAST(balls AS INT) AS balls, CAST(covered AS DOUBLE) AS covered, CAST(u.pos AS INT) AS pos, round(k.f[u.pos + 1], 6) AS value FROM ({total}) t JOIN pk k ON k.m = t.m AND k.pick = t.pick, (VALUES (0), (1)) u(pos)")


def normal(seed: int, *parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(seed, *parts)})) * cos(2 * pi() * {uniform(seed + 7919, *parts)}))"
