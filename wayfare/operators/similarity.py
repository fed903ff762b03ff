"""Dynamic time warping between resampled trajectories, for all pairs of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import points as src
from .blocks import Table, against, rounded
from .bounding import kernel

#: Eight intervals of a seven-day window, so nine samples: its end is one of them.
START, STEP, SAMPLES = 1704067200 + 5 * 86400, 7 * 86400 // 8, 9
#: Pairs that are warped at once.
AT_ONCE = 10_000


def _cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points, which the last axis holds."""
    x, y = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    return np.sqrt(x * x + y * y)


def dtw(q: np.ndarray, o: np.ndarray) -> np.ndarray:
    """DTW with Euclidean cost of pairs of sequences, arrays of (pairs, samples, 2): two rolling rows of the matrix."""
    pairs, m = o.shape[:2]
    row = np.full((pairs, m + 1), np.inf)
    row[:, 0] = 0
    for i in range(q.shape[1]):
        cost = _cost(q[:, i : i + 1], o)
        best = np.minimum(row[:, 1:], row[:, :-1])
        new = np.full((pairs, m + 1), np.inf)
        for j in range(m):
            new[:, j + 1] = cost[:, j] + np.minimum(best[:, j], new[:, j])
        row = new
    return row[:, -1]


def alignment(q: np.ndarray, o: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of samples of the cheapest warping path of two sequences (samples, 2); at equal cost the diagonal, then the query, goes on."""
    n, m = len(q), len(o)
    full = np.full((n + 1, m + 1), np.inf)
    full[0, 0] = 0
    for i in range(n):
        cost = _cost(q[i], o)
        for j in range(m):
            full[i + 1, j + 1] = cost[j] + min(full[i, j], full[i, j + 1], full[i + 1, j])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda at: full[at])
    return path[::-1]


def paths(q: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, step, i, j) of the alignments of pairs of sequences, arrays of (pairs, samples, 2)."""
    count, n, m = len(o), q.shape[1], o.shape[1]
    full = np.full((n + 1, m + 1, count), np.inf)
    full[0, 0] = 0
    for i in range(n):
        for j in range(m):
            full[i + 1, j + 1] = _cost(q[:, i], o[:, j]) + np.minimum(np.minimum(full[i, j], full[i, j + 1]), full[i + 1, j])
    pair, i, j, back = np.arange(count), np.full(count, n), np.full(count, m), []
    length = np.zeros(count, np.int64)
    while len(pair):
        back.append((pair, i - 1, j - 1))
        length[pair] += 1
        straight, up, left = full[i - 1, j - 1, pair], full[i - 1, j, pair], full[i, j - 1, pair]
        best = np.minimum(np.minimum(straight, up), left)
        to_straight = straight == best
        i, j = i - (to_straight | (up == best)), j - (to_straight | (up != best))
        more = (i > 0) & (j > 0)
        pair, i, j = pair[more], i[more], j[more]
    at, step = np.concatenate([p for p, _, _ in back]), np.concatenate([length[p] - 1 - k for k, (p, _, _) in enumerate(back)])
    return at, step, np.concatenate([i for _, i, _ in back]), np.concatenate([j for _, _, j in back])


def _pairs(q: Table, s: Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of queries and objects that live at the same time, with their samples: arrays of (pairs, samples, 2).

    The object is resampled at the query's times. For each sample before its life or after it there are two copies
    of its first or last point; an object that lives between two samples has only these.
    """
    positions = lambda t, rows, low, high: np.stack([np.stack([t[f"{c}{i}"][rows] for i in range(low, high + 1)], axis=1) for c in "xy"], axis=2)
    kinds = np.stack([q["low"], q["high"]], axis=1).astype(int)
    for low, high in np.unique(kinds, axis=0):
        asked = np.flatnonzero((kinds == (low, high)).all(axis=1))
        qs, qe = START + low * STEP, START + high * STEP
        lives = np.flatnonzero((s["ft"] < qe) & (s["lt"] > qs))
        if high < low or not len(lives):
            continue
        early, late = (2 * np.ceil(np.maximum(0.0, v) / STEP).astype(int) for v in (s["ft"][lives] - qs, qe - s["lt"][lives]))
        shapes = np.stack([early, np.maximum(s["low"][lives], low).astype(int), np.minimum(s["high"][lives], high).astype(int), late], axis=1)
        whole = positions(q, asked, low, high)
        for shape in np.unique(shapes, axis=0):
            rows = lives[(shapes == shape).all(axis=1)]
            before, first, last, after = shape
            ends = [np.repeat(np.stack([s[f"{e}x"][rows], s[f"{e}y"][rows]], axis=1)[:, None], k, axis=1) for e, k in (("f", before), ("l", after))]
            alive = [positions(s, rows, first, last)] if last >= first else []
            o = np.concatenate([ends[0], *alive, ends[1]], axis=1)
            step = max(1, AT_ONCE // len(rows))
            for at in range(0, len(asked), step):
                some = asked[at : at + step]
                yield np.repeat(some, len(rows)), np.tile(rows, len(some)), np.repeat(whole[at : at + step], len(rows), axis=0), np.tile(o, (len(some), 1, 1))


@kernel
def _distances(q: Table, s: Table) -> Iterator[Table]:
    for i, j, a, b in _pairs(q, s):
        yield {"qid": q["traj_id"][i], "traj_id": s["traj_id"][j], "dist": rounded(dtw(a, b), 6)}


@kernel
def _paths(q: Table, s: Table) -> Iterator[Table]:
    for i, j, a, b in _pairs(q, s):
        at, *steps = paths(a, b)
        order = np.lexsort((steps[0], at))
        yield {"qid": q["traj_id"][i[at[order]]], "traj_id": s["traj_id"][j[at[order]]]} | {c: v[order].astype(np.int32) for c, v in zip(("step", "i", "j"), steps, strict=True)}


def resampled(pts: DataFrame) -> DataFrame:
    """traj_id, i, x, y: positions at SAMPLES even times, where the trajectory is alive, its last instant included."""
    seg = src.segments(pts).withColumn("last", F.max("t2").over(Window.partitionBy("traj_id")))
    lo = F.greatest(F.lit(0), F.ceil((F.col("t1") - START) / STEP))
    until = (F.col("t2") - START) / STEP
    hi = F.least(F.lit(SAMPLES - 1), F.when(F.col("t2") == F.col("last"), F.floor(until)).otherwise(F.ceil(until) - 1))
    rows = seg.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")}).filter("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    f = (F.lit(START) + F.col("i") * STEP - F.col("t1")) / (F.col("t2") - F.col("t1"))
    return rows.select("traj_id", "i", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y"))


def lives(pts: DataFrame) -> DataFrame:
    """traj_id, first, last: the points (t, x, y) between which each trajectory lives."""
    point = F.struct("t", "x", "y")
    return pts.groupBy("traj_id").agg(F.min(point).alias("first"), F.max(point).alias("last")).filter("first.t < last.t")


def sampled(pts: DataFrame) -> DataFrame:
    """A row for each trajectory: its samples, the numbers of the first and the last, and the points between which it lives."""
    places = [F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c}{k}") for k in range(SAMPLES) for c in "xy"]
    r = resampled(pts).groupBy("traj_id").agg(F.min("i").alias("low"), F.max("i").alias("high"), *places)
    ends = [F.col(f"{end}.{c}").alias(f"{end[0]}{c}") for end in ("first", "last") for c in "txy"]
    # no sample: from one after the last to one before the first
    missing = {"low": F.coalesce("low", F.lit(SAMPLES)), "high": F.coalesce("high", F.lit(-1))}
    return lives(pts).join(r, "traj_id", "left").withColumns(missing).select("traj_id", "low", "high", *ends, *(f"{c}{k}" for k in range(SAMPLES) for c in "xy"))


def _against(pts: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """The query trajectories (id divisible by 50) that have samples, against all that live in their time."""
    s = sampled(pts)
    return against(s.filter("traj_id % 50 = 0 AND high >= 0"), s, fn, schema, "ft")


def rmdtw(pts: DataFrame) -> DataFrame:
    """qid, traj_id, dist: the warping distances."""
    return _against(pts, _distances, "qid long, traj_id long, dist double")


def dtw_path(pts: DataFrame) -> DataFrame:
    """qid, traj_id, step, i, j: the warping paths, by number of sample."""
    return _against(pts, _paths, "qid long, traj_id long, step int, i int, j int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rmdtw(src.points(spark, sf_dir))

    def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Window.partitionBy("qid").orderBy("dist", "traj_id")
        return pairwise(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn <= 6")

    def path(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dtw_path(src.points(spark, sf_dir))

    return {"rmdtw_pairwise": pairwise, "knn_rmdtw": knn, "dtw_path": path}


#: DuckDB: the matrix cell by cell, row after row, in a recursive query.
_CTES = f"""n AS (SELECT unnest(generate_series(0, {SAMPLES - 1})) AS i), ats AS (SELECT i, {START} + i * {STEP} AS t0 FROM n),
sm AS (SELECT traj_id, i, x1 + (x2 - x1) * (t0 - t1) / (t2 - t1) AS x, y1 + (y2 - y1) * (t0 - t1) / (t2 - t1) AS y FROM ats JOIN seg ON t1 <= t0 AND (t0 < t2 OR t0 = t2 AND NOT has_next)),
r AS (SELECT traj_id, list({{'i': i, 'x': x, 'y': y}} ORDER BY i) AS p FROM sm GROUP BY traj_id),
lf AS (SELECT traj_id, min(t) AS ts, max(t) AS te, first(x ORDER BY t, x, y) AS fx, first(y ORDER BY t, x, y) AS fy, last(x ORDER BY t, x, y) AS lx, last(y ORDER BY t, x, y) AS ly FROM points GROUP BY traj_id HAVING min(t) < max(t)),
ob AS (SELECT lf.*, r.p FROM lf LEFT JOIN r ON lf.traj_id = r.traj_id),
pr AS (SELECT q.traj_id AS qid, o.traj_id, q.p AS q, (SELECT count(*) FROM ats WHERE i BETWEEN q.p[1].i AND q.p[-1].i AND t0 < ts) AS early, (SELECT count(*) FROM ats WHERE i BETWEEN q.p[1].i AND q.p[-1].i AND t0 > te) AS late,
 list_filter(coalesce(o.p, []), lambda z: z.i BETWEEN q.p[1].i AND q.p[-1].i) AS o, fx, fy, lx, ly FROM r q CROSS JOIN ob o WHERE q.traj_id % 50 = 0 AND ts < {START} + q.p[-1].i * {STEP} AND te > {START} + q.p[1].i * {STEP}),
pd AS (SELECT qid, traj_id, q, list_concat(list_transform(range(2 * early), lambda k: {{'i': -1::BIGINT, 'x': fx, 'y': fy}}), o, list_transform(range(2 * late), lambda k: {{'i': -1::BIGINT, 'x': lx, 'y': ly}})) AS o FROM pr),
dp AS (SELECT qid, traj_id, q, o, 0 AS k, CAST([] AS DOUBLE[]) AS d FROM pd
 UNION ALL SELECT qid, traj_id, q, o, k + 1, list_append(d, sqrt(power(q[k // len(o) + 1].x - o[k % len(o) + 1].x, 2) + power(q[k // len(o) + 1].y - o[k % len(o) + 1].y, 2)) + CASE WHEN k = 0 THEN 0 ELSE
  least(CASE WHEN k >= len(o) THEN d[k - len(o) + 1] ELSE 1e300 END, CASE WHEN k % len(o) > 0 THEN d[k] ELSE 1e300 END, CASE WHEN k >= len(o) AND k % len(o) > 0 THEN d[k - len(o)] ELSE 1e300 END) END) FROM dp WHERE k < len(q) * len(o)),
fin AS (SELECT qid, traj_id, round(d[-1], 6) AS dist FROM dp WHERE k = len(q) * len(o))"""
DUCK = {
    "rmdtw_pairwise": f"WITH RECURSIVE {_CTES} SELECT qid, traj_id, dist FROM fin",
    "knn_rmdtw": f"WITH RECURSIVE {_CTES}, w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, traj_id) AS rn FROM fin) SELECT qid, traj_id, dist, rn FROM w WHERE rn <= 6",
}
