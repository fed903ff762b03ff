"""Boxes, points, segments, intervals and moving regions; statistics and workloads: (Spark SQL or None, DuckDB SQL) by name.

Where there is no Spark SQL, the query goes in blocks of pairs (`pairs.py`).

The two sides of a query are written apart where there is more than one way to say it.
Regions move by their corner and their velocity, which is wider by SPREAD to each side, so that they never shrink.
"""

from __future__ import annotations

from .regions import DAY, DAY0

CENTRE, ANGLE, SIDE, SPREAD = 50, 0.5, 5, 1e-5
FROM, TO = DAY0 + 5 * DAY, DAY0 + 12 * DAY

BOXES3 = """m AS (SELECT traj_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(t) AS t0, max(t) AS t1 FROM points GROUP BY traj_id),
p AS (SELECT a.traj_id AS qid, b.traj_id, a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, a.t0 AS at0, a.t1 AS at1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1, b.t0 AS bt0, b.t1 AS bt1
 FROM m a CROSS JOIN m b WHERE a.traj_id % 50 = 0)"""
_GAP_CASE = lambda v: f"CASE WHEN a{v}0 > b{v}1 THEN a{v}0 - b{v}1 WHEN b{v}0 > a{v}1 THEN b{v}0 - a{v}1 ELSE 0 END"
_BOX_REST = f"""round((bx1 - bx0) * (by1 - by0) * (bt1 - bt0) / {DAY}, 4) AS volume, round(4 * (bx1 - bx0 + by1 - by0 + (bt1 - bt0) / {DAY}), 5) AS margin,
 round((bx0 + bx1) / 2, 5) AS xc, round((by0 + by1) / 2, 5) AS yc, round((bt0 + bt1) / 2, 2) AS tc"""
BOX_DUCK = f"""WITH {BOXES3} SELECT qid, traj_id, round(sqrt(power({_GAP_CASE('x')}, 2) + power({_GAP_CASE('y')}, 2) + power(({_GAP_CASE('t')}) / {DAY}, 2)), 6) AS distance,
 ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 AND at0 <= bt1 AND bt0 <= at1 AS meets, ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1 AND at0 <= bt0 AND bt1 <= at1 AS holds, false AS touches, {_BOX_REST},
 round(CASE WHEN ax0 > bx1 OR bx0 > ax1 OR ay0 > by1 OR by0 > ay1 THEN 0e0 ELSE (list_sort([ax0, ax1, bx0, bx1])[3] - list_sort([ax0, ax1, bx0, bx1])[2]) * (list_sort([ay0, ay1, by0, by1])[3] - list_sort([ay0, ay1, by0, by1])[2]) END, 5) AS shared,
 round((list_max([ax1, bx1]) - list_min([ax0, bx0])) * (list_max([ay1, by1]) - list_min([ay0, by0])), 5) AS combined FROM p"""

POINTS = f"""SELECT traj_id, round(t, 3) AS t, round(x + {CENTRE}, 6) AS sum_x, round(y - {CENTRE}, 6) AS diff_y,
 round({CENTRE} + (x - {CENTRE}) * cos({ANGLE}e0) - (y - {CENTRE}) * sin({ANGLE}e0), 6) AS turned_x, round({CENTRE} + (x - {CENTRE}) * sin({ANGLE}e0) + (y - {CENTRE}) * cos({ANGLE}e0), 6) AS turned_y,
 round(sqrt(power(x - {CENTRE}, 2) + power(y - {CENTRE}, 2)), 6) AS distance FROM points"""

#: Signed distance of a point from the line of a segment, positive to the right of its way; the angle of the ray across it.
_SIGNED = lambda px, py: f"CASE WHEN x1 = x2 THEN CASE WHEN y1 < y2 THEN x1 - {px} ELSE {px} - x1 END WHEN y1 = y2 THEN CASE WHEN x1 < x2 THEN {py} - y1 ELSE y1 - {py} END ELSE ((x1 - {px}) * (y2 - y1) - (x2 - x1) * (y1 - {py})) / sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) END"
SEGMENTS = f"""SELECT traj_id, seg_no, round({_SIGNED(CENTRE, CENTRE)}, 6) AS signed, round(greatest({', '.join(_SIGNED(x, y) for x in (40, 60) for y in (40, 60))}), 6) AS most,
 round(CASE WHEN x1 = x2 THEN 0e0 WHEN y1 = y2 THEN pi() / 2 ELSE atan(-(x1 - x2) / (y1 - y2)) END, 6) AS angle FROM seg"""

#: The periods from low to high with each kind of ends: whether one lies in the other and whether they meet.
KINDS = "SELECT 'closed' AS kind, TRUE AS lc, TRUE AS hc UNION ALL SELECT 'open', FALSE, FALSE UNION ALL SELECT 'left_open', FALSE, TRUE UNION ALL SELECT 'right_open', TRUE, FALSE"
PERIODS = """n AS (SELECT CAST(seg_no AS INT) AS i FROM seg WHERE traj_id = 0 AND seg_no < 6),
a AS (SELECT 2 AS low, 4 AS high, kind AS a_kind, lc AS alc, hc AS ahc FROM kinds), b AS (SELECT l.i AS b_low, h.i AS b_high, kind AS b_kind, lc AS blc, hc AS bhc FROM n l CROSS JOIN n h CROSS JOIN kinds WHERE h.i >= l.i)"""
INTERVAL_SPARK = f"""WITH kinds AS ({KINDS}), {PERIODS} SELECT a_kind, b_low, b_high, b_kind,
 (low < b_low OR low = b_low AND (alc OR NOT blc)) AND (high > b_high OR high = b_high AND (ahc OR NOT bhc)) AS holds,
 (low < b_high OR low = b_high AND alc AND bhc) AND (b_low < high OR b_low = high AND blc AND ahc) AS meets FROM a CROSS JOIN b"""
INTERVAL_DUCK = f"""WITH kinds AS ({KINDS}), {PERIODS} SELECT a_kind, b_low, b_high, b_kind,
 NOT (b_low < low OR b_high > high OR (b_low = low AND blc AND NOT alc) OR (b_high = high AND bhc AND NOT ahc)) AS holds,
 NOT (b_high < low OR high < b_low OR (b_high = low AND NOT (bhc AND alc)) OR (high = b_low AND NOT (ahc AND blc))) AS meets FROM a CROSS JOIN b"""

#: Moving regions, by pairs whose times overlap: the query trajectories' with all; each of four conditions is p + q t <= 0.
MOVING = f"""mv AS (SELECT traj_id, seg_no, t1, t2, x1, y1, (x2 - x1) / (t2 - t1) AS vx, (y2 - y1) / (t2 - t1) AS vy FROM seg),
ma AS (SELECT *, {{SLAB}} AS slab FROM mv WHERE traj_id % 50 = 0), mb AS (SELECT *, {{SLAB}} AS slab FROM mv),
pr AS (SELECT q.traj_id AS qid, q.seg_no AS q_no, s.traj_id, s.seg_no, greatest(q.t1, s.t1) AS u, least(q.t2, s.t2) AS v, q.t1 AS a0, s.t1 AS b0, q.x1 AS ax, q.y1 AS ay, s.x1 AS bx, s.y1 AS by_, q.vx AS avx, q.vy AS avy, s.vx AS bvx, s.vy AS bvy, q.t2 AS ae, s.t2 AS be
 FROM ma q JOIN mb s ON {{GUARD}} AND q.traj_id <> s.traj_id AND s.t1 < q.t2 AND s.t2 > q.t1)"""
#: All with all.
MOVING_ALL = MOVING.replace(" FROM mv WHERE traj_id % 50 = 0)", " FROM mv)")
_POS = lambda w, axis, sign, t: f"({w}{'y_' if w == 'b' and axis == 'y' else axis} {sign} {SIDE} + ({w}v{axis} {sign} {SPREAD}) * ({t} - {w}0))"
#: Low of one above high of the other, at both ends of the common time.
_COND = [(low, high, axis) for axis in "xy" for low, high in (("a", "b"), ("b", "a"))]
_AT = lambda low, high, axis, t: f"({_POS(low, axis, '-', t)} - {_POS(high, axis, '+', t)})"
_CONDS = ", ".join(f"{_AT(lo, hi, a, t)} AS c{i}{t}" for i, (lo, hi, a) in enumerate(_COND) for t in "uv")
#: A region of half-side 4 * SIDE holds one of half-side 1 for the whole of the other's time.
_IN = lambda t: " AND ".join(f"abs(b{v}{'_' if v == 'y' else ''} + bv{v} * ({t} - b0) - a{v} - av{v} * ({t} - a0)) + 1 <= {4 * SIDE}" for v in "xy")
#: When the regions meet, by the roots of each condition as lines in time.
_P = lambda i: f"(c{i}u - (c{i}v - c{i}u) / (v - u) * u)"
_Q = lambda i: f"((c{i}v - c{i}u) / (v - u))"
MEETS_DUCK = f"""WITH {MOVING_ALL}, cd AS (SELECT row_number() OVER () AS k, qid, q_no, traj_id, seg_no, u, v, {_CONDS} FROM pr),
lc AS ({' UNION ALL '.join(f'SELECT k, {_P(i)} AS p, {_Q(i)} AS q, c{i}u <= 0 AS u_ok, c{i}v <= 0 AS v_ok FROM cd' for i in range(4))}),
sp AS (SELECT k, max(CASE WHEN NOT u_ok THEN -p / q END) AS lo, min(CASE WHEN NOT v_ok THEN -p / q END) AS hi, bool_and(u_ok OR v_ok) AS any_ok FROM lc GROUP BY k)
SELECT qid, q_no, traj_id, seg_no, round(coalesce(lo, u), 1) AS t_in, round(coalesce(hi, v), 1) AS t_out FROM cd JOIN sp ON cd.k = sp.k WHERE any_ok AND coalesce(lo, u) < coalesce(hi, v)"""
HOLDS = f"WITH {MOVING} SELECT qid, q_no, traj_id, seg_no FROM pr WHERE u = b0 AND v = be AND {_IN('u')} AND {_IN('v')}"
COMBINED = f"""WITH {MOVING_ALL} SELECT qid, q_no, traj_id, seg_no, round(least({_POS('a', 'x', '-', 'a0')}, {_POS('b', 'x', '-', 'a0')}), 4) AS x_low, round(greatest({_POS('a', 'x', '+', 'a0')}, {_POS('b', 'x', '+', 'a0')}), 4) AS x_high,
 round(least({_POS('a', 'y', '-', 'a0')}, {_POS('b', 'y', '-', 'a0')}), 4) AS y_low, round(greatest({_POS('a', 'y', '+', 'a0')}, {_POS('b', 'y', '+', 'a0')}), 4) AS y_high,
 round(least(avx, bvx) - {SPREAD}, 8) AS vx_low, round(greatest(avx, bvx) + {SPREAD}, 8) AS vx_high, round(least(avy, bvy) - {SPREAD}, 8) AS vy_low, round(greatest(avy, bvy) + {SPREAD}, 8) AS vy_high,
 round(least(a0, b0), 2) AS t_start, round(greatest(ae, be), 2) AS t_end, CASE WHEN u >= greatest(ae, be) THEN NULL ELSE round(u, 2) END AS after_u FROM pr"""

#: The greatest distance of two trajectories at one instant, and the mean over the common time.
APART = """WITH a AS (SELECT *, {SLAB} AS slab FROM seg), b AS (SELECT *, {SLAB} AS slab FROM seg),
c AS (SELECT q.traj_id AS qid, s.traj_id, greatest(q.t1, s.t1) AS u, least(q.t2, s.t2) AS v, q.t1 AS qt, q.x1 AS qx, q.y1 AS qy, (q.x2 - q.x1) / (q.t2 - q.t1) AS qvx, (q.y2 - q.y1) / (q.t2 - q.t1) AS qvy, s.t1 AS st, s.x1 AS sx, s.y1 AS sy, (s.x2 - s.x1) / (s.t2 - s.t1) AS svx, (s.y2 - s.y1) / (s.t2 - s.t1) AS svy
 FROM a q JOIN b s ON {GUARD} AND s.t1 < q.t2 AND s.t2 > q.t1)
SELECT qid, traj_id, round(sqrt(max(greatest(power(qx + qvx * (u - qt) - sx - svx * (u - st), 2) + power(qy + qvy * (u - qt) - sy - svy * (u - st), 2), power(qx + qvx * (v - qt) - sx - svx * (v - st), 2) + power(qy + qvy * (v - qt) - sy - svy * (v - st), 2)))), 5) AS most, count(*) AS pieces, round(sum(v - u), 1) AS together FROM c GROUP BY qid, traj_id"""

#: A stated workload: for each number a trajectory, an instant and a point, by a linear congruence.
WORKLOAD = f"""WITH life AS (SELECT traj_id, min(t) AS ts, max(t) AS te, count(*) AS n, row_number() OVER (ORDER BY traj_id) - 1 AS place FROM points GROUP BY traj_id), every AS (SELECT count(*) AS k FROM life),
w AS (SELECT i, (i * 48271 + 11) % k AS place, ((i * 16807 + 7) % 65536) / 65536e0 AS f FROM (SELECT {{WORK}} AS i) z CROSS JOIN every),
c AS (SELECT i, l.traj_id, ts + f * (te - ts) - 21600 AS a, ts + f * (te - ts) + 21600 AS b, CAST(floor(f * n) AS BIGINT) AS point_no FROM w JOIN life l ON w.place = l.place)"""
SUBTRAJ = f"{WORKLOAD} SELECT i, c.traj_id, s.seg_no, round(greatest(s.t1, a), 2) AS t1, round(least(s.t2, b), 2) AS t2 FROM c JOIN seg s ON s.traj_id = c.traj_id AND s.t1 < b AND s.t2 > a"
RANDOM_POINT = f"{WORKLOAD}, np AS (SELECT traj_id, t, x, y, row_number() OVER (PARTITION BY traj_id ORDER BY t, x, y) - 1 AS no FROM points) SELECT i, c.traj_id, round(np.t, 3) AS t, np.x, np.y FROM c JOIN np ON np.traj_id = c.traj_id AND np.no = c.point_no"
SUB_RANGE = "WITH np AS (SELECT traj_id, t, x, y, row_number() OVER (PARTITION BY traj_id ORDER BY t, x, y) - 1 AS no, count(*) OVER (PARTITION BY traj_id) AS n FROM points) SELECT traj_id, no, round(t, 3) AS t, x, y FROM np WHERE traj_id % 50 = 0 AND no BETWEEN least(10, n - 1) AND least(20, n - 1)"
DIRECTORY = "WITH d AS (SELECT traj_id, count(*) AS n_points FROM points GROUP BY traj_id) SELECT traj_id, n_points, traj_id = max(traj_id) OVER () AS is_last FROM d"
AVERAGES = f"WITH q AS (SELECT traj_id % 8 AS batch, traj_id, count(*) AS hits, max(t2) - min(t1) AS life FROM seg WHERE t1 < {TO} AND t2 > {FROM} GROUP BY traj_id) SELECT batch, count(*) AS queries, round(avg(hits), 6) AS mean_hits, round(avg(life), 2) AS mean_life FROM q GROUP BY batch"
PROFILE_LENGTHS = "SELECT 21600 AS len UNION ALL SELECT 86400 UNION ALL SELECT 259200"
PROFILE = f"""WITH n AS ({PROFILE_LENGTHS}), g AS (SELECT len, traj_id, floor(t / len) AS piece, max(x) - min(x) AS w, max(y) - min(y) AS h, max(t) - min(t) AS dt, max_by(x, t) - min_by(x, t) AS dx, max_by(y, t) - min_by(y, t) AS dy FROM points CROSS JOIN n GROUP BY len, traj_id, floor(t / len))
SELECT len, count(*) AS pieces, round(avg(sqrt(dx * dx + dy * dy) / dt), 9) AS mean_speed, round(avg(w * h), 5) AS mean_box FROM g WHERE dt > 0 GROUP BY len"""
FIND = "SELECT min(i) AS found, count(*) AS n, sum(CAST(i AS BIGINT) * i) AS squares FROM (SELECT {NUMBERS} AS i) z WHERE i % 7 = 3 AND i % 11 = 5"
SHUFFLED = "SELECT id, row_number() OVER (ORDER BY (id * 48271 + 13) % 2147483647, id) AS place FROM boxes"
DRAWN = "SELECT id, (id * 48271 + 13) % 2147483647 % 6 + 1 AS die, round(((id * 48271 + 13) % 2147483647) / 2147483647e0, 9) AS part, (id * 48271 + 13) % 2147483647 % 2 = 0 AS coin FROM boxes"
FIND_ID = "SELECT id, x1, y1, x2, y2 FROM boxes WHERE id = 77"
TIME_COMBINED = f"WITH m AS (SELECT traj_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(t) AS t0, max(t) AS t1 FROM points WHERE t < {DAY0 + 15 * DAY} GROUP BY traj_id) SELECT traj_id, least(x0, 40) AS x0, greatest(x1, 60) AS x1, least(y0, 40) AS y0, greatest(y1, 60) AS y1, round(least(t0, {FROM}), 3) AS t0, round(greatest(t1, {TO}), 3) AS t1, t0 <= {TO} AND t1 >= {FROM} AS meets_in_time FROM m"

#: 64-dimensional points, their regions of side 1 and nearest ones.
ND_DUCK = """WITH q AS (SELECT id AS qid, v AS w FROM vectors WHERE id % 50 = 0), d AS (SELECT qid, id, list_distance(v::DOUBLE[], w::DOUBLE[]) AS dist, list_max(list_transform(list_zip(v, w), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) <= 0.5 AS holds FROM q CROSS JOIN vectors),
r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY round(dist, 5)) AS rk FROM d) SELECT qid, id, round(dist, 5) AS dist, holds FROM r WHERE rk <= 10"""

#: Pieces of exactly a day, cut by interpolation, counted from a trajectory's own start or from the whole second in which the data set starts.
_ORIGINS = {"cut_static_exact": "SELECT traj_id, min(t) AS o FROM points GROUP BY traj_id", "cut_global_exact": "SELECT DISTINCT traj_id, floor((SELECT min(t) FROM points)) AS o FROM points"}
_PIECE_COLUMNS = "round(min(a), 2) AS t_start, round(max(b), 2) AS t_end, round(min(least(xa, xb)), 5) AS xmin, round(max(greatest(xa, xb)), 5) AS xmax, round(min(least(ya, yb)), 5) AS ymin, round(max(greatest(ya, yb)), 5) AS ymax"
_ON = lambda axis, t: f"({axis}1 + ({axis}2 - {axis}1) * ({t} - t1) / (t2 - t1))"
EXACT_SPARK = f"""WITH og AS ({{origins}}), e AS (SELECT s.*, o, explode(sequence(CAST(floor((t1 - o) / {DAY}) AS BIGINT), CAST(ceil((t2 - o) / {DAY}) AS BIGINT) - 1)) AS piece FROM seg s JOIN og ON s.traj_id = og.traj_id),
c AS (SELECT *, greatest(t1, o + piece * {DAY}) AS a, least(t2, o + (piece + 1) * {DAY}) AS b FROM e),
z AS (SELECT traj_id, piece, a, b, {_ON('x', 'a')} AS xa, {_ON('y', 'a')} AS ya, {_ON('x', 'b')} AS xb, {_ON('y', 'b')} AS yb FROM c)
SELECT traj_id, piece, count(*) AS n_lines, {_PIECE_COLUMNS} FROM z GROUP BY traj_id, piece"""
#: The same by knots: the points, and one for each piece on either side of a mark that a segment crosses.
EXACT_DUCK = f"""WITH og AS ({{origins}}), sg AS (SELECT s.*, o, CAST(floor((t1 - o) / {DAY}) AS BIGINT) AS k1, CAST(ceil((t2 - o) / {DAY}) AS BIGINT) - 1 AS k2 FROM seg s JOIN og ON s.traj_id = og.traj_id),
mk AS (SELECT traj_id, t1, t2, x1, x2, y1, y2, o, unnest(generate_series(k1 + 1, k2)) AS k FROM sg),
kn AS (SELECT traj_id, k1 AS piece, t1 AS a, x1 AS xa, y1 AS ya FROM sg UNION ALL SELECT traj_id, k2, t2, x2, y2 FROM sg
 UNION ALL SELECT traj_id, k + side, o + k * {DAY}, {_ON('x', f'(o + k * {DAY})')}, {_ON('y', f'(o + k * {DAY})')} FROM mk CROSS JOIN (SELECT unnest([-1, 0]) AS side) z)
SELECT traj_id, piece, count(*) // 2 AS n_lines, round(min(a), 2) AS t_start, round(max(a), 2) AS t_end, round(min(xa), 5) AS xmin, round(max(xa), 5) AS xmax, round(min(ya), 5) AS ymin, round(max(ya), 5) AS ymax FROM kn GROUP BY traj_id, piece"""

QUERIES: dict[str, tuple[str | None, str]] = {name: (EXACT_SPARK.format(origins=o), EXACT_DUCK.format(origins=o)) for name, o in _ORIGINS.items()} | {
    "box_algebra": (None, BOX_DUCK), "point_algebra": (POINTS, POINTS), "segment_distances": (SEGMENTS, SEGMENTS), "interval_kinds": (INTERVAL_SPARK, INTERVAL_DUCK),
    "moving_regions_meet": (None, MEETS_DUCK), "moving_region_holds": (None, HOLDS), "moving_regions_combined": (None, COMBINED), "farthest_apart": (None, APART),
    "workload_subtrajectories": (SUBTRAJ, SUBTRAJ), "workload_points": (RANDOM_POINT, RANDOM_POINT), "points_by_index": (SUB_RANGE, SUB_RANGE), "traj_directory": (DIRECTORY, DIRECTORY),
    "batch_averages": (AVERAGES, AVERAGES), "sbb_profile_by_length": (PROFILE, PROFILE), "generate_and_find": (FIND, FIND), "seeded_shuffle": (SHUFFLED, SHUFFLED), "seeded_draws": (DRAWN, DRAWN),
    "find_id": (FIND_ID, FIND_ID), "timeregion_combined": (TIME_COMBINED, TIME_COMBINED), "vector_nearest": (None, ND_DUCK),
}
