"""All registered queries and the SQL that must give the same rows.

A query is SQL over the relations points, seg and boxes, which Spark gets as DataFrames. Interval joins
carry a time slab as an equi-key in Spark (each pair meets once, in the slab of the later
start), so they are hash joins; the SQL to compare with is the plain theta join.
Query sets are the rows whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import cutters, index, linking, similarity
from ..sources import points as src
from ..streaming import live
from . import bounds, geometry, grid, pairs, ranges, regions, similar

#: 2024-01-01; windows below are days after it.
DAY0 = 1704067200
DAY = 86400

DUCK = """points AS (SELECT user_id AS traj_id, epoch(ts) AS t, value AS x, CAST(props->>'k' AS DOUBLE) AS y FROM events),
seg0 AS (SELECT traj_id, row_number() OVER w - 1 AS seg_no, t AS t1, x AS x1, y AS y1, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2,
         lead(t, 2) OVER w IS NOT NULL AS has_next FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY t, x, y)),
seg AS (SELECT *, seg_no > 0 AS has_prev FROM seg0 WHERE t2 > t1),
boxes AS (SELECT c_custkey AS id, c_acctbal / 100 AS x1, c_nationkey * 4e0 AS y1, c_acctbal / 100 + 1 + c_custkey % 7 AS x2, c_nationkey * 4e0 + 1 + c_custkey % 5 AS y2 FROM customer)"""
DUCK_VECTORS = "vectors AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"

AT = "(s.x1 + (s.x2 - s.x1) * ({t} - s.t1) / (s.t2 - s.t1))", "(s.y1 + (s.y2 - s.y1) * ({t} - s.t1) / (s.t2 - s.t1))"


def at(t: str, alias: str = "s") -> tuple[str, str]:
    """Position on a segment at time t."""
    return tuple(p.replace("{t}", t).replace("s.", f"{alias}.") for p in AT)


#: Queries by days 5 to 12 of the trajectories whose id is divisible by 50.
WINDOW = f"({DAY0} + 5 * {DAY}) AS ws, ({DAY0} + 12 * {DAY}) AS we"
QX1, QY1 = at("greatest(s.t1, p.ws)")
QX2, QY2 = at("least(s.t2, p.we)")
CLIP = f"""prm AS (SELECT {WINDOW}),
clip AS (SELECT s.traj_id, s.seg_no, greatest(s.t1, p.ws) AS t1, {QX1} AS x1, {QY1} AS y1, least(s.t2, p.we) AS t2, {QX2} AS x2, {QY2} AS y2
         FROM seg s CROSS JOIN prm p WHERE s.t1 < p.we AND s.t2 > p.ws)"""

SX, SY = at("greatest(s.t1, q.t1)")
EX, EY = at("least(s.t2, q.t2)")
QSX, QSY = at("greatest(s.t1, q.t1)", "q")
QEX, QEY = at("least(s.t2, q.t2)", "q")
QSX, QSY, QEX, QEY = (e.replace("greatest(q.t1, q.t1)", "greatest(s.t1, q.t1)").replace("least(q.t2, q.t2)", "least(s.t2, q.t2)") for e in (QSX, QSY, QEX, QEY))


def integral(static: str) -> str:
    """CTEs up to dist(qid, traj_id, dist): the distance integral over the common time; before and after it,
    the object stands still: twice the integral ("ied") or twice the least distance times the time ("sddtw")."""
    still = "2 * ({0})" if static == "ied" else "2 * least(sqrt(c), sqrt(a + b + c)) * h"
    f = "h * (CASE WHEN a < 1e-12 THEN sqrt(c) ELSE ((2 * a + b) * sqrt(greatest(a + b + c, 0)) - b * sqrt(c)) / (4 * a) + CASE WHEN 4 * a * c - b * b > 1e-12 THEN (4 * a * c - b * b) / (8 * power(a, 1.5e0)) * (asinh((2 * a + b) / sqrt(4 * a * c - b * b)) - asinh(b / sqrt(4 * a * c - b * b))) ELSE 0 END END)"
    return f"""{CLIP},
q AS (SELECT traj_id AS qid, t1, x1, y1, t2, x2, y2, {{SLAB}} AS slab FROM clip WHERE traj_id % 50 = 0),
ql AS (SELECT qid, min(t1) AS qs, max(t2) AS qe FROM q GROUP BY qid),
life AS (SELECT traj_id, min(t1) AS ts, max(t2) AS te, min_by(x1, t1) AS fx, min_by(y1, t1) AS fy, max_by(x2, t2) AS lx, max_by(y2, t2) AS ly FROM seg GROUP BY traj_id),
span AS (SELECT min(qs) AS qs, max(qe) AS qe FROM ql),
ext0 AS (SELECT traj_id, t1, x1, y1, t2, x2, y2, 0 AS still FROM seg CROSS JOIN span WHERE t1 < qe AND t2 > qs
         UNION ALL SELECT traj_id, qs, fx, fy, ts, fx, fy, 1 FROM life CROSS JOIN span WHERE qs < ts
         UNION ALL SELECT traj_id, te, lx, ly, qe, lx, ly, 1 FROM life CROSS JOIN span WHERE te < qe),
ext AS (SELECT *, {{SLAB}} AS slab FROM ext0),
pair AS (SELECT q.qid, s.traj_id, s.still, least(s.t2, q.t2) - greatest(s.t1, q.t1) AS h,
                {SX} - {QSX} AS dx1, {SY} - {QSY} AS dy1, {EX} - {QEX} AS dx2, {EY} - {QEY} AS dy2
         FROM q JOIN ext s ON {{GUARD}} AND s.t1 < q.t2 AND s.t2 > q.t1),
abc AS (SELECT qid, traj_id, still, h, (dx2 - dx1) * (dx2 - dx1) + (dy2 - dy1) * (dy2 - dy1) AS a, 2 * (dx1 * (dx2 - dx1) + dy1 * (dy2 - dy1)) AS b, dx1 * dx1 + dy1 * dy1 AS c FROM pair),
dist AS (SELECT abc.qid, abc.traj_id, round(sum(CASE WHEN still = 1 THEN {still.format(f)} ELSE {f} END), 4) AS dist, round(sum(CASE WHEN still = 1 THEN {still.format(f)} ELSE 0 END), 4) AS static_dist, round(sum(CASE WHEN still = 1 THEN 0 ELSE {f} END), 4) AS moving_dist
         FROM abc JOIN ql ON abc.qid = ql.qid JOIN life ON abc.traj_id = life.traj_id AND life.ts < ql.qe AND life.te > ql.qs GROUP BY abc.qid, abc.traj_id)"""


#: A cylinder around each 50th trajectory's first point of each day's half: centre, radius 5, six hours to each side.
CYLINDER = f"""cyl AS (SELECT traj_id * 100000 + seg_no AS qid, x1 AS cx, y1 AS cy, 5e0 AS r, t1 - 21600 AS t1, t1 + 21600 AS t2 FROM seg WHERE traj_id % 50 = 0),
q AS (SELECT *, {{SLAB}} AS slab FROM cyl), s0 AS (SELECT *, {{SLAB}} AS slab FROM seg)"""
NEAR = f"""near AS (SELECT q.qid, s.traj_id, q.r, {SX} - q.cx AS dx1, {SY} - q.cy AS dy1, {EX} - q.cx AS dx2, {EY} - q.cy AS dy2
        FROM q JOIN s0 s ON {{GUARD}} AND s.t1 < q.t2 AND s.t2 > q.t1),
u AS (SELECT *, CASE WHEN (dx2 - dx1) * (dx2 - dx1) + (dy2 - dy1) * (dy2 - dy1) < 1e-12 THEN 0e0 ELSE
      least(1e0, greatest(0e0, -(dx1 * (dx2 - dx1) + dy1 * (dy2 - dy1)) / ((dx2 - dx1) * (dx2 - dx1) + (dy2 - dy1) * (dy2 - dy1)))) END AS u FROM near)"""
BOXQ = "bq AS (SELECT id AS qid, x1 AS a1, y1 AS b1, x2 + 5 AS a2, y2 + 5 AS b2 FROM boxes WHERE id % 50 = 0)"
MBR = "mbr AS (SELECT traj_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(t) AS tmin, max(t) AS tmax, count(*) AS n_points FROM points GROUP BY traj_id)"
PX, PY = at("p.t0")
SPEED = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
#: Moving boxes: each segment carries a box of one unit around its point, with the segment's velocity.
MOVE = f"""mv AS (SELECT traj_id, seg_no, t1, t2, x1, y1, (x2 - x1) / (t2 - t1) AS vx, (y2 - y1) / (t2 - t1) AS vy FROM seg),
ref AS (SELECT {DAY0} + 10 * {DAY} AS tq, 20e0 AS lx, 20e0 AS ly, 60e0 AS hx, 60e0 AS hy)"""

SQL: dict[str, str] = {
    "traj_segments": "SELECT traj_id, seg_no, round(t1, 3) AS t1, x1, y1, round(t2, 3) AS t2, x2, y2 FROM seg",
    "segment_prev_next": "SELECT traj_id, seg_no, has_prev, has_next FROM seg",
    "dataset_stats": f"SELECT count(*) AS line_count, count(DISTINCT traj_id) AS traj_count, round(sum(t2 - t1), 2) AS total_time, round(sum({SPEED}), 4) AS total_dist, round(max({SPEED} / (t2 - t1)), 6) AS vmax, round(sum(t2 - t1) / count(*), 4) AS tl, round(sum(t2 - t1) / count(DISTINCT traj_id), 3) AS jt, round(sum({SPEED}) / sum(t2 - t1), 9) AS v, (max(greatest(x1, x2)) - min(least(x1, x2)) + max(greatest(y1, y2)) - min(least(y1, y2))) / 2 AS sr, round(max(t2) - min(t1), 3) AS p FROM seg",
    "traj_mbr": f"WITH {MBR} SELECT traj_id, xmin, xmax, ymin, ymax, round(tmin, 3) AS tmin, round(tmax, 3) AS tmax, n_points FROM mbr",
    "traj_mbc": f"WITH l AS (SELECT traj_id, min(t1) AS ts, max(t2) AS te, min_by(x1, t1) AS xs, min_by(y1, t1) AS ys, max_by(x2, t2) AS xe, max_by(y2, t2) AS ye FROM seg GROUP BY traj_id), p AS (SELECT l.*, p.x - (xs + (xe - xs) * (p.t - ts) / (te - ts)) AS dx, p.y - (ys + (ye - ys) * (p.t - ts) / (te - ts)) AS dy, p.t FROM l JOIN points p ON l.traj_id = p.traj_id) SELECT traj_id, xs, ys, xe, ye, round(max(sqrt(dx * dx + dy * dy)), 6) AS rd FROM p GROUP BY traj_id, xs, ys, xe, ye",
    "traj_length_speed": f"SELECT traj_id, round(sum({SPEED}), 6) AS length, round(max({SPEED} / (t2 - t1)), 6) AS max_speed, round(max(t2) - min(t1), 3) AS duration FROM seg GROUP BY traj_id",
    "points_during": f"SELECT traj_id, count(*) AS n FROM points WHERE t BETWEEN {DAY0} + 5 * {DAY} AND {DAY0} + 12 * {DAY} GROUP BY traj_id",
    "position_at_time": f"WITH p AS (SELECT {DAY0} + 10.5e0 * {DAY} AS t0) SELECT s.traj_id, round({PX}, 6) AS x, round({PY}, 6) AS y FROM seg s CROSS JOIN p WHERE s.t1 <= p.t0 AND p.t0 < s.t2",
    "clip_window": f"WITH {CLIP} SELECT traj_id, seg_no, round(t1, 3) AS t1, round(x1, 6) AS x1, round(y1, 6) AS y1, round(t2, 3) AS t2, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM clip",
    "resample_query": f"WITH n AS (SELECT {{SAMPLES}} AS i), p AS (SELECT {DAY0} + 5 * {DAY} + i * 7e0 * {DAY} / 8 AS t0, i FROM n) SELECT s.traj_id, p.i, round({PX}, 6) AS x, round({PY}, 6) AS y FROM p JOIN seg s ON s.t1 <= p.t0 AND (p.t0 < s.t2 OR p.t0 = s.t2 AND NOT s.has_next)",
    "link_pieces": f"WITH a AS (SELECT traj_id, t, x, y FROM points WHERE t <= {DAY0} + 9 * {DAY} UNION SELECT traj_id, t, x, y FROM points WHERE t >= {DAY0} + 7 * {DAY}) SELECT traj_id, count(*) AS n_points, round(min(t), 3) AS t_start, round(max(t), 3) AS t_end FROM a GROUP BY traj_id",
    "range_cylinder": f"WITH {CYLINDER}, {NEAR} SELECT DISTINCT qid, traj_id FROM u WHERE sqrt((dx1 + u * (dx2 - dx1)) * (dx1 + u * (dx2 - dx1)) + (dy1 + u * (dy2 - dy1)) * (dy1 + u * (dy2 - dy1))) < r",
    "range_instant": f"WITH p AS (SELECT {DAY0} + 10.5e0 * {DAY} AS t0) SELECT s.traj_id FROM seg s CROSS JOIN p WHERE s.t1 <= p.t0 AND p.t0 < s.t2 AND sqrt(({PX} - 50) * ({PX} - 50) + ({PY} - 50) * ({PY} - 50)) < 20",
    "range_mbr": f"WITH {CLIP} SELECT traj_id, count(*) AS n_segments FROM clip WHERE greatest(x1, x2) >= 20 AND least(x1, x2) <= 40 AND greatest(y1, y2) >= 20 AND least(y1, y2) <= 40 GROUP BY traj_id",
    "range_mbr_exact": f"WITH {CLIP}, z AS (SELECT traj_id, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN 20 AND 40 THEN 0e0 ELSE 2e0 END ELSE least((20 - x1) / (x2 - x1), (40 - x1) / (x2 - x1)) END AS ax, CASE WHEN x2 = x1 THEN 1e0 ELSE greatest((20 - x1) / (x2 - x1), (40 - x1) / (x2 - x1)) END AS bx, CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN 20 AND 40 THEN 0e0 ELSE 2e0 END ELSE least((20 - y1) / (y2 - y1), (40 - y1) / (y2 - y1)) END AS ay, CASE WHEN y2 = y1 THEN 1e0 ELSE greatest((20 - y1) / (y2 - y1), (40 - y1) / (y2 - y1)) END AS byy FROM clip) SELECT traj_id, count(*) AS n_segments FROM z WHERE greatest(ax, ay, 0e0) <= least(bx, byy, 1e0) GROUP BY traj_id",
    "cylinder_relation_mbr": f"WITH {MBR} SELECT traj_id, CASE WHEN tmax < {DAY0} + 5 * {DAY} OR tmin > {DAY0} + 12 * {DAY} OR power(greatest(xmin - 50, 0, 50 - xmax), 2) + power(greatest(ymin - 50, 0, 50 - ymax), 2) > power(60, 2) THEN 0 WHEN power(greatest(abs(xmin - 50), abs(xmax - 50)), 2) + power(greatest(abs(ymin - 50), abs(ymax - 50)), 2) < power(60, 2) THEN 2 ELSE 1 END AS relation FROM mbr",
    "ied_pairwise": f"WITH {integral('ied')} SELECT qid, traj_id, dist FROM dist",
    "static_distance": f"WITH {integral('ied')} SELECT qid, traj_id, static_dist FROM dist",
    "moving_center_distance": f"WITH {integral('ied')} SELECT qid, traj_id, moving_dist FROM dist",
    "sddtw_pairwise": f"WITH {integral('sddtw')} SELECT qid, traj_id, dist FROM dist",
    "knn_ied": f"WITH {integral('ied')} SELECT qid, traj_id, dist FROM dist WHERE qid = 0 ORDER BY dist, traj_id LIMIT 10",
    "knn_ied_batch": f"WITH {integral('ied')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, traj_id) AS rn FROM dist) SELECT qid, traj_id, dist, rn FROM r WHERE rn <= 6",
    "knn_ied_ties": f"WITH {integral('ied')}, r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY dist) AS rk FROM dist) SELECT qid, traj_id, dist, rk FROM r WHERE rk <= 6",
    "cut_everyline": "SELECT traj_id, seg_no AS s_idx, seg_no + 1 AS e_idx, least(x1, x2) AS xmin, greatest(x1, x2) AS xmax, least(y1, y2) AS ymin, greatest(y1, y2) AS ymax FROM seg",
    "cut_onebox": "SELECT traj_id, 0 AS s_idx, max(seg_no) + 1 AS e_idx, min(least(x1, x2)) AS xmin, max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax FROM seg GROUP BY traj_id",
    "cut_fp": "SELECT traj_id, min(seg_no) AS s_idx, max(seg_no) + 1 AS e_idx, min(least(x1, x2)) AS xmin, max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax FROM seg GROUP BY traj_id, floor(seg_no / 10e0)",
    "cut_static": f"WITH l AS (SELECT traj_id, min(t) AS t0 FROM points GROUP BY traj_id) SELECT p.traj_id, CAST(floor((p.t - t0) / {DAY}) AS BIGINT) AS piece, count(*) AS n_points, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points p JOIN l ON p.traj_id = l.traj_id GROUP BY p.traj_id, floor((p.t - t0) / {DAY})",
    "cut_global": f"SELECT traj_id, CAST(floor(t / {DAY}) AS BIGINT) AS piece, count(*) AS n_points, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points GROUP BY traj_id, floor(t / {DAY})",
    "region_intersects": f"WITH {BOXQ} SELECT qid, id FROM bq JOIN boxes ON x1 <= a2 AND x2 >= a1 AND y1 <= b2 AND y2 >= b1",
    "region_intersecting_area": f"WITH {BOXQ} SELECT qid, id, round((least(a2, x2) - greatest(a1, x1)) * (least(b2, y2) - greatest(b1, y1)), 4) AS area, round((greatest(a2, x2) - least(a1, x1)) * (greatest(b2, y2) - least(b1, y1)), 4) AS combined_area, round(2 * (x2 - x1 + y2 - y1), 4) AS margin FROM bq JOIN boxes ON x1 <= a2 AND x2 >= a1 AND y1 <= b2 AND y2 >= b1",
    "region_contains": f"WITH {BOXQ} SELECT qid, id FROM bq JOIN boxes ON x1 >= a1 AND x2 <= a2 AND y1 >= b1 AND y2 <= b2",
    "point_location": f"WITH {BOXQ} SELECT qid, id FROM bq JOIN boxes ON a1 BETWEEN x1 AND x2 AND b1 BETWEEN y1 AND y2",
    "region_10nn": f"WITH {BOXQ}, d AS (SELECT qid, id, power(greatest(x1 - a1, 0, a1 - x2), 2) + power(greatest(y1 - b1, 0, b1 - y2), 2) AS d2 FROM bq CROSS JOIN boxes), r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY d2) AS rk FROM d) SELECT qid, id, round(d2, 6) AS d2 FROM r WHERE rk <= 10",
    "region_count": f"WITH {BOXQ} SELECT qid, count(*) AS n FROM bq JOIN boxes ON x1 <= a2 AND x2 >= a1 AND y1 <= b2 AND y2 >= b1 GROUP BY qid",
    "region_selfjoin": "WITH w AS (SELECT * FROM boxes WHERE x1 <= 30 AND x2 >= 10 AND y1 <= 60 AND y2 >= 20) SELECT a.id AS a_id, b.id AS b_id FROM w a JOIN w b ON a.id <> b.id AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1 AND greatest(a.x1, b.x1) <= 30 AND least(a.x2, b.x2) >= 10 AND greatest(a.y1, b.y1) <= 60 AND least(a.y2, b.y2) >= 20",
    "index_bounds": "SELECT min(x1) AS xmin, min(y1) AS ymin, max(x2) AS xmax, max(y2) AS ymax, count(*) AS n FROM boxes",
    "leaf_listing": "SELECT CAST(floor(x1 / 10) AS BIGINT) AS slab, count(*) AS n, min(x1) AS xmin, max(x2) AS xmax, min(y1) AS ymin, max(y2) AS ymax FROM boxes GROUP BY floor(x1 / 10)",
    "result_paging": "SELECT id, x1, y1 FROM boxes WHERE x1 <= 30 AND x2 >= 10 ORDER BY id LIMIT 20 OFFSET 10",
    "delete_antijoin": "WITH gone AS (SELECT id FROM boxes WHERE x1 < 0) SELECT b.id, b.x1, b.y1, b.x2, b.y2 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = b.id)",
    "segment_intersects_region": "SELECT s.traj_id, s.seg_no FROM seg s WHERE greatest(x1, x2) >= 40 AND least(x1, x2) <= 60 AND greatest(y1, y2) >= 40 AND least(y1, y2) <= 60 AND NOT (sign((x2 - x1) * (40 - y1) - (y2 - y1) * (40 - x1)) = sign((x2 - x1) * (60 - y1) - (y2 - y1) * (40 - x1)) AND sign((x2 - x1) * (40 - y1) - (y2 - y1) * (40 - x1)) = sign((x2 - x1) * (40 - y1) - (y2 - y1) * (60 - x1)) AND sign((x2 - x1) * (40 - y1) - (y2 - y1) * (40 - x1)) = sign((x2 - x1) * (60 - y1) - (y2 - y1) * (60 - x1)) AND sign((x2 - x1) * (40 - y1) - (y2 - y1) * (40 - x1)) <> 0)",
    # a proper crossing, or an end of one that is collinear with the other and between its ends
    "segment_intersects_segment": "WITH o AS (SELECT *, (x2 - x1) * (10 - y1) - (y2 - y1) * (10 - x1) AS o1, (x2 - x1) * (90 - y1) - (y2 - y1) * (90 - x1) AS o2, 80 * (y1 - 10) - 80 * (x1 - 10) AS o3, 80 * (y2 - 10) - 80 * (x2 - 10) AS o4 FROM seg) SELECT traj_id, seg_no FROM o WHERE sign(o1) * sign(o2) < 0 AND sign(o3) * sign(o4) < 0 OR o1 = 0 AND CASE WHEN x1 <> x2 THEN 10 BETWEEN least(x1, x2) AND greatest(x1, x2) ELSE 10 BETWEEN least(y1, y2) AND greatest(y1, y2) END OR o2 = 0 AND CASE WHEN x1 <> x2 THEN 90 BETWEEN least(x1, x2) AND greatest(x1, x2) ELSE 90 BETWEEN least(y1, y2) AND greatest(y1, y2) END OR o3 = 0 AND x1 BETWEEN 10 AND 90 OR o4 = 0 AND x2 BETWEEN 10 AND 90",
    "point_line_distance": f"SELECT traj_id, seg_no, round(abs((x2 - x1) * (y1 - 50) - (x1 - 50) * (y2 - y1)) / {SPEED}, 6) AS dist FROM seg WHERE {SPEED} > 0",
    "interval_intersects": f"SELECT traj_id, seg_no, t1 <= {DAY0} + 9 * {DAY} AND t2 >= {DAY0} + 8 * {DAY} AS closed, t1 < {DAY0} + 9 * {DAY} AND t2 > {DAY0} + 8 * {DAY} AS opened, t1 < {DAY0} + 9 * {DAY} AND t2 > {DAY0} + 8 * {DAY} AS right_open FROM seg",
    "interval_contains": f"SELECT traj_id, seg_no FROM seg WHERE t1 <= {DAY0} + 9 * {DAY} AND {DAY0} + 9 * {DAY} <= t2",
    "timeregion_intersects": f"WITH {MBR} SELECT traj_id FROM mbr WHERE xmin <= 60 AND xmax >= 40 AND ymin <= 60 AND ymax >= 40 AND tmin < {DAY0} + 3 * {DAY} AND tmax > {DAY0} + 2 * {DAY}",
    "timeregion_contains": f"WITH {MBR} SELECT traj_id FROM mbr WHERE xmin <= 40 AND xmax >= 60 AND ymin <= 40 AND ymax >= 60 AND tmin <= {DAY0} + 3 * {DAY} AND tmax >= {DAY0} + 20 * {DAY}",
    "moving_at_time": f"WITH {MOVE} SELECT traj_id, round(x1 + vx * (tq - t1), 6) AS x, round(y1 + vy * (tq - t1), 6) AS y, x1 + vx * (tq - t1) BETWEEN lx AND hx AND y1 + vy * (tq - t1) BETWEEN ly AND hy AS inside FROM mv CROSS JOIN ref WHERE t1 <= tq AND tq < t2",
    "moving_intersects_interval": f"WITH {MOVE}, e AS (SELECT traj_id, seg_no, t1, t2, CASE WHEN vx = 0 THEN CASE WHEN x1 BETWEEN lx AND hx THEN t1 END ELSE t1 + least((lx - x1) / vx, (hx - x1) / vx) END AS ax, CASE WHEN vx = 0 THEN t2 ELSE t1 + greatest((lx - x1) / vx, (hx - x1) / vx) END AS bx, CASE WHEN vy = 0 THEN CASE WHEN y1 BETWEEN ly AND hy THEN t1 END ELSE t1 + least((ly - y1) / vy, (hy - y1) / vy) END AS ay, CASE WHEN vy = 0 THEN t2 ELSE t1 + greatest((ly - y1) / vy, (hy - y1) / vy) END AS b_y FROM mv CROSS JOIN ref) SELECT traj_id, seg_no, round(greatest(t1, ax, ay), 2) AS t_in, round(least(t2, bx, b_y), 2) AS t_out FROM e WHERE ax IS NOT NULL AND ay IS NOT NULL AND greatest(t1, ax, ay) < least(t2, bx, b_y)",
    "moving_contains": f"WITH {MOVE} SELECT traj_id, seg_no FROM mv CROSS JOIN ref WHERE least(x1, x1 + vx * (t2 - t1)) >= lx AND greatest(x1, x1 + vx * (t2 - t1)) <= hx AND least(y1, y1 + vy * (t2 - t1)) >= ly AND greatest(y1, y1 + vy * (t2 - t1)) <= hy",
    "moving_area": f"WITH {MOVE} SELECT traj_id, round(sum((t2 - t1) * 4 + (t2 - t1) * (t2 - t1) * (2 * abs(vx) + 2 * abs(vy)) / 2 + power(t2 - t1, 3) * abs(vx) * abs(vy) / 3), 0) AS area FROM mv GROUP BY traj_id",
    "moving_surface": f"WITH {MOVE} SELECT traj_id, round(sum((t2 - t1) * 4 + (t2 - t1) * (t2 - t1) * (abs(vx) + abs(vy)) / 2), 2) AS surface FROM mv GROUP BY traj_id",
    "external_sort": "SELECT traj_id, seg_no, row_number() OVER (PARTITION BY traj_id ORDER BY (t1 + t2) / 2, seg_no) AS place FROM seg",
    "unique_adjacent": "WITH p AS (SELECT traj_id, t, y, lag(y) OVER (PARTITION BY traj_id ORDER BY t, x, y) AS before FROM points) SELECT traj_id, round(t, 3) AS t, y FROM p WHERE before IS NULL OR before <> y",
    "expand_replicas": f"WITH n AS (SELECT {{REPLICAS}} AS i) SELECT i * 1000000 + traj_id AS traj_id, round(min(t) + i * 30e0 * {DAY}, 3) AS t_start, count(*) AS n_points FROM points CROSS JOIN n GROUP BY traj_id, i",
    "sbb_size_profile": f"WITH g AS (SELECT traj_id, floor(t / {DAY}) AS d, max(x) - min(x) AS w, max(y) - min(y) AS h, max(t) - min(t) AS dt FROM points GROUP BY traj_id, floor(t / {DAY})) SELECT count(*) AS pieces, round(avg(w * h), 6) AS mean_area, round(avg(dt), 3) AS mean_time, round(avg(w * h * dt), 2) AS mean_volume FROM g",
    "bounds_mbr": f"WITH {CLIP}, m AS (SELECT traj_id, min(least(x1, x2)) AS xmin, max(greatest(x1, x2)) AS xmax, min(least(y1, y2)) AS ymin, max(greatest(y1, y2)) AS ymax, max(t2) - min(t1) AS h FROM clip GROUP BY traj_id), q AS (SELECT traj_id AS qid, xmin AS a1, xmax AS a2, ymin AS b1, ymax AS b2, h AS qh FROM m WHERE traj_id % 50 = 0) SELECT qid, traj_id, round(sqrt(power(greatest(xmin - a2, 0, a1 - xmax), 2) + power(greatest(ymin - b2, 0, b1 - ymax), 2)) * qh, 4) AS opt, round(sqrt(power(greatest(xmax - a1, a2 - xmin), 2) + power(greatest(ymax - b1, b2 - ymin), 2)) * qh, 4) AS pes FROM q CROSS JOIN m",
}

SPARK_TOKENS = {
    "{SLAB}": f"explode(sequence(CAST(floor(t1 / {DAY}) AS BIGINT), CAST(floor(t2 / {DAY}) AS BIGINT)))",
    "{GUARD}": f"q.slab = s.slab AND CAST(floor(greatest(s.t1, q.t1) / {DAY}) AS BIGINT) = q.slab",
    # eight intervals have nine ends
    "{SAMPLES}": "explode(sequence(0, 8))",
    "{REPLICAS}": "explode(sequence(0, 9))",
    "{WORK}": "explode(sequence(0, 99))",
    "{NUMBERS}": "explode(sequence(0, 100000))",
}
DUCK_TOKENS = {"{SLAB}": "0", "{GUARD}": "TRUE", "{SAMPLES}": "unnest(generate_series(0, 8))", "{REPLICAS}": "unnest(generate_series(0, 9))", "{WORK}": "unnest(generate_series(0, 99))", "{NUMBERS}": "unnest(generate_series(0, 100000))"}
RELATION = re.compile(r"(?<![\w.])(points|seg|boxes|cones|vectors)(?![\w.])")


def _fill(sql: str, tokens: dict[str, str]) -> str:
    for k, v in tokens.items():
        sql = sql.replace(k, v)
    return sql


#: Queries that Spark answers by another plan than the SQL they must agree with.
OTHERWISE = {
    # these are DataFrame queries
    "knn_ied_pruned": (None, SQL["knn_ied_batch"]),
    "moving_intersecting_area": (None, f"WITH {regions.area_duck(integral('ied'))}"),
    "oplog_replay": (None, regions.OPLOG_DUCK),
    "cone_bounds": (None, f"WITH {regions.CONES_DUCK}"),
    "region_10nn_by_sum": (None, grid.BY_SUM_DUCK),
    "index_range": (None, index.RANGE_DUCK),
    "index_pages": (None, index.PAGES_DUCK),
    "linked_points": (None, linking.LINKED_DUCK),
} | bounds.QUERIES | geometry.QUERIES | {k: (None, sql) for k, sql in similarity.DUCK.items()}


def run_sql(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _fill(sql, SPARK_TOKENS)
    pts = src.points(spark, sf_dir)
    make = {"points": lambda: pts, "seg": lambda: src.segments(pts), "boxes": lambda: src.boxes(spark, sf_dir), "vectors": lambda: src.vectors(spark, sf_dir), "cones": lambda: regions.weekly_cones(pts).select("traj_id", "week", "cone.*")}
    used = {k: make[k]() for k in set(RELATION.findall(sql))}
    return spark.sql(RELATION.sub(r"{\1}", sql), **used)


def duck_sql(name: str) -> str:
    if name == "oplog_replay":
        return regions.OPLOG_DUCK
    if name in live.SQL:
        return live.SQL[name]
    sql = _fill(SQL[name] if name in SQL else OTHERWISE[name][1], DUCK_TOKENS)
    if re.search(r"(?<![\w.])cones(?![\w.])", sql):
        sql = f"WITH {regions.CONES_TABLE}, {sql[5:]}"
    if re.search(r"(?<![\w.])vectors(?![\w.])", sql):
        sql = f"WITH {DUCK_VECTORS}, {sql[5:]}"
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {DUCK}, {sql[15:]}"
    return f"WITH {DUCK}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {DUCK} {sql}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SQL | {k: spark for k, (spark, _) in OTHERWISE.items() if spark}
    out = {name: functools.partial(run_sql, sql) for name, sql in texts.items()}
    return out | {"range_cylinder": ranges.range_cylinder} | grid.QUERIES | index.QUERIES | linking.QUERIES | regions.QUERIES | similar.QUERIES | pairs.QUERIES | live.QUERIES | cutters.queries() | similarity.queries()


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(name) for name in [*SQL, *OTHERWISE, *live.SQL]}
