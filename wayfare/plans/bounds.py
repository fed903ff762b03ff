"""Lines, boxes, cones and cylinders in space and time, and bounds of the similarity integral from them.

A query is (Spark SQL, DuckDB SQL); the two go different ways to the same rows. Without Spark SQL it goes in blocks of pairs (`pairs.py`). In Spark a line is cut at the planes of a box by
arrays of fractions, and integrals are closed forms with asinh; in DuckDB fractions are unnested and integrals written with ln.
Relations are those of the catalog; `cones` are the weekly cones of the trajectories.
"""

from __future__ import annotations

from .regions import DAY, DAY0, WEEK

#: The box and the cylinder that the single-shape queries ask about.
LOW, HIGH, RADIUS = 40, 60, 12
FROM, TO = DAY0 + 5 * DAY, DAY0 + 12 * DAY


def _lerp(a: str, b: str, f: str) -> str:
    return f"({a} + ({b} - {a}) * {f})"


def _in_window(axis: str, t: str) -> str:
    return f"({axis}1 + ({axis}2 - {axis}1) * ({t} - t1) / (t2 - t1))"


CLIPPED = f"""cl AS (SELECT traj_id, seg_no, greatest(t1, {FROM}) AS a, least(t2, {TO}) AS b, {_in_window('x', f'greatest(t1, {FROM})')} AS xa, {_in_window('y', f'greatest(t1, {FROM})')} AS ya,
 {_in_window('x', f'least(t2, {TO})')} AS xb, {_in_window('y', f'least(t2, {TO})')} AS yb FROM seg WHERE t1 < {TO} AND t2 > {FROM})"""


def cuts(box: tuple[str, str, str, str]) -> str:
    """The fractions at which the line (xa, ya) to (xb, yb) crosses the planes of a box."""
    x0, y0, x1, y1 = box
    return ", ".join(f"({p} - {v}a) / nullif({v}b - {v}a, 0)" for v, ps in (("x", (x0, x1)), ("y", (y0, y1))) for p in ps)


def excess(axis: str, low: str, high: str, f: str) -> str:
    """How far outside of [low, high] the line is on an axis at the fraction f; negative below."""
    p = _lerp(f"{axis}a", f"{axis}b", f)
    return f"(greatest({p} - {high}, 0e0) - greatest({low} - {p}, 0e0))"


def norm_integral(x0: str, y0: str, x1: str, y1: str, how: str) -> str:
    """The mean length of a vector that goes evenly from (x0, y0) to (x1, y1): by asinh or by ln."""
    a, b, c = f"(power({x1} - {x0}, 2) + power({y1} - {y0}, 2))", f"(2 * ({x0} * ({x1} - {x0}) + {y0} * ({y1} - {y0})))", f"({x0} * {x0} + {y0} * {y0})"
    end = f"sqrt(greatest({x1} * {x1} + {y1} * {y1}, 0e0))"
    poly = f"((2 * {a} + {b}) * {end} - {b} * sqrt({c})) / (4 * {a})"
    disc = f"(4 * {a} * {c} - {b} * {b})"
    if how == "asinh":
        rest = f"{disc} / (8 * power({a}, 1.5e0)) * (asinh((2 * {a} + {b}) / sqrt({disc})) - asinh({b} / sqrt({disc})))"
    else:
        rest = f"{disc} / (8 * power({a}, 1.5e0)) * ln((2 * sqrt({a}) * {end} + 2 * {a} + {b}) / (2 * sqrt({a}) * sqrt({c}) + {b}))"
    return f"(CASE WHEN {a} < 1e-12 THEN sqrt({c}) ELSE {poly} + CASE WHEN {disc} > 1e-9 * (1 + {c}) THEN {rest} ELSE 0e0 END END)"


def _spark_box(lines: str, keys: str, box: tuple[str, str, str, str]) -> str:
    """CTEs up to lb(keys, h, ied, least, phases): a line against a box. lines: a CTE with xa, ya, xb, yb, h."""
    x0, y0, x1, y1 = box
    e = {f"{v}{k}": excess(v, lo, hi, f"w.f{k}") for v, lo, hi in (("x", x0, x1), ("y", y0, y1)) for k in "01"}
    ex = ", ".join(f"{v} AS e{k}" for k, v in e.items())
    return f"""lf AS (SELECT *, array_sort(filter(array(0e0, 1e0, {cuts(box)}), f -> f BETWEEN 0 AND 1)) AS fs FROM {lines}),
lp AS (SELECT lf.*, w.f0, w.f1 FROM lf LATERAL VIEW inline(transform(sequence(1, size(fs) - 1), i -> struct(fs[i - 1] AS f0, fs[i] AS f1))) w),
le AS (SELECT w.*, {ex} FROM lp w),
lv AS (SELECT {keys}, h, f1 - f0 AS part, p.* FROM le LATERAL VIEW inline(array(struct({norm_integral('ex0', 'ey0', 'ex1', 'ey1', 'asinh')} AS mean,
 CASE WHEN power(ex1 - ex0, 2) + power(ey1 - ey0, 2) < 1e-12 THEN sqrt(ex0 * ex0 + ey0 * ey0) ELSE
 sqrt(power(ex0 + (ex1 - ex0) * least(1e0, greatest(0e0, -(ex0 * (ex1 - ex0) + ey0 * (ey1 - ey0)) / (power(ex1 - ex0, 2) + power(ey1 - ey0, 2)))), 2)
 + power(ey0 + (ey1 - ey0) * least(1e0, greatest(0e0, -(ex0 * (ex1 - ex0) + ey0 * (ey1 - ey0)) / (power(ex1 - ex0, 2) + power(ey1 - ey0, 2)))), 2)) END AS nearest))) p),
lb AS (SELECT {keys}, h, sum(mean * part) * h AS ied, min(nearest) AS least, sum(CASE WHEN part > 0 THEN 1 ELSE 0 END) AS pieces FROM lv GROUP BY {keys}, h)"""


def _duck_box(lines: str, keys: str, box: tuple[str, str, str, str]) -> str:
    """The same, from unnested fractions; the least distance from the fractions of the planes, the ends and the feet of the corners."""
    x0, y0, x1, y1 = box
    v2 = "nullif((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya), 0)"
    feet = ", ".join(f"(({x} - xa) * (xb - xa) + ({y} - ya) * (yb - ya)) / {v2}" for x in (x0, x1) for y in (y0, y1))
    at = lambda f: f"sqrt(power({excess('x', x0, x1, f)}, 2) + power({excess('y', y0, y1, f)}, 2))"
    e = {f"e{v}{k}": excess(v, lo, hi, f"f{k}") for v, lo, hi in (("x", x0, x1), ("y", y0, y1)) for k in "01"}
    return f"""lk AS (SELECT row_number() OVER () AS k, * FROM {lines}),
lu AS (SELECT lk.*, unnest([0e0, 1e0, {cuts(box)}]) AS f0 FROM lk), lw AS (SELECT *, lead(f0) OVER (PARTITION BY k ORDER BY f0) AS f1 FROM lu WHERE f0 BETWEEN 0 AND 1),
le AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in e.items())} FROM lw WHERE f1 IS NOT NULL),
li AS (SELECT k, sum({norm_integral('ex0', 'ey0', 'ex1', 'ey1', 'ln')} * (f1 - f0)) AS mean, sum(CASE WHEN f1 > f0 THEN 1 ELSE 0 END) AS pieces FROM le GROUP BY k),
lm AS (SELECT k, min({at('f')}) AS least FROM (SELECT lk.*, unnest([0e0, 1e0, {cuts(box)}, {feet}]) AS f FROM lk) z WHERE f BETWEEN 0 AND 1 GROUP BY k),
lb AS (SELECT {', '.join(f'lk.{c.strip()}' for c in keys.split(','))}, h, mean * h AS ied, least, pieces FROM lk JOIN li ON lk.k = li.k JOIN lm ON lk.k = lm.k)"""


BOX = (f"{LOW}e0", f"{LOW}e0", f"{HIGH}e0", f"{HIGH}e0")
LINES = f"{CLIPPED}, ln AS (SELECT *, b - a AS h FROM cl WHERE b > a)"
PHASE = lambda x, y: f"1 + CASE WHEN {x} < {LOW} THEN 0 WHEN {x} <= {HIGH} THEN 1 ELSE 2 END + 3 * CASE WHEN {y} < {LOW} THEN 0 WHEN {y} <= {HIGH} THEN 1 ELSE 2 END"
DIAGONAL = f"sqrt(power({HIGH} - {LOW}, 2) * 2e0)"


def _line_box(make) -> str:
    return f"WITH {LINES}, {make('ln', 'traj_id, seg_no', BOX)} SELECT traj_id, seg_no, round(least, 5) AS least, round(ied, 2) AS opt, round(ied + h * {DIAGONAL}, 2) AS pes, CAST(pieces AS BIGINT) AS pieces FROM lb"


PHASES = f"WITH {CLIPPED} SELECT traj_id, seg_no, {PHASE('xa', 'ya')} AS start_phase, {PHASE('xb', 'yb')} AS end_phase FROM cl WHERE b > a"

#: Boxes of the weeks of each trajectory, from its segments; a query's line meets a box in the time of both.
WEEKS_SPARK = f"""wk0 AS (SELECT *, explode(sequence(CAST(floor((t1 - {DAY0}) / {WEEK}) AS BIGINT), CAST(floor((t2 - {DAY0}) / {WEEK}) AS BIGINT))) AS week FROM seg)"""
WEEKS_DUCK = f"""wk0 AS (SELECT *, unnest(generate_series(CAST(floor((t1 - {DAY0}) / {WEEK}) AS BIGINT), CAST(floor((t2 - {DAY0}) / {WEEK}) AS BIGINT))) AS week FROM seg)"""
_A, _B = f"greatest(t1, {DAY0} + week * {WEEK})", f"least(t2, {DAY0} + (week + 1) * {WEEK})"
WEEK_BOXES = f"""wk AS (SELECT traj_id, week, {_A} AS a, {_B} AS b, {_in_window('x', _A)} AS xa, {_in_window('y', _A)} AS ya, {_in_window('x', _B)} AS xb, {_in_window('y', _B)} AS yb FROM wk0 WHERE {_B} > {_A}),
wb AS (SELECT traj_id, week, min(least(xa, xb)) AS bx0, min(least(ya, yb)) AS by0, max(greatest(xa, xb)) AS bx1, max(greatest(ya, yb)) AS by1, min(a) AS ts, max(b) AS te FROM wk GROUP BY traj_id, week)"""
_QA, _QB = "greatest(q.a, o.ts)", "least(q.b, o.te)"


def _q_at(axis: str, t: str) -> str:
    return f"(q.{axis}a + (q.{axis}b - q.{axis}a) * ({t} - q.a) / (q.b - q.a))"


AGAINST = f"""ln AS (SELECT q.traj_id AS qid, o.traj_id, o.week, q.a AS qa, {_QB} - {_QA} AS h, {_q_at('x', _QA)} AS xa, {_q_at('y', _QA)} AS ya, {_q_at('x', _QB)} AS xb, {_q_at('y', _QB)} AS yb, bx0, by0, bx1, by1
 FROM wk q JOIN wb o ON q.week = o.week AND {_QB} > {_QA})"""
ANY_BOX = ("bx0", "by0", "bx1", "by1")
KEYS = "qid, traj_id, week, qa, bx0, by0, bx1, by1"
SUMS = "SELECT qid, traj_id, round(sum(ied), 0) AS opt, round(sum(ied + h * sqrt(power(bx1 - bx0, 2) + power(by1 - by0, 2))), 0) AS pes FROM lb GROUP BY qid, traj_id"
NODE = "SELECT qid, traj_id, round(min(least) * sum(h), 0) AS bound FROM lb GROUP BY qid, traj_id"

#: The whole trajectory's box, as for an inner node.
NODE_LINES = f"""m AS (SELECT traj_id, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1, min(t) AS ts, max(t) AS te FROM points GROUP BY traj_id),
ln AS (SELECT q.traj_id AS qid, o.traj_id, 0 AS week, q.a AS qa, q.b - q.a AS h, xa, ya, xb, yb, bx0, by0, bx1, by1 FROM cl q CROSS JOIN m o WHERE q.b > q.a AND o.ts < {TO} AND o.te > {FROM})"""

#: Distance integral of a gap in which the object moves at most at v, from the distance d at its end: least and greatest.
_ldd = lambda d, v, dt: f"(CASE WHEN {d} + {v} * {dt} > 0 THEN {dt} * ({d} + {v} * {dt} / 2) ELSE {d} * {d} / 2 / abs({v}) END)"
GAPS = f"""WITH v AS (SELECT max(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) / (t2 - t1)) AS v FROM seg),
life AS (SELECT traj_id, min(t) AS ts, max(t) AS te, min_by(x, t) AS fx, min_by(y, t) AS fy, max_by(x, t) AS lx, max_by(y, t) AS ly FROM points GROUP BY traj_id),
q AS (SELECT traj_id AS qid, ts AS qs, te AS qe FROM life WHERE traj_id % 50 = 0),
g AS (SELECT qid, o.traj_id, s.x1, s.y1, s.x2, s.y2, s.t1, s.t2, qs, qe, ts, te, fx, fy, lx, ly FROM q CROSS JOIN life o JOIN seg s ON s.traj_id = q.qid AND o.traj_id <> q.qid),
f AS (SELECT qid, traj_id, 'front' AS side, sqrt(power({_in_window('x', 'ts')} - fx, 2) + power({_in_window('y', 'ts')} - fy, 2)) AS d, ts - qs AS dt FROM g WHERE t1 <= ts AND ts < t2 AND ts > qs
 UNION ALL SELECT qid, traj_id, 'back', sqrt(power({_in_window('x', 'te')} - lx, 2) + power({_in_window('y', 'te')} - ly, 2)), qe - te FROM g WHERE t1 <= te AND te < t2 AND te < qe)
SELECT qid, traj_id, side, round({_ldd('d', '(-v)', 'dt')}, 1) AS opt, round({_ldd('d', 'v', 'dt')}, 1) AS pes FROM f CROSS JOIN v"""

#: Twice the integral against the box of the first or the last week, for the time before or after the object's life.
STATIC = f"""ends AS (SELECT traj_id, min(ts) AS ts, max(te) AS te, min(week) AS first_week, max(week) AS last_week FROM wb GROUP BY traj_id),
ln AS (SELECT q.traj_id AS qid, o.traj_id, o.week, q.a AS qa, least(q.b, e.ts) - q.a AS h, q.xa, q.ya, {_q_at('x', 'least(q.b, e.ts)')} AS xb, {_q_at('y', 'least(q.b, e.ts)')} AS yb, bx0, by0, bx1, by1
 FROM wk q CROSS JOIN ends e JOIN wb o ON o.traj_id = e.traj_id AND o.week = e.first_week WHERE q.traj_id % 50 = 0 AND q.a < e.ts
 UNION ALL SELECT q.traj_id, o.traj_id, o.week, q.a + 1e-3, q.b - greatest(q.a, e.te), {_q_at('x', 'greatest(q.a, e.te)')}, {_q_at('y', 'greatest(q.a, e.te)')}, q.xb, q.yb, bx0, by0, bx1, by1
 FROM wk q CROSS JOIN ends e JOIN wb o ON o.traj_id = e.traj_id AND o.week = e.last_week WHERE q.traj_id % 50 = 0 AND q.b > e.te)"""
STATIC_SUM = "SELECT qid, traj_id, round(2 * sum(ied), 0) AS opt, count(*) AS n_lines FROM lb GROUP BY qid, traj_id"

#: Sums over the query's samples of the least and the greatest distance that any query point has from the box of the sample's week.
_BOX_D = "sqrt(power(greatest(bx0 - r.x, 0, r.x - bx1), 2) + power(greatest(by0 - r.y, 0, r.y - by1), 2))"
RMDTW = f"""WITH {{WEEKS}}, {WEEK_BOXES}, q AS (SELECT traj_id AS qid, t, x, y, CAST(floor((t - {DAY0}) / {WEEK}) AS BIGINT) AS week FROM points WHERE traj_id % 50 = 0 AND t BETWEEN {FROM} AND {TO}),
d AS (SELECT p.qid, o.traj_id, p.t, min({_BOX_D}) AS near, max({_BOX_D}) + min(bx1 - bx0 + by1 - by0) AS far FROM q p JOIN wb o ON o.week = p.week AND p.t BETWEEN o.ts AND o.te JOIN q r ON r.qid = p.qid GROUP BY p.qid, o.traj_id, p.t)
SELECT qid, traj_id, count(*) AS n, round(sum(near), 4) AS opt, round(sum(far), 4) AS pes FROM d GROUP BY qid, traj_id"""

#: Where the radius of a cone bends.
_TAU = "CASE WHEN rv > 0 THEN least(rd / rv, (te - ts) / 2) ELSE 0e0 END"
_RADIUS = lambda t: f"CASE WHEN rv > 0 THEN least(({t} - ts) * rv, rd, (te - {t}) * rv) ELSE 0e0 END"
_C = lambda axis, t: f"({axis}s + ({axis}e - {axis}s) * ({t} - ts) / (te - ts))"
_EDGE = lambda pick, sign, axis: f"{pick}({axis}s, {axis}e, {_C(axis, '(ts + tau)')} {sign} rd, {_C(axis, '(te - tau)')} {sign} rd)"
CONE_SHAPE = f"""WITH c AS (SELECT *, {_TAU} AS tau FROM cones)
SELECT traj_id, week, round({_EDGE('least', '-', 'x')}, 5) AS xmin, round({_EDGE('greatest', '+', 'x')}, 5) AS xmax, round({_EDGE('least', '-', 'y')}, 5) AS ymin, round({_EDGE('greatest', '+', 'y')}, 5) AS ymax,
 round(CASE WHEN rv = 0 THEN 0e0 ELSE pi() * rd * rd * (te - ts - 2 * tau) + 2e0 / 3 * pi() * rd * rd END, 1) AS area,
 round(greatest(sqrt(power({_C('x', '((ts + te) / 2)')} - 50, 2) + power({_C('y', '((ts + te) / 2)')} - 50, 2)) - ({_RADIUS('((ts + te) / 2)')}), 0), 5) AS point_distance FROM c"""

_AT = lambda v, t: f"(q.{v}a + (q.{v}b - q.{v}a) * ({t} - q.a) / (q.b - q.a) - (c.{v}s + (c.{v}e - c.{v}s) * ({t} - c.ts) / (c.te - c.ts)))"
_U, _V = "greatest(q.a, c.ts)", "least(q.b, c.te)"
CONE_PAIRS = f"""cp AS (SELECT q.traj_id AS qid, c.traj_id, c.week, {_U} AS u, {_V} AS v, c.ts, c.te, c.rd, c.rv, {_AT('x', _U)} AS dx0, {_AT('y', _U)} AS dy0, {_AT('x', _V)} AS dx1, {_AT('y', _V)} AS dy1
 FROM wk q JOIN cones c ON q.week = c.week AND q.traj_id % 50 = 0 AND {_V} > {_U})"""
CONE_SUM = "SELECT qid, traj_id, round(sum(greatest(s - r, 0e0)), 0) AS opt, round(sum(s + r), 0) AS pes FROM z GROUP BY qid, traj_id"
CONE_DUCK = f"""WITH {WEEKS_DUCK}, {WEEK_BOXES}, {CONE_PAIRS}, ct AS (SELECT row_number() OVER () AS k, *, {_TAU} AS tau FROM cp),
tt AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS t2, ts, te, rd, rv FROM (SELECT ct.*, unnest([u, v, greatest(u, least(v, ts + tau)), greatest(u, least(v, te - tau))]) AS t FROM ct) w),
ra AS (SELECT k, sum((t2 - t) * ({_RADIUS('t')} + {_RADIUS('t2')}) / 2) AS r FROM tt WHERE t2 IS NOT NULL GROUP BY k),
z AS (SELECT qid, traj_id, (v - u) * {norm_integral('dx0', 'dy0', 'dx1', 'dy1', 'ln')} AS s, r FROM ct JOIN ra ON ct.k = ra.k) {CONE_SUM}"""

#: 0 disjoint, 1 maybe, 2 surely: the cylinder against a cone, whose radius is 0 where it is a line.
_F, _G = f"greatest(ts, {FROM})", f"least(te, {TO})"
REL_BASE = f"rc AS (SELECT traj_id, week, xs, ys, ts, xe, ye, te, rd, rv, {_TAU} AS tau, {_F} AS u, {_G} AS v FROM cones WHERE {_G} >= {_F})"
_P = {f"{n}{k}": f"({_C(n, f't{k}')} - 50)" for n in "xy" for k in "01"}
_LEAST = lambda sign: f"least(sqrt(cc) {sign} r0, sqrt(cc + 2 * bb + aa) {sign} r1, CASE WHEN aa > kk{sign == '+' and 'p' or 'm'} * kk{sign == '+' and 'p' or 'm'} THEN sqrt(greatest(aa * uu{sign == '+' and 'p' or 'm'} * uu{sign == '+' and 'p' or 'm'} + 2 * bb * uu{sign == '+' and 'p' or 'm'} + cc, 0e0)) {sign} (r0 + uu{sign == '+' and 'p' or 'm'} * (r1 - r0)) ELSE 1e300 END)"
_FOOT = lambda k: f"CASE WHEN aa > {k} * {k} THEN least(1e0, greatest(0e0, sign({k}) * sqrt({k} * {k} * greatest(cc - bb * bb / aa, 0e0) / (aa * (aa - {k} * {k}))) * sqrt(aa) / sqrt(aa) - bb / aa)) ELSE 0e0 END"
REL_SPARK = f"""WITH {REL_BASE},
rp AS (SELECT rc.*, p.* FROM rc LATERAL VIEW inline(transform(sequence(1, 3), i -> struct(array_sort(array(u, v, greatest(u, least(v, ts + tau)), greatest(u, least(v, te - tau))))[i - 1] AS t0, array_sort(array(u, v, greatest(u, least(v, ts + tau)), greatest(u, least(v, te - tau))))[i] AS t1))) p),
rq AS (SELECT traj_id, week, {', '.join(f'{v} AS d{k}' for k, v in _P.items())}, {_RADIUS('t0')} AS r0, {_RADIUS('t1')} AS r1 FROM rp),
ra AS (SELECT traj_id, week, r0, r1, p.* FROM rq LATERAL VIEW inline(array(struct(power(dx1 - dx0, 2) + power(dy1 - dy0, 2) AS aa, dx0 * (dx1 - dx0) + dy0 * (dy1 - dy0) AS bb, dx0 * dx0 + dy0 * dy0 AS cc, -(r1 - r0) AS kkp, r1 - r0 AS kkm))) p),
rf AS (SELECT ra.*, p.* FROM ra LATERAL VIEW inline(array(struct({_FOOT('kkp')} AS uup, {_FOOT('kkm')} AS uum))) p)
SELECT traj_id, week, CASE WHEN min({_LEAST('+')}) <= {RADIUS} THEN 2 WHEN min({_LEAST('-')}) <= {RADIUS} THEN 1 ELSE 0 END AS relation FROM rf GROUP BY traj_id, week"""
#: By quadratic inequalities in the fraction f of each piece: squared distance below the squared sum or difference of the radii.
_QUAD = lambda s: f"(aa - power({s} * dr, 2)) * f * f + 2 * (bb - {s} * dr * ({RADIUS} + {s} * r0)) * f + cc - power({RADIUS} + {s} * r0, 2)"
_VERTEX = lambda s: f"-(bb - {s} * dr * ({RADIUS} + {s} * r0)) / nullif(aa - power({s} * dr, 2), 0)"
REL_DUCK = f"""WITH {REL_BASE}, rt AS (SELECT *, unnest([u, v, greatest(u, least(v, ts + tau)), greatest(u, least(v, te - tau))]) AS t0 FROM rc),
rp AS (SELECT *, lead(t0) OVER (PARTITION BY traj_id, week ORDER BY t0) AS t1 FROM rt),
rq AS (SELECT traj_id, week, {', '.join(f'{v} AS d{k}' for k, v in _P.items())}, {_RADIUS('t0')} AS r0, {_RADIUS('t1')} AS r1 FROM rp WHERE t1 IS NOT NULL),
ra AS (SELECT traj_id, week, r0, r1 - r0 AS dr, power(dx1 - dx0, 2) + power(dy1 - dy0, 2) AS aa, dx0 * (dx1 - dx0) + dy0 * (dy1 - dy0) AS bb, dx0 * dx0 + dy0 * dy0 AS cc FROM rq),
rf AS (SELECT *, unnest([0e0, 1e0, {_VERTEX('1')}, {_VERTEX('-1')}, ({RADIUS} - r0) / nullif(dr, 0)]) AS f FROM ra),
rg AS (SELECT traj_id, week, ({_QUAD('-1')}) <= 1e-9 AND r0 + f * dr <= {RADIUS} + 1e-9 AS surely, ({_QUAD('1')}) <= 1e-9 AS maybe FROM rf WHERE f BETWEEN 0 AND 1)
SELECT traj_id, week, CASE WHEN bool_or(surely) THEN 2 WHEN bool_or(maybe) THEN 1 ELSE 0 END AS relation FROM rg GROUP BY traj_id, week"""

#: A line against the cylinder: by the foot of the centre in Spark, by the roots of the quadratic in DuckDB.
LINE_REL_SPARK = f"""WITH {CLIPPED}, d AS (SELECT traj_id, seg_no, xa - 50 AS dx, ya - 50 AS dy, xb - xa AS vx, yb - ya AS vy FROM cl WHERE b > a),
f AS (SELECT d.*, p.u FROM d LATERAL VIEW inline(array(struct(CASE WHEN vx * vx + vy * vy < 1e-12 THEN 0e0 ELSE least(1e0, greatest(0e0, -(dx * vx + dy * vy) / (vx * vx + vy * vy))) END AS u))) p)
SELECT traj_id, seg_no, CASE WHEN power(dx + u * vx, 2) + power(dy + u * vy, 2) <= power({RADIUS}e0, 2) THEN 2 ELSE 0 END AS relation FROM f"""
LINE_REL_DUCK = f"""WITH {CLIPPED}, d AS (SELECT traj_id, seg_no, power(xb - xa, 2) + power(yb - ya, 2) AS a2, 2 * ((xa - 50) * (xb - xa) + (ya - 50) * (yb - ya)) AS a1, power(xa - 50, 2) + power(ya - 50, 2) - power({RADIUS}, 2) AS a0 FROM cl WHERE b > a)
SELECT traj_id, seg_no, CASE WHEN a0 <= 0 OR a2 + a1 + a0 <= 0 OR (a2 > 0 AND a1 * a1 >= 4 * a2 * a0 AND -a1 / (2 * a2) BETWEEN 0 AND 1) THEN 2 ELSE 0 END AS relation FROM d"""

QUERIES: dict[str, tuple[str | None, str]] = {
    "line_box_bounds": (_line_box(_spark_box), _line_box(_duck_box)),
    "line_phases": (PHASES, PHASES),
    "volume_bounds": (None, f"WITH {WEEKS_DUCK}, {WEEK_BOXES}, {AGAINST}, {_duck_box('ln', KEYS, ANY_BOX)} {SUMS}"),
    "node_bounds": (None, f"WITH {CLIPPED}, {NODE_LINES}, {_duck_box('ln', KEYS, ANY_BOX)} {NODE}"),
    "gap_bounds": (None, GAPS),
    "static_box_distance": (None, f"WITH {WEEKS_DUCK}, {WEEK_BOXES}, {STATIC}, {_duck_box('ln', KEYS, ANY_BOX)} {STATIC_SUM}"),
    "rmdtw_bounds": (None, RMDTW.replace("{WEEKS}", WEEKS_DUCK)),
    "cone_shape": (CONE_SHAPE, CONE_SHAPE),
    "cone_integral_bounds": (None, CONE_DUCK),
    "cylinder_relation_cone": (REL_SPARK, REL_DUCK),
    "cylinder_relation_line": (LINE_REL_SPARK, LINE_REL_DUCK),
}
