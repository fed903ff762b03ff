"""Queries whose Spark plan differs from the SQL they must agree with: (Spark SQL, DuckDB SQL) by name.

Relations are those of the catalog, and ops: the events as a log of inserted, deleted and queried boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import volumes
from ..sources import points as src

DAY0, DAY, WEEK = 1704067200, 86400, 604800
#: Half the side of a query box of the log, the side of its grid cells, and the side of a moving box.
HALF, CELL, SIDE = 5, 10, 20

DUCK_OPS = "ops AS (SELECT event_id, user_id AS id, event_type AS op, value AS x, CAST(props->>'k' AS DOUBLE) AS y FROM events WHERE event_type IN ('signup', 'error', 'view'))"

#: Whatever is inserted under an id lives until the next insertion or deletion of that id.
LIFE = """alive AS (SELECT * FROM (SELECT id, x, y, op, event_id AS born, lead(event_id) OVER (PARTITION BY id ORDER BY event_id) AS gone FROM ops WHERE op <> 'view') l WHERE op = 'signup')"""

OPLOG_SPARK = f"""WITH {LIFE},
q0 AS (SELECT event_id AS qid, x, y, explode(sequence(CAST(floor((x - {HALF}) / {CELL}) AS INT), CAST(floor((x + {HALF}) / {CELL}) AS INT))) AS cx FROM ops WHERE op = 'view'),
q AS (SELECT *, explode(sequence(CAST(floor((y - {HALF}) / {CELL}) AS INT), CAST(floor((y + {HALF}) / {CELL}) AS INT))) AS cy FROM q0),
o AS (SELECT *, CAST(floor(x / {CELL}) AS INT) AS cx, CAST(floor(y / {CELL}) AS INT) AS cy FROM alive)
SELECT q.qid, o.id FROM q JOIN o ON q.cx = o.cx AND q.cy = o.cy AND o.born < q.qid AND (o.gone IS NULL OR o.gone > q.qid) AND o.x >= q.x - {HALF} AND o.x <= q.x + {HALF} AND o.y >= q.y - {HALF} AND o.y <= q.y + {HALF}"""

OPLOG_DUCK = f"""WITH {DUCK_OPS}
SELECT q.event_id AS qid, i.id FROM ops q JOIN ops i ON q.op = 'view' AND i.op = 'signup' AND i.event_id < q.event_id
AND i.x >= q.x - {HALF} AND i.x <= q.x + {HALF} AND i.y >= q.y - {HALF} AND i.y <= q.y + {HALF}
WHERE NOT EXISTS (SELECT 1 FROM ops d WHERE d.id = i.id AND d.op <> 'view' AND d.event_id > i.event_id AND d.event_id < q.event_id)"""


def overlap(u: str) -> str:
    """Area that two boxes of the same side share when the second has moved by a part u of its way."""
    return f"greatest(0e0, {SIDE} - abs(dx1 + {u} * (dx2 - dx1))) * greatest(0e0, {SIDE} - abs(dy1 + {u} * (dy2 - dy1)))"


#: Where the overlap changes from one quadratic to another.
TURNS = ", ".join(f"({w} - d{a}1) / nullif(d{a}2 - d{a}1, 0)" for a in "xy" for w in (-SIDE, 0, SIDE))
NEAR_PAIRS = f"SELECT qid, traj_id, h, dx1, dy1, dx2, dy2 FROM pair WHERE still = 0 AND least(dx1, dx2) <= {SIDE} AND greatest(dx1, dx2) >= -{SIDE} AND least(dy1, dy2) <= {SIDE} AND greatest(dy1, dy2) >= -{SIDE}"


def area_duck(pairs: str) -> str:
    piece = f"(b - a) / 6 * ({overlap('a')} + 4 * {overlap('((a + b) / 2)')} + {overlap('b')})"
    return f"""{pairs}, n AS (SELECT row_number() OVER () AS k, * FROM ({NEAR_PAIRS})),
u AS (SELECT n.*, unnest([0e0, 1e0, {TURNS}]) AS a FROM n), v AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM u WHERE a BETWEEN 0 AND 1)
SELECT qid, traj_id, round(sum(h * {piece}), 1) AS area FROM v WHERE b > a GROUP BY qid, traj_id HAVING sum(h * {piece}) > 0.01"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin("signup", "error", "view"))
    return e.select("event_id", F.col("user_id").alias("id"), F.col("event_type").alias("op"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def oplog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, id): what each query of the log meets among the objects that live at its place in the log."""
    return spark.sql(OPLOG_SPARK.replace("FROM ops", "FROM {ops}"), ops=ops(spark, sf_dir))


def weekly_cones(pts: DataFrame) -> DataFrame:
    """traj_id, week, cone (a struct as in functions.volumes) of the pieces of two points or more."""
    p = pts.withColumn("week", F.floor((F.col("t") - DAY0) / WEEK).cast("long"))
    first, last = (f(F.struct("x", "y", "t"), "t") for f in (F.min_by, F.max_by))
    ends = p.groupBy("traj_id", "week").agg(first.alias("s"), last.alias("e")).filter("e.t > s.t")
    from pyspark.sql import Window

    w = Window.partitionBy("traj_id", "week").orderBy("t", "x", "y")
    step = p.select("*", *(F.lead(c).over(w).alias(f"{c}2") for c in "txy")).join(ends, ["traj_id", "week"])
    v = {c: (F.col(f"e.{c}") - F.col(f"s.{c}")) / (F.col("e.t") - F.col("s.t")) for c in "xy"}
    off = F.hypot(*(F.col(c) - F.col(f"s.{c}") - v[c] * (F.col("t") - F.col("s.t")) for c in "xy"))
    away = F.when(F.col("t2") > F.col("t"), F.hypot(*((F.col(f"{c}2") - F.col(c)) / (F.col("t2") - F.col("t")) - v[c] for c in "xy")))
    cone = F.struct(*(F.col(f"{a}.{c}").alias(c + a) for a in "se" for c in "xyt"), "rd", "rv")
    return step.groupBy("traj_id", "week", "s", "e").agg(F.max(off).alias("rd"), F.max(away).alias("rv")).select("traj_id", "week", cone.alias("cone"))


def cone_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known from each week's cone about the distance to (50, 50) at the middle of the piece."""
    c = weekly_cones(src.points(spark, sf_dir))
    t = (c["cone.ts"] + c["cone.te"]) / 2
    x, y = volumes.cone_centre(c["cone"], t)
    d, r = F.hypot(x - 50, y - 50), volumes.cone_radius(c["cone"], t)
    return c.select("traj_id", "week", F.round(r, 6).alias("radius"), F.round(F.greatest(d - r, F.lit(0.0)), 6).alias("opt"), F.round(d + r, 6).alias("pes"))


_CONE_PARTS = f"""p AS (SELECT *, CAST(floor((t - {DAY0}) / {WEEK}) AS BIGINT) AS week, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY traj_id, floor((t - {DAY0}) / {WEEK}) ORDER BY t, x, y)),
e AS (SELECT traj_id, week, min(t) AS ts, max(t) AS te, arg_min(x, t) AS xs, arg_min(y, t) AS ys, arg_max(x, t) AS xe, arg_max(y, t) AS ye FROM p GROUP BY traj_id, week HAVING max(t) > min(t)),
r AS (SELECT traj_id, week, max(sqrt(power(x - (xs + (xe - xs) * (t - ts) / (te - ts)), 2) + power(y - (ys + (ye - ys) * (t - ts) / (te - ts)), 2))) AS rd,
      max(CASE WHEN t2 > t THEN sqrt(power((x2 - x) / (t2 - t) - (xe - xs) / (te - ts), 2) + power((y2 - y) / (t2 - t) - (ye - ys) / (te - ts), 2)) END) AS rv FROM p JOIN e USING (traj_id, week) GROUP BY traj_id, week)"""
CONES_TABLE = f"""{_CONE_PARTS}, cones AS (SELECT e.*, rd, rv FROM e JOIN r USING (traj_id, week))"""
CONES_DUCK = f"""{_CONE_PARTS},
g AS (SELECT traj_id, week, sqrt(power((xs + xe) / 2 - 50, 2) + power((ys + ye) / 2 - 50, 2)) AS d, least((te - ts) / 2 * rv, rd) AS radius FROM e JOIN r USING (traj_id, week))
SELECT traj_id, week, round(radius, 6) AS radius, round(greatest(d - radius, 0), 6) AS opt, round(d + radius, 6) AS pes FROM g"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"oplog_replay": oplog_replay, "cone_bounds": cone_bounds}
