"""Joins of boxes and nearest boxes in blocks of pairs, in place of nested loops.

Boxes stand by the cell of their lower corner. Queries go past the cells: those that meet the bounds of a cell's boxes are compared with each of
them. The boxes of a cell are dealt over several tasks, so that no task has a crowded cell alone. Nearest boxes are the nearest of each task's nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, bounding
from ..operators.blocks import Table
from ..sources import points as src

#: The side of a cell, and over how many tasks its boxes are dealt.
CELL, SALT = 5.0, 16
BOX = ["x1", "y1", "x2", "y2"]
#: Queries and boxes of one table of comparisons.
TILE = 64, 1000


def _queries(q: DataFrame) -> DataFrame:
    return q.select(F.col("qid").alias("traj_id"), F.col("qid").alias("id"), *(F.col(a).alias(b) for a, b in zip(("a1", "b1", "a2", "b2"), BOX, strict=True)))


def _met(q: Table, s: Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries and of boxes that share a point, cell by cell."""
    starts = blocks._starts(s["traj_id"])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        x1, y1, x2, y2 = (s[c][a:b] for c in BOX)
        near = np.flatnonzero((q["x2"] >= np.fmin.reduce(x1)) & (q["x1"] <= np.fmax.reduce(x2)) & (q["y2"] >= np.fmin.reduce(y1)) & (q["y1"] <= np.fmax.reduce(y2)))
        for at in range(0, len(near), TILE[0]):
            rows = near[at : at + TILE[0]]
            a1, b1, a2, b2 = (q[c][rows, None] for c in BOX)
            i, j = np.nonzero((x1 <= a2) & (x2 >= a1) & (y1 <= b2) & (y2 >= b1))
            yield rows[i], j + a


def meeting(q: DataFrame, o: DataFrame, found: Callable[[Table, Table, np.ndarray, np.ndarray], Table], schema: str) -> DataFrame:
    """found(queries, boxes, i, j) for the rows i of q (qid, a1, b1, a2, b2) and j of o (id, x1, y1, x2, y2) that share a point, each pair once."""

    def parts(q: Table, s: Table) -> Iterator[Table]:
        for i, j in _met(q, s):
            yield found(q, s, i, j)

    cell = F.coalesce(F.floor(F.col("x1") / CELL) * 1_000_003 + F.floor(F.col("y1") / CELL), F.lit(0)).cast("long")
    boxes = o.select(cell.alias("traj_id"), "id", *BOX)
    return blocks.against(_queries(q), boxes, bounding.kernel(parts), schema, "id", F.hash("traj_id") + F.pmod(F.xxhash64("id"), F.lit(SALT)) * 7)


def _pairs(q: Table, s: Table, i: np.ndarray, j: np.ndarray) -> Table:
    return {"qid": q["id"][i], "id": s["id"][j]}


def _contained(q: Table, s: Table, i: np.ndarray, j: np.ndarray) -> Table:
    whole = (s["x1"][j] >= q["x1"][i]) & (s["x2"][j] <= q["x2"][i]) & (s["y1"][j] >= q["y1"][i]) & (s["y2"][j] <= q["y2"][i])
    return _pairs(q, s, i[whole], j[whole])


def _counted(q: Table, s: Table, i: np.ndarray, j: np.ndarray) -> Table:
    rows, n = np.unique(i, return_counts=True)
    return {"qid": q["id"][rows], "n": n}


def _areas(q: Table, s: Table, i: np.ndarray, j: np.ndarray) -> Table:
    (a1, b1, a2, b2), (x1, y1, x2, y2) = ([t[c][k] for c in BOX] for t, k in ((q, i), (s, j)))
    area = (np.minimum(a2, x2) - np.maximum(a1, x1)) * (np.minimum(b2, y2) - np.maximum(b1, y1))
    combined = (np.maximum(a2, x2) - np.minimum(a1, x1)) * (np.maximum(b2, y2) - np.minimum(b1, y1))
    return _pairs(q, s, i, j) | {"area": blocks.rounded(area, 4), "combined_area": blocks.rounded(combined, 4), "margin": blocks.rounded(2 * (x2 - x1 + y2 - y1), 4)}


def _inside(q: Table, s: Table, i: np.ndarray, j: np.ndarray) -> Table:
    """Pairs of different boxes that meet inside the window (10, 20) to (30, 60)."""
    (a1, b1, a2, b2), (x1, y1, x2, y2) = ([t[c][k] for c in BOX] for t, k in ((q, i), (s, j)))
    use = (q["id"][i] != s["id"][j]) & (np.maximum(a1, x1) <= 30) & (np.minimum(a2, x2) >= 10) & (np.maximum(b1, y1) <= 60) & (np.minimum(b2, y2) >= 20)
    return {"a_id": q["id"][i[use]], "b_id": s["id"][j[use]]}


def query_boxes(boxes: DataFrame) -> DataFrame:
    """The stated query set: boxes whose id is divisible by 50, wider by 5."""
    return boxes.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("x1").alias("a1"), F.col("y1").alias("b1"), (F.col("x2") + 5).alias("a2"), (F.col("y2") + 5).alias("b2"))


def region_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = src.boxes(spark, sf_dir)
    return meeting(query_boxes(boxes), boxes, _pairs, "qid long, id long")


def region_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = src.boxes(spark, sf_dir)
    return meeting(query_boxes(boxes), boxes, _contained, "qid long, id long")


def region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted where pairs are made."""
    boxes = src.boxes(spark, sf_dir)
    return meeting(query_boxes(boxes), boxes, _counted, "qid long, n long").groupBy("qid").agg(F.sum("n").alias("n"))


def region_intersecting_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = src.boxes(spark, sf_dir)
    return meeting(query_boxes(boxes), boxes, _areas, "qid long, id long, area double, combined_area double, margin double")


def point_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = src.boxes(spark, sf_dir)
    points = query_boxes(boxes).withColumns({"a2": F.col("a1"), "b2": F.col("b1")})
    return meeting(points, boxes, _pairs, "qid long, id long")


def region_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of boxes that meet each other inside the window (10, 20) to (30, 60)."""
    w = src.boxes(spark, sf_dir).filter("x1 <= 30 and x2 >= 10 and y1 <= 60 and y2 >= 20")
    a = w.select(F.col("id").alias("qid"), F.col("x1").alias("a1"), F.col("y1").alias("b1"), F.col("x2").alias("a2"), F.col("y2").alias("b2"))
    return meeting(a, w, _inside, "a_id long, b_id long")


def _squared(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return dx * dx + dy * dy


def nearest(queries: DataFrame, boxes: DataFrame, k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = _squared) -> DataFrame:
    """qid, id, d for the k nearest boxes of each query point (a1, b1), ties of the k-th included.

    distance: of the gaps on the two axes, rising with each. Boxes are dealt by id; a task gives the k nearest of its own, with ties: of the
    first boxes all are ranked, and of the others only those no farther than the k-th of these.
    """

    def parts(q: Table, s: Table) -> Iterator[Table]:
        for a in range(0, len(q["id"]), TILE[0]):
            x, y = q["x1"][a : a + TILE[0], None], q["y1"][a : a + TILE[0], None]
            held, bound = [], np.inf
            for b in range(0, len(s["id"]), TILE[1]):
                x1, y1, x2, y2 = (s[c][b : b + TILE[1]] for c in BOX)
                d = distance(np.maximum(np.maximum(x1 - x, 0.0), x - x2), np.maximum(np.maximum(y1 - y, 0.0), y - y2))
                if d.shape[1] >= k:
                    if np.isscalar(bound):
                        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(d <= bound)
                held.append((i, j + b, d[i, j]))
            i, j, d = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.lexsort((d, i))
            i, j, d = i[order], j[order], d[order]
            starts = blocks._starts(i)
            size = np.diff(starts)
            if not len(size):
                continue
            most = np.where(size >= k, d[np.minimum(starts[:-1] + k - 1, len(d) - 1)], np.inf)
            use = d <= np.repeat(most, size)
            yield {"qid": q["id"][a + i[use]], "id": s["id"][j[use]], "d": d[use]}

    asked = queries.select("qid", "a1", "b1", F.lit(0.0).alias("a2"), F.lit(0.0).alias("b2"))
    found = blocks.against(_queries(asked), boxes.select(F.col("id").alias("traj_id"), "id", *BOX), bounding.kernel(parts), "qid long, id long, d double", "id")
    rank = F.rank().over(Window.partitionBy("qid").orderBy("d"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= k).drop("rk")


def region_10nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = src.boxes(spark, sf_dir)
    return nearest(query_boxes(boxes), boxes, 10).select("qid", "id", F.round("d", 6).alias("d2"))


def region_10nn_by_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With another distance: the sum of the gaps."""
    boxes = src.boxes(spark, sf_dir)
    return nearest(query_boxes(boxes), boxes, 10, lambda dx, dy: dx + dy).select("qid", "id", F.round("d", 6).alias("d"))


BY_SUM_DUCK = """WITH bq AS (SELECT id AS qid, x1 AS a1, y1 AS b1 FROM boxes WHERE id % 50 = 0), d AS (SELECT qid, id, greatest(x1 - a1, 0, a1 - x2) + greatest(y1 - b1, 0, b1 - y2) AS d FROM bq CROSS JOIN boxes),
r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY d) AS rk FROM d) SELECT qid, id, round(d, 6) AS d FROM r WHERE rk <= 10"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (region_intersects, region_contains, region_count, region_intersecting_area, point_location, region_selfjoin, region_10nn, region_10nn_by_sum)
}
