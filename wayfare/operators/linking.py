"""Pieces of trajectories as points with a mark on interpolated ones: cutting them out and linking them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import points as src

DAY0, DAY = 1704067200, 86400


def clip(segments: DataFrame, start: float, end: float) -> DataFrame:
    """traj_id, t, x, y, made: the points from start to end, with interpolated ends (made) where no point lies there."""

    def knot(t: str, made: str, late: int) -> Column:
        f = F.expr(f"({t} - t1) / (t2 - t1)")
        # a point keeps its own coordinates
        own = [F.when(F.expr(made), F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * f).otherwise(F.col(f"{c}{late + 1}")) for c in "xy"]
        return F.struct(F.expr(t).alias("t"), F.lit(late).alias("late"), own[0].alias("x"), own[1].alias("y"), F.expr(made).alias("made"))

    low, high = f"greatest(t1, {float(start)!r}D)", f"least(t2, {float(end)!r}D)"
    both = F.array(knot(low, f"t1 < {float(start)!r}D", 0), knot(high, f"t2 > {float(end)!r}D", 1))
    knots = segments.filter((F.col("t1") < end) & (F.col("t2") > start)).select("traj_id", F.inline(both))
    # a point is the end of one segment and the start of the next, which wins
    return knots.groupBy("traj_id", "t").agg(F.min(F.struct("late", "x", "y", "made")).alias("k")).select("traj_id", "t", "k.x", "k.y", "k.made")


def link(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points of pieces a and b (as from clip) of the same trajectories, which must have an end in common.

    The common point stays once, as a has it, and goes if it is made in a. A piece without another one stays as it is; two pieces without
    a common end are an error.
    """
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    ends = both.groupBy("traj_id").agg(*(f(F.when(F.col("side") == k, F.col("t"))).alias(n) for k, n0 in ((0, "a"), (1, "b")) for f, n in ((F.min, f"{n0}0"), (F.max, f"{n0}1"))))
    # at least one side has points, so a null bound means that the other has none
    shared = F.expr("CASE WHEN a0 IS NULL OR b0 IS NULL THEN NULL WHEN a1 = b0 THEN a1 WHEN b1 = a0 THEN a0 ELSE raise_error(concat('pieces without a common end: trajectory ', traj_id)) END")
    ends = ends.select("traj_id", shared.alias("shared"))
    kept = F.col("shared").isNull() | (F.col("t") != F.col("shared")) | ((F.col("side") == 0) & ~F.col("made"))
    return both.join(ends, "traj_id").filter(kept).select("traj_id", "t", "x", "y", "made")


def linked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pieces, cut at the end of day 8, linked again: the points of days 5 to 12."""
    seg = src.segments(src.points(spark, sf_dir))
    marks = [DAY0 + d * DAY for d in (5, 8, 12)]
    out = link(clip(seg, marks[0], marks[1]), clip(seg, marks[1], marks[2]))
    return out.select("traj_id", F.round("t", 3).alias("t"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "made")


_AT = lambda c, t: f"round({c}1 + ({c}2 - {c}1) * ({t} - t1) / (t2 - t1), 6)"
#: The same without a cut in between.
LINKED_DUCK = f"""WITH ws AS (SELECT unnest([{DAY0 + 5 * DAY}, {DAY0 + 12 * DAY}]) AS w)
SELECT traj_id, round(t, 3) AS t, round(x, 6) AS x, round(y, 6) AS y, FALSE AS made FROM points WHERE t BETWEEN {DAY0 + 5 * DAY} AND {DAY0 + 12 * DAY} AND traj_id IN (SELECT traj_id FROM seg WHERE t1 < {DAY0 + 12 * DAY} AND t2 > {DAY0 + 5 * DAY})
UNION ALL SELECT traj_id, w, {_AT('x', 'w')}, {_AT('y', 'w')}, TRUE FROM seg JOIN ws ON t1 < w AND w < t2"""
QUERIES = {"linked_points": linked_points}
