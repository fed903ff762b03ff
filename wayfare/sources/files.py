"""Further file formats of trajectories: GPS CSV, tab-separated moving objects, sub-trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A trajectory's last line in a sub-trajectory file, and with its line end the separator of records.
LAST = "ESubTraj"


def read_gps_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """traj_id, t, x, y from CSV with a header line and the columns id, x, y, t; a folder or pattern reads all its files."""
    rows = spark.read.schema("traj_id long, x double, y double, t double").csv(path, header=True, enforceSchema=True)
    return rows.select("traj_id", "t", "x", "y")


def read_moving_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """traj_id, t, x, y, speed from tab-separated fields 2, 5, 6, 7 and 8."""
    kinds = "kind string, traj_id long, seq string, class string, t double, x double, y double, speed double"
    return spark.read.schema(kinds).csv(path, sep="\t").select("traj_id", "t", "x", "y", "speed")


def piece_lines(pieces: DataFrame) -> DataFrame:
    """traj_id, piece, t, x, y to one row a trajectory in the sub-trajectory format; write it with write_pieces."""
    point = F.format_string("%.6f,%.6f,%.6f", F.col("x"), F.col("y"), F.col("t"))
    by_piece = pieces.groupBy("traj_id", "piece").agg(F.array_sort(F.collect_list(F.struct("t", point.alias("p")))).alias("p"))
    line = F.array_join(F.transform("p", lambda s: s["p"]), " ")
    whole = by_piece.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("piece", line.alias("line")))).alias("l"))
    return whole.select(F.concat_ws("\n", F.lit("SubTraj"), F.col("traj_id").cast("string"), F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("")).alias("value"))


def write_pieces(pieces: DataFrame, path: str) -> None:
    piece_lines(pieces).write.option("lineSep", f"{LAST}\n").text(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, piece, t, x, y from sub-trajectory files.

    A record runs to the line that ends its trajectory, so large files are split between tasks; a last END is no record.
    """
    records = spark.read.text(path, lineSep=f"{LAST}\n").select(F.split(F.trim("value"), "\n").alias("l")).filter("l[0] = 'SubTraj'")
    lines = records.select(F.expr("cast(l[1] as bigint)").alias("traj_id"), F.posexplode(F.expr("filter(slice(l, 3, size(l)), x -> x <> '')")).alias("piece", "line"))
    points = lines.select("traj_id", "piece", F.explode(F.split(F.trim("line"), " +")).alias("p"))
    xyt = F.split("p", ",").cast("array<double>")
    return points.select("traj_id", "piece", xyt[2].alias("t"), xyt[0].alias("x"), xyt[1].alias("y"))
