"""File formats, bounding volumes, streams and queries with a plan of their own."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_trajectories import DIR, rows

from wayfare.functions import volumes
from wayfare.plans import catalog
from wayfare.sources import files

NAMES = ["knn_ied_pruned", "moving_intersecting_area", "moving_center_distance", "oplog_replay", "cone_bounds", "range_mbr_exact", "region_intersecting_area", "stream_daily_boxes", "stream_segments"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, DIR).toPandas(), con.execute(catalog.duck_sql(name)).df()
    assert len(a) and sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_gps_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,t\n1,2.5,3,4\n1,3,3.5,8\n")
    (tmp_path / "b.csv").write_text("id,x,y,t\n2,0,0,1\n")
    got = files.read_gps_csv(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 4.0, 2.5, 3.0), (1, 8.0, 3.0, 3.5), (2, 1.0, 0.0, 0.0)]


def test_moving_objects(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("newpoint\t7\t1\t0\t10\t1.5\t2.5\t3.5\n")
    assert list(map(tuple, files.read_moving_objects(spark, str(tmp_path / "a.tsv")).collect())) == [(7, 10.0, 1.5, 2.5, 3.5)]


def test_pieces_round_trip(spark, tmp_path):
    data = [(i, p, float(t + 10 * p), i * 0.5, p - 0.25) for i in (3, -4, 12) for p in range(3) for t in range(4)]
    pieces = spark.createDataFrame(data, "traj_id long, piece int, t double, x double, y double")
    files.write_pieces(pieces, str(tmp_path / "pieces"))
    assert sorted(map(tuple, files.read_pieces(spark, str(tmp_path / "pieces")).collect())) == sorted(data)


def test_pieces_as_laid_down(spark, tmp_path):
    (tmp_path / "one.txt").write_text("SubTraj\n5\n1.0,2.0,3.0 4.0,5.0,6.0\n4.0,5.0,6.0 7.0,8.0,9.0\nESubTraj\nEND\n")
    got = sorted(map(tuple, files.read_pieces(spark, str(tmp_path / "one.txt")).collect()))
    assert got == [(5, 0, 3.0, 1.0, 2.0), (5, 0, 6.0, 4.0, 5.0), (5, 1, 6.0, 4.0, 5.0), (5, 1, 9.0, 7.0, 8.0)]


def test_volume_text(spark):
    df = spark.createDataFrame([("1 0 0 0 1 2 3 4 5.5",), ("0 1 1 0 0 0 1 1 10 2 0.5 0 0 0 1 1 10",), ("0 0 0",), (None,)], "s string")
    df = df.withColumn("v", volumes.parse_volume(F.col("s")))
    box, both, none, null = df.select("v").collect()
    assert tuple(box.v.box) == (0, 1, 2, 3, 4, 5.5) and box.v.cone is None and box.v.line is None
    assert tuple(both.v.cone) == (0, 0, 0, 1, 1, 10, 2, 0.5) and tuple(both.v.line) == (0, 0, 0, 1, 1, 10)
    assert tuple(none.v) == (None, None, None) and null.v is None
    again = df.filter("s is not null").withColumn("w", volumes.parse_volume(volumes.volume_text(F.col("v"))))
    assert all(r.v == r.w for r in again.collect())


def test_cone_and_box_at_a_point(spark):
    df = spark.createDataFrame([("0 1 0 0 0 0 8 0 10 2 0.5",), ("0 1 0 0 0 0 8 0 10 2 Infinity",)], "s string").withColumn("v", volumes.parse_volume(F.col("s")))
    x, y = volumes.cone_centre(df["v.cone"], F.lit(1.0))
    got = df.select(x.alias("x"), y.alias("y"), volumes.cone_radius(df["v.cone"], F.lit(1.0)).alias("r")).collect()
    assert [tuple(r) for r in got] == [(0.8, 0.0, 0.5), (0.8, 0.0, 2.0)]
    box = spark.createDataFrame([("1 0 0 0 0 0 2 2 9",)], "s string").select(volumes.parse_volume(F.col("s")).alias("v"))
    assert box.select(volumes.box_distance(F.col("v.box"), F.lit(5.0), F.lit(6.0))).first()[0] == 5.0
