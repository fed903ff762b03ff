"""Cutting pieces out of trajectories and linking them again."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from test_trajectories import DIR, rows

from wayfare.operators import linking
from wayfare.plans import catalog
from wayfare.sources import points as src


def pieces(spark, data):
    return spark.createDataFrame(data, "traj_id long, t double, x double, y double, made boolean")


def test_linked_points_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    a, b = catalog.queries()["linked_points"](spark, DIR).toPandas(), con.execute(catalog.duck_sql("linked_points")).df()
    assert len(a) and rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_clip_makes_only_the_ends_that_are_missing(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 0.0), (1, 20.0, 10.0, 10.0), (2, 5.0, 1.0, 1.0), (2, 6.0, 2.0, 2.0)], "traj_id long, t double, x double, y double")
    got = sorted(map(tuple, linking.clip(src.segments(pts), 5.0, 20.0).collect()))
    assert got == [(1, 5.0, 5.0, 0.0, True), (1, 10.0, 10.0, 0.0, False), (1, 20.0, 10.0, 10.0, False), (2, 5.0, 1.0, 1.0, False), (2, 6.0, 2.0, 2.0, False)]


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("made", [False, True])
def test_the_common_point(spark, made, turned):
    one = pieces(spark, [(1, 0.0, 0.0, 0.0, False), (1, 4.0, 4.0, 0.0, made), (7, 1.0, 1.0, 1.0, False)])
    two = pieces(spark, [(1, 4.0, 4.0, 0.0, made), (1, 9.0, 9.0, 0.0, False), (8, 2.0, 2.0, 2.0, True)])
    got = sorted(linking.link(two, one).collect() if turned else linking.link(one, two).collect())
    assert [(r.traj_id, r.t) for r in got] == [(1, 0.0), *([] if made else [(1, 4.0)]), (1, 9.0), (7, 1.0), (8, 2.0)]


def test_pieces_apart_are_an_error(spark):
    with pytest.raises(PySparkException, match="common end"):
        linking.link(pieces(spark, [(1, 0.0, 0.0, 0.0, False), (1, 1.0, 0.0, 0.0, False)]), pieces(spark, [(1, 2.0, 0.0, 0.0, False), (1, 3.0, 0.0, 0.0, False)])).collect()
