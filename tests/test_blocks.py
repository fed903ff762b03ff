"""Pairs in blocks: no piece of a pair is shuffled, blocks and batches do not change rows, edges are those of the SQL."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trajectories import DIR, rows

from wayfare.operators import blocks, similarity
from wayfare.plans import catalog, grid, regions

PAIRS = ["knn_ied_ties", "knn_ied_batch", "knn_ied_pruned", "static_distance", "moving_intersecting_area", "cone_integral_bounds", "static_box_distance", "gap_bounds", "rmdtw_bounds", "moving_region_holds", "box_algebra", "vector_nearest"]
ALL_PAIRS = ["farthest_apart", "moving_regions_combined", "moving_regions_meet", "node_bounds", "volume_bounds"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "customer", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PAIRS + ALL_PAIRS)
def test_pieces_are_not_joined_by_slabs(spark, name):
    text = plan(catalog.queries()[name](spark, DIR))
    assert "MapInArrow" in text and not re.search(r"Join \[slab#", text)


@pytest.mark.parametrize("name", PAIRS + ALL_PAIRS)
def test_many_blocks_and_small_batches(spark, con, name, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(blocks, "PIECES", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        a = catalog.queries()[name](spark, DIR).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = con.execute(catalog.duck_sql(name)).df()
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_log_edges_are_those_of_the_sql(spark):
    # 0.3 + 5 < 5.3 and 5.3 - 0.3 <= 5 differ in the last bit; the SQL compares with the sum
    cases = [(a / 100, b / 100) for a in range(0, 900, 7) for b in ((a + 500), (a - 500)) if b >= 0]
    log = [(2 * k, k, "signup", v, 1.0) for k, (_, v) in enumerate(cases)] + [(10_000 + k, 5_000 + k, "view", q, 1.0) for k, (q, _) in enumerate(cases)]
    ops = spark.createDataFrame(log, "event_id long, id long, op string, x double, y double")
    got = {(r.qid, r.id) for r in spark.sql(regions.OPLOG_SPARK.replace("FROM ops", "FROM {ops}"), ops=ops).collect()}
    want = {(10_000 + i, k) for i, (q, _) in enumerate(cases) for k, (_, v) in enumerate(cases) if q - 5 <= v <= q + 5}
    assert got == want


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_every_trajectory_is_asked_about(spark, con, name):
    everyone = {r[0] for r in con.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    assert {r.qid for r in catalog.queries()[name](spark, DIR).select("qid").distinct().collect()} == everyone
    assert "% 50" not in catalog.duck_sql(name)


@pytest.mark.parametrize("name", ["region_10nn", "region_10nn_by_sum", "region_intersects", "region_contains", "region_count", "region_intersecting_area", "region_selfjoin", "point_location"])
def test_boxes_in_small_blocks(spark, con, name, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 2)
    monkeypatch.setattr(blocks, "PIECES", 30)
    monkeypatch.setattr(grid, "TILE", (2, 11))
    df = catalog.queries()[name](spark, DIR)
    # cells and levels of them were joined and their pairs shuffled
    assert "MapInArrow" in plan(df) and not re.search(r"Join \[(level|gx|hx)", plan(df))
    a, b = df.toPandas(), con.execute(catalog.duck_sql(name)).df()
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_a_crowded_cell_is_dealt_over_tasks(spark):
    boxes = spark.range(400).selectExpr("id", "1D AS x1", "1D AS y1", "2D AS x2", "2D AS y2")
    queries = boxes.filter("id < 3").selectExpr("id AS qid", "x1 AS a1", "y1 AS b1", "x2 AS a2", "y2 AS b2")
    got = grid.meeting(queries, boxes, grid._pairs, "qid long, id long").withColumn("task", F.spark_partition_id()).toPandas()
    assert len(got) == 1200 and got.groupby("task").id.nunique().max() < 200


def test_paths_of_many_pairs_at_once():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 6), (5, 1), (9, 9), (4, 13)):
        # whole numbers make ties
        q, o = rng.integers(0, 3, (40, n, 2)).astype(float), rng.integers(0, 3, (40, m, 2)).astype(float)
        pair, step, i, j = similarity.paths(q, o)
        for k in range(40):
            mine = sorted(zip(*(v[pair == k].tolist() for v in (step, i, j)), strict=True))
            assert [s for s, _, _ in mine] == list(range(len(mine)))
            assert [(a, b) for _, a, b in mine] == similarity.alignment(q[k], o[k])
