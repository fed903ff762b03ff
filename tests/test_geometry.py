"""Bounds, geometry, grid joins and the index: against their SQL, and against what must hold whatever the SQL says."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trajectories import DIR, rows

from wayfare.functions import statistics
from wayfare.operators import index, similarity
from wayfare.plans import bounds, catalog, geometry, grid
from wayfare.sources import points as src

NAMES = [*bounds.QUERIES, *geometry.QUERIES, *grid.QUERIES, *index.QUERIES, *similarity.DUCK, "resample_query", "segment_intersects_segment", "expand_replicas"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "customer", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    a, b = catalog.queries()[name](spark, DIR).toPandas(), con.execute(catalog.duck_sql(name)).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


@pytest.fixture(scope="module")
def tracks(spark):
    p = src.points(spark, DIR).toPandas().sort_values(["traj_id", "t"])
    return {i: g[["t", "x", "y"]].to_numpy() for i, g in p.groupby("traj_id")}


def apart(tracks, a, b, lo, hi, n=400_000):
    t = np.linspace(lo, hi, n)
    xy = [[np.interp(t, tracks[k][:, 0], tracks[k][:, c]) for c in (1, 2)] for k in (a, b)]
    return t, np.hypot(xy[0][0] - xy[1][0], xy[0][1] - xy[1][1])


def test_integrals_by_quadrature(spark, tracks):
    """The distance integral over the common time, from the definition."""
    got = {(r.qid, r.traj_id): r.moving_dist for r in catalog.queries()["moving_center_distance"](spark, DIR).collect()}
    for (a, b), value in itertools.islice(sorted(got.items()), 6):
        lo = max(geometry.FROM, tracks[a][0, 0], tracks[b][0, 0])
        hi = min(geometry.TO, tracks[a][-1, 0], tracks[b][-1, 0])
        t, d = apart(tracks, a, b, lo, hi)
        assert value == pytest.approx(np.trapezoid(d, t), rel=1e-5, abs=1)


@pytest.mark.parametrize("name", ["volume_bounds", "cone_integral_bounds"])
def test_bounds_hold(spark, tracks, name):
    got = {(r.qid, r.traj_id): (r.opt, r.pes) for r in catalog.queries()[name](spark, DIR).collect()}
    for (a, b), (opt, pes) in got.items():
        lo, hi = max(tracks[a][0, 0], tracks[b][0, 0]), min(tracks[a][-1, 0], tracks[b][-1, 0])
        t, d = apart(tracks, a, b, lo, hi, 100_000)
        if name == "cone_integral_bounds":  # pieces between weeks have no cone
            week = np.floor((t - 1704067200) / 604800)
            for w in np.unique(week):
                own = tracks[b][np.floor((tracks[b][:, 0] - 1704067200) / 604800) == w]
                d[(week == w) & ((len(own) < 2) | (t < own[0, 0] if len(own) else True) | (t > own[-1, 0] if len(own) else True))] = 0
        exact = np.trapezoid(d, t)
        assert opt <= exact * 1.001 + 10 and exact <= pes * 1.001 + 10


def test_segments_meet_at_ends_and_on_one_line(spark):
    lines = [(0, 0, 0, 20, 20), (1, 0, 90, 90, 90), (2, 10, 10, 10, 0), (3, 95, 95, 99, 99), (4, 0, 20, 20, 0), (5, 0, 1, 2, 3), (6, 50, 50, 50, 60), (7, 90, 95, 95, 90)]
    seg = spark.createDataFrame([(i, 0, float(a), float(b), float(c), float(d)) for i, a, b, c, d in lines], "traj_id long, seg_no int, x1 double, y1 double, x2 double, y2 double")
    got = spark.sql(catalog.SQL["segment_intersects_segment"].replace("FROM seg", "FROM {seg}"), seg=seg)
    assert sorted(r.traj_id for r in got.collect()) == [0, 1, 2, 4, 6]


def test_nearest_of_few_and_far(spark):
    boxes = spark.createDataFrame([(i, x, y, x + 1, y + 1) for i, (x, y) in enumerate([(0.0, 0.0), (1e5, -1e5), (3.0, 0.0), (-7e4, 4.0)])], "id long, x1 double, y1 double, x2 double, y2 double")
    queries = boxes.select(F.col("id").alias("qid"), F.col("x1").alias("a1"), F.col("y1").alias("b1"))
    got = grid.nearest(queries, boxes, 3).collect()
    for q in queries.collect():
        want = sorted((max(b.x1 - q.a1, 0, q.a1 - b.x2) ** 2 + max(b.y1 - q.b1, 0, q.b1 - b.y2) ** 2, b.id) for b in boxes.collect())[:3]
        assert sorted((r.d, r.id) for r in got if r.qid == q.qid) == want
    assert len(grid.nearest(queries, boxes, 10).collect()) == 16


def test_warping_path():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 5), (6, 4), (9, 9)):
        q, o = rng.uniform(0, 9, (n, 2)), rng.uniform(0, 9, (m, 2))
        best = {}
        for i in range(n):
            for j in range(m):
                before = [best[k] for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best]
                best[i, j] = np.hypot(*(q[i] - o[j])) + (min(before) if before else 0)
        path = similarity.alignment(q, o)
        assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
        assert all((c - a, d - b) in ((0, 1), (1, 0), (1, 1)) for (a, b), (c, d) in itertools.pairwise(path))
        assert sum(np.hypot(*(q[i] - o[j])) for i, j in path) == pytest.approx(best[n - 1, m - 1]) == pytest.approx(similarity.dtw(q[None], o[None])[0])


def test_index(spark, tmp_path):
    seg = src.segments(src.points(spark, DIR)).cache()
    for config in (index.IndexConfig(page_rows=50), index.IndexConfig(page_rows=50, time_slab=86400.0)):
        paged = index.pages(seg, config).cache()
        pages = index.page_bounds(paged)
        assert index.is_valid(paged, pages) and paged.count() == seg.count()
        assert pages.agg(F.max("n")).first()[0] <= 6 * 50
        levels = {r.level: (r.nodes, r.rows) for r in index.statistics(pages).collect()}
        assert levels[3] == (1, seg.count()) and levels[0][0] >= levels[1][0] >= levels[2][0]
    index.write_index(seg, str(tmp_path / "ix"), index.IndexConfig(page_rows=50))
    box = (20.0, 20.0, 1704067200.0 + 3e5, 50.0, 70.0, 1704067200.0 + 9e5)
    got = index.in_box(spark, str(tmp_path / "ix"), box)
    want = seg.filter(f"least(x1, x2) <= 50 and greatest(x1, x2) >= 20 and least(y1, y2) <= 70 and greatest(y1, y2) >= 20 and t1 <= {box[5]} and t2 >= {box[2]}")
    assert sorted(map(tuple, got.select("traj_id", "seg_no").collect())) == sorted(map(tuple, want.select("traj_id", "seg_no").collect()))
    forest = {(0, 600): "short", (600, 7200): "long"}
    assert [index.choose(forest, x) for x in (0, 600, 601, 7200)] == ["short", "short", "long", "long"]
    with pytest.raises(ValueError):
        index.choose(forest, 7201)
    with pytest.raises(ValueError):
        index.IndexConfig(page_rows=0)


def test_statistics_text_and_estimates():
    s = statistics.Stats(bt=100.0, total_time=1e6, line_count=7, traj_count=2, v=0.25, sr=3.0, p=50.0, f=40.0)
    assert statistics.Stats.parse(s.text()) == s
    td = statistics.known(s, "td")
    assert (td.line_count, td.vmax, td.v) == (16205956, 1e-3, 0.25) and statistics.known(s, "none") == s
    assert statistics.displacement(td, "td", 50.0) == pytest.approx(2e-3) and statistics.speed(td, "td") == pytest.approx(4e-5)
    assert statistics.deviation(s, "od", 10.0) == pytest.approx(120.928) and statistics.deviation(s, "own", 8.0) == 2.0
    side, seconds = statistics.node_extent(s, "own")
    assert seconds == pytest.approx(side * 100 / 25) and side > 25


def test_append(spark, tmp_path):
    pts = spark.createDataFrame([(i, float(t), float(t), float(i)) for i in (4, 9, 30) for t in range(4)], "traj_id long, t double, x double, y double")
    src.dump_lines(pts).coalesce(1).write.text(str(tmp_path / "dump"))
    src.append_dump(pts.filter("traj_id > 4"), str(tmp_path / "dump"))
    got = {(r.traj_id, r.y) for r in src.read_dump(spark, str(tmp_path / "dump")).collect()}
    assert got == {(4, 4.0), (9, 9.0), (30, 30.0), (31, 9.0), (32, 30.0)}
    for _ in range(2):
        src.append_points(pts, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 24
