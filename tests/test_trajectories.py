"""Catalog queries against DuckDB on the smallest tables, and cutters' invariants."""

import duckdb
import numpy as np
import pytest

from wayfare.operators import cutters
from wayfare.plans import catalog
from wayfare.sources import points as src

DIR = "/root/testdata/sf0.001"
NAMES = ["traj_segments", "dataset_stats", "position_at_time", "range_cylinder", "knn_ied", "ied_pairwise", "region_10nn", "region_selfjoin", "moving_area"]


def rows(df, columns):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, DIR).toPandas(), con.execute(catalog.duck_sql(name)).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


@pytest.mark.parametrize("method", ["iss", "gss", "rdp", "opts"])
def test_pieces_cover_the_trajectory(method):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(1, 90, 200))
    v = rng.uniform(0, 10, (200, 2))
    out = cutters.pieces(method, 120.0, t, v, 0.0)
    assert out[0][2] == t[0] and out[-1][3] == t[-1]
    assert all(abs(a[3] - b[2]) < 1e-9 for a, b in zip(out, out[1:], strict=False))


def test_dump_round_trip(spark, tmp_path):
    pts = src.points(spark, DIR)
    src.dump_lines(pts).coalesce(1).write.text(str(tmp_path / "dump"))
    back = src.read_dump(spark, str(tmp_path / "dump"))
    assert back.count() == pts.count()
