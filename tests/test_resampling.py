"""Samples of the seven-day window: nine, its end included."""

from wayfare.operators.similarity import START, resampled, rmdtw

END = START + 7 * 86400


def test_the_end_of_the_window_is_sampled(spark):
    rows = [(0, START, 0.0, 0.0), (0, END + 5, 8.0, 0.0), (1, START, 0.0, 0.0), (1, START + 3.5 * 86400, 4.0, 0.0), (1, END, 8.0, 0.0), (2, START, 0.0, 0.0), (2, END - 1, 8.0, 0.0)]
    pts = spark.createDataFrame([(i, float(t), x, y) for i, t, x, y in rows], "traj_id long, t double, x double, y double")
    got = sorted((r.traj_id, r.i) for r in resampled(pts).collect())
    assert got == [(0, i) for i in range(9)] + [(1, i) for i in range(9)] + [(2, i) for i in range(8)]


def test_the_last_hours_count(spark):
    rows = [(0, START, 0.0), (0, END - 3600 * 21, 0.0), (0, END, 0.0), (1, START, 0.0), (1, END - 3600 * 21, 0.0), (1, END, 6.0)]
    pts = spark.createDataFrame([(i, float(t), x, 0.0) for i, t, x in rows], "traj_id long, t double, x double, y double")
    assert {(r.qid, r.traj_id): r.dist for r in rmdtw(pts).collect()} == {(0, 0): 0.0, (0, 1): 6.0}
