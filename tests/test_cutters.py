"""Cutters against plain versions of their definitions; segments and dumps over slabs and blocks."""

import bisect
import math

import numpy as np
import pytest
from test_trajectories import DIR

from wayfare.operators import cutters
from wayfare.sources import points as src

LENGTH, START = 120.0, 1000.7


def made(seed, n=150, whole=False):
    rng = np.random.default_rng(seed)
    t = START + 50 + np.cumsum(rng.integers(1, 12, n) * 10.0 if whole else rng.exponential(40, n))
    return t, np.cumsum(rng.normal(0, 3, (n, 2)), axis=0)


def position(t, v, at):
    return [float(np.interp(at, t, v[:, k])) for k in (0, 1)]


def box_between(t, v, a, b):
    xy = [position(t, v, a), position(t, v, b), *(p for s, p in zip(t, v, strict=True) if a < s < b)]
    return [f(p[k] for p in xy) for k in (0, 1) for f in (min, max)]


def check(got, t, v, cuts):
    assert [r[2] for r in got] == pytest.approx(cuts[:-1]) and [r[3] for r in got] == pytest.approx(cuts[1:])
    for s, e, a, b, *box in got:
        assert t[s] <= a + 1e-6 and b <= t[e] + 1e-6 and (s + 1 == len(t) or t[s + 1] > a + 1e-9) and t[e - 1] < b
        assert box == pytest.approx(box_between(t, v, a, b))


def soft_cuts(t, origin):
    """Mark after mark: the sample before it if that is in the last fifth, else the one after if that is at most a fifth late, else the mark."""
    cuts, start = [t[0]], origin
    while True:
        mark = start + LENGTH
        after = bisect.bisect_left(t.tolist(), mark - 1e-7)
        if after == len(t):
            break
        if abs(t[after] - mark) < 1e-7:
            cuts.append(t[after])
        elif t[after - 1] > start + 0.8 * LENGTH:
            cuts.append(t[after - 1])
        elif t[after] < start + 1.2 * LENGTH:
            cuts.append(t[after])
        else:
            cuts.append(mark)
        start = mark
    return cuts if cuts[-1] >= t[-1] - 1e-9 else [*cuts, t[-1]]


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_soft_cuts(seed, whole):
    t, v = made(seed, whole=whole)
    check(cutters.pieces("iss", LENGTH, t, v, START), t, v, soft_cuts(t, t[0]))
    origin = int(START) // int(LENGTH) * int(LENGTH)
    while origin + 0.8 * LENGTH <= t[0]:
        origin += LENGTH
    assert cutters.grid_origin(t[0], START, LENGTH) == origin
    check(cutters.pieces("gss", LENGTH, t, v, START), t, v, soft_cuts(t, origin))


@pytest.mark.parametrize("share", [0.05, 0.79, 0.81, 0.99])
def test_late_start_in_a_cell_counts_from_the_next_mark(share):
    t = 960 + LENGTH * share + np.arange(40) * 30.0
    first = cutters.pieces("gss", LENGTH, t, np.stack((t, -t), axis=1), START)[0]
    assert (first[3] > 960 + 1.5 * LENGTH) == (share > 0.8)


@pytest.mark.parametrize("seed", range(4))
def test_exact_marks(seed):
    t, v = made(seed, whole=seed % 2 == 0)
    marks = START + 0.3 + LENGTH * np.arange(200)
    inside = [m for m in marks if t[0] + 1e-7 < m < t[-1] - 1e-7]
    check(cutters.at_marks(t, v, marks), t, v, [t[0], *inside, t[-1]])


def strays(t, v, s, e):
    """(deviation, sample) of the first sample between s and e that strays most from the chord."""
    best = (-1.0, -1)
    for k in range(s + 1, e):
        f = (t[k] - t[s]) / (t[e] - t[s])
        d = math.dist(v[k], [v[s][c] + f * (v[e][c] - v[s][c]) for c in (0, 1)])
        if d > best[0]:
            best = (d, k)
    return best


def parts_of(t, v, n):
    ends = [0, len(t) - 1]
    while len(ends) <= n:
        d, k = max((strays(t, v, s, e) for s, e in zip(ends, ends[1:], strict=False)), key=lambda x: x[0])
        if d <= 0:
            break
        bisect.insort(ends, k)
    return ends


def kept(t, v, s, e, eps):
    d, k = strays(t, v, s, e)
    return [s, e] if d < eps else [*kept(t, v, s, k, eps)[:-1], *kept(t, v, k, e, eps)]


@pytest.mark.parametrize("seed", range(4))
def test_parts_by_deviation(seed):
    t, v = made(seed)
    lengths = (t[-1] - t[0]) / LENGTH
    ends = lambda method: [r[0] for r in cutters.pieces(method, LENGTH, t, v, START)] + [len(t) - 1]
    assert ends("rdp") == parts_of(t, v, int(lengths)) and ends("rdp_up") == parts_of(t, v, math.ceil(lengths)) and ends("rdpn") == parts_of(t, v, 8)
    eps = 5.0
    assert [r[0] for r in cutters.pieces("simplify", eps, t, v, START)] + [len(t) - 1] == kept(t, v, 0, len(t) - 1, eps)


@pytest.mark.parametrize("seed", range(4))
def test_parts_are_cut_on_the_grid(seed):
    t, v = made(seed)
    number = math.ceil((t[-1] - t[0]) / LENGTH)
    for method, parts in (("opts", min(number // 5, math.ceil(math.sqrt(len(t) - 1)))), ("hybrid", min(number // 5, math.isqrt(len(t) - 1)))):
        want = []
        for s, e in zip(parts_of(t, v, parts), parts_of(t, v, parts)[1:], strict=False):
            part = t[s : e + 1]
            if method == "opts":
                cuts = soft_cuts(part, cutters.grid_origin(part[0], START, LENGTH))
            else:
                cuts = [part[0], *(m for m in int(START) + LENGTH * np.arange(1, 200) if part[0] + 1e-7 <= m < part[-1] - 1e-7), part[-1]]
            want += cuts[:-1]
        check(cutters.pieces(method, LENGTH, t, v, START), t, v, [*want, t[-1]])


def test_short_trajectories_stay_whole():
    t, v = np.array([2000.0, 2030.0, 2050.0]), np.array([[0.0, 0], [5, 1], [0, 0]])
    for method in ("rdp", "opts", "hybrid", "rdp_up", "samples"):
        assert [r[:2] for r in cutters.pieces(method, LENGTH, t, v, START)] == [(0, 2)]


def test_whole_samples():
    t = np.array([0.0, 10, 20, 100, 119, 130, 500, 501, 700])
    assert [r[:2] for r in cutters.pieces("samples", LENGTH, t, np.zeros((9, 2)), 0.0)] == [(0, 4), (4, 5), (5, 6), (6, 7), (7, 8)]


def test_segments_over_slabs(spark):
    """Ties, repeated points, empty slabs, single points and points without an id or time."""
    day = float(src.SLAB)
    data = [(1, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (1, day, 2.0, 2.0), (1, day, 2.0, 2.0), (1, 5 * day, 3.0, 3.0), (1, 5 * day + 1, None, 4.0)]
    data += [(2, 5.0, 1.0, 1.0), (3, -1.0, 1.0, 1.0), (3, 1.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0), (None, 2.0, 1.0, 1.0), (3, None, 1.0, 1.0)]
    pts = spark.createDataFrame(data, "traj_id long, t double, x double, y double")
    got = sorted(map(tuple, src.segments(pts).select("traj_id", "seg_no", "t1", "x1", "t2", "x2", "has_prev", "has_next").collect()))
    assert got == [
        (1, 2, 0.0, 1.0, day, 2.0, True, True), (1, 4, day, 2.0, 5 * day, 3.0, True, True), (1, 5, 5 * day, 3.0, 5 * day + 1, None, True, False), (3, 0, -1.0, 1.0, 1.0, 1.0, False, False),
    ]


def test_dump_in_small_blocks(spark, tmp_path):
    """Ids and points that fall into different blocks of a file; blank lines and points without an id."""
    src.dump_lines(src.points(spark, DIR)).coalesce(2).write.text(str(tmp_path / "dump"))
    (tmp_path / "dump" / "more.txt").write_text("1.0,1.0,1.0 2.0,2.0,2.0\n900001\n\n1.0,2.0,3.0 4.0,5.0,6.0\n900002\n900003\n1.0,2.0,3.0\n")
    whole = sorted(map(tuple, src.read_dump(spark, str(tmp_path / "dump")).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, n in zip(old, ("200", "1"), strict=True):
            spark.conf.set(k, n)
        blocks = spark.read.text(str(tmp_path / "dump")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        small = sorted(map(tuple, src.read_dump(spark, str(tmp_path / "dump")).collect()))
    finally:
        for k, n in old.items():
            spark.conf.set(k, n)
    assert blocks > 10 and small == whole and len(whole) == src.points(spark, DIR).count() + 2
    assert [r for r in whole if r[0] > 900000] == [(900001, 0, 1.0, 2.0, 3.0), (900001, 1, 4.0, 5.0, 6.0)]
