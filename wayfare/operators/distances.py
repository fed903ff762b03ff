"""The distance integrals of pairs of trajectories, in blocks of pairs; the formula is that of the catalog's SQL, term by term."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import blocks
from .blocks import Table


def position(s: Table, j: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments j are at the times t."""
    t1, t2 = s["t1"][j], s["t2"][j]
    x1, y1 = s["x1"][j], s["y1"][j]
    return x1 + (s["x2"][j] - x1) * (t - t1) / (t2 - t1), y1 + (s["y2"][j] - y1) * (t - t1) / (t2 - t1)


def ways(q: Table, s: Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a block: its number of row, and pieces as query row, object row and common time."""
    starts = blocks._starts(q["traj_id"])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        i, j = blocks.pieces(q["t1"][a:b], q["t2"][a:b], s["t1"], s["t2"])
        if len(i):
            i = i + a
            yield a, i, j, np.maximum(s["t1"][j], q["t1"][i]), np.minimum(s["t2"][j], q["t2"][i])


def steps(q: Table, s: Table, i: np.ndarray, j: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """How far the object is from the query at the start and at the end of each piece."""
    sx, sy = position(s, j, start)
    qx, qy = position(q, i, start)
    ex, ey = position(s, j, end)
    rx, ry = position(q, i, end)
    return sx - qx, sy - qy, ex - rx, ey - ry


def _mean(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The mean of sqrt(a u^2 + b u + c) for u from 0 to 1."""
    root, d = np.sqrt(c), 4 * a * c - b * b
    end = 2 * a + b
    out = (end * np.sqrt(np.maximum(a + b + c, 0)) - b * root) / (4 * a)
    r = np.sqrt(d)
    bent = d / (8 * np.power(a, 1.5)) * (np.arcsinh(end / r) - np.arcsinh(b / r))
    return np.where(a < 1e-12, root, np.where(d > 1e-12, out + bent, out))


def _filled(ok: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values if ok.all() else np.where(ok, values, 0.0)


def sums(kind: str) -> Callable[[Table, Table], Iterator[pa.RecordBatch]]:
    """dist, static_dist and moving_dist of pairs that live at the same time; null where no piece has a position."""

    def run(q: Table, s: Table) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        with np.errstate(all="ignore"):
            for at, i, j, start, end in ways(q, s):
                use = (s["ts"][j] < q["te"][at]) & (s["te"][j] > q["ts"][at])
                if not use.all():
                    i, j, start, end = i[use], j[use], start[use], end[use]
                if not len(j):
                    continue
                dx1, dy1, dx2, dy2 = steps(q, s, i, j, start, end)
                vx, vy = dx2 - dx1, dy2 - dy1
                a, b, c, h = vx * vx + vy * vy, 2 * (dx1 * vx + dy1 * vy), dx1 * dx1 + dy1 * dy1, end - start
                f, still = h * _mean(a, b, c), s["still"][j] == 1
                rest = 2 * f if kind == "ied" else 2 * np.minimum(np.sqrt(c), np.sqrt(a + b + c)) * h
                known = s["known"][j] * q["known"][i] > 0
                whole, rest, f = _filled(known, np.where(still, rest, f)), _filled(known, np.where(still, rest, 0.0)), _filled(known, np.where(still, 0.0, f))
                runs = blocks._starts(s["traj_id"][j])[:-1]
                # a sum of no known values is null, but pieces of the other kind count as 0
                n = [np.add.reduceat(v.astype(np.int64), runs) for v in (known, known | ~still, known | still)]
                totals = [np.add.reduceat(v, runs) for v in (whole, rest, f)]
                found.append([np.full(len(runs), q["traj_id"][at]), s["traj_id"][j[runs]], *totals, *n])
        if found:
            qid, traj_id, *rest = (np.concatenate(v) for v in zip(*found, strict=True))
            values = [pa.array(blocks.rounded(v, 4), mask=n == 0) for v, n in zip(rest[:3], rest[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(traj_id), *values], names=["qid", "traj_id", "dist", "static_dist", "moving_dist"])

    return run


SUMS = "qid long, traj_id long, dist double, static_dist double, moving_dist double"


def areas(side: float) -> Callable[[Table, Table], Iterator[pa.RecordBatch]]:
    """The area that two boxes of the same side share, summed over time: Simpson's rule is exact between the turns of the overlap."""

    def run(q: Table, s: Table) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        with np.errstate(all="ignore"):
            for at, i, j, start, end in ways(q, s):
                x1, y1, x2, y2 = steps(q, s, i, j, start, end)
                near = (np.minimum(x1, x2) <= side) & (np.maximum(x1, x2) >= -side) & (np.minimum(y1, y2) <= side) & (np.maximum(y1, y2) >= -side)
                if not near.any():
                    continue
                j, h, x1, y1, x2, y2 = (v[near] for v in (j, end - start, x1, y1, x2, y2))
                vx, vy = x2 - x1, y2 - y1
                turns = np.stack([np.zeros(len(j)), np.ones(len(j)), *((w - a) / v for a, v in ((x1, vx), (y1, vy)) for w in (-side, 0, side))], axis=1)
                # a turn outside of the piece makes a part of no length
                c = np.sort(np.where((turns >= 0) & (turns <= 1), turns, 0.0), axis=1)

                def shared(u: np.ndarray) -> np.ndarray:
                    return np.maximum(0.0, side - np.abs(x1[:, None] + u * vx[:, None])) * np.maximum(0.0, side - np.abs(y1[:, None] + u * vy[:, None]))  # noqa: B023

                a, b = c[:, :-1], c[:, 1:]
                ends = shared(c)
                area = h * ((b - a) / 6 * (ends[:, :-1] + 4 * shared((a + b) / 2) + ends[:, 1:])).sum(axis=1)
                runs = blocks._starts(s["traj_id"][j])[:-1]
                found.append([np.full(len(runs), q["traj_id"][at]), s["traj_id"][j[runs]], np.add.reduceat(area, runs)])
        if found:
            qid, traj_id, area = (np.concatenate(v) for v in zip(*found, strict=True))
            met = area > 0.01
            yield pa.RecordBatch.from_arrays([pa.array(qid[met]), pa.array(traj_id[met]), pa.array(blocks.rounded(area[met], 1))], names=["qid", "traj_id", "area"])

    return run


AREAS = "qid long, traj_id long, area double"
