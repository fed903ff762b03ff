"""Sequential cutters and simplifiers of trajectories: one trajectory at a time, in Arrow batches.

A cut is a row (traj_id, piece, s_idx, e_idx, t_start, t_end, xmin, xmax, ymin, ymax); the pieces of a
trajectory share their end points.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import points as src

SCHEMA = "traj_id long, piece int, s_idx int, e_idx int, t_start double, t_end double, xmin double, xmax double, ymin double, ymax double"
SOFT = 0.2
#: Seconds within which a sample lies on a mark.
EXACT = 1e-7


def _bounds(t: np.ndarray, v: np.ndarray, s: int, e: int, head: tuple | None, tail: tuple | None) -> tuple:
    """The piece from sample s to e; head and tail are interpolated ends that replace those samples."""
    part = v[s + (head is not None) : e + 1 - (tail is not None)]
    ends = [p[1:] for p in (head, tail) if p]
    if ends:
        part = np.vstack([part, ends])
    (x0, y0), (x1, y1) = part.min(axis=0), part.max(axis=0)
    return s, e, head[0] if head else t[s], tail[0] if tail else t[e], x0, x1, y0, y1


def greedy(t: np.ndarray, v: np.ndarray, length: float, origin: float) -> list[tuple]:
    """Cut at origin + length, + 2 length, ...: at the sample before if it is within SOFT of a length of the mark,
    else at the sample after if that is, else between them by interpolation."""
    out, start, s, head, i = [], origin, 0, None, 1
    while i < len(t):
        mark = start + length
        if t[i] < mark:
            i += 1
            continue
        exact = abs(t[i] - mark) < EXACT
        last = head[0] if head and s == i - 1 else t[i - 1]
        if not exact and last > start + (1 - SOFT) * length and i - 1 > s:
            out.append(_bounds(t, v, s, i - 1, head, None))
            s, head = i - 1, None
        elif exact or t[i] < start + (1 + SOFT) * length:
            out.append(_bounds(t, v, s, i, head, None))
            s, head = i, None
            i += 1
        elif mark > last:
            f = (mark - t[i - 1]) / (t[i] - t[i - 1])
            mid = (mark, *(v[i - 1] + f * (v[i] - v[i - 1])))
            out.append(_bounds(t, v, s, i, head, mid))
            s, head = i - 1, mid
        start += length
    if s < len(t) - 1:
        out.append(_bounds(t, v, s, len(t) - 1, head, None))
    return out


def deviations(t: np.ndarray, v: np.ndarray, s: int, e: int) -> np.ndarray:
    """Distance of the samples between s and e from the chord at the same time."""
    f = ((t[s + 1 : e] - t[s]) / (t[e] - t[s]))[:, None]
    return np.hypot(*(v[s + 1 : e] - (v[s] + f * (v[e] - v[s]))).T)


def split_most(t: np.ndarray, v: np.ndarray, parts: int) -> list[int]:
    """Split the piece with the largest deviation until there are `parts`; ties: the first piece and sample."""
    ends = [0, len(t) - 1]
    while len(ends) - 1 < parts:
        best = (0.0, -1)
        for s, e in zip(ends, ends[1:], strict=False):
            if e - s > 1 and (d := deviations(t, v, s, e)).max() > best[0]:
                best = (float(d.max()), s + 1 + int(np.argmax(d)))
        if best[1] < 0:
            break
        ends = sorted([*ends, best[1]])
    return ends


def within(t: np.ndarray, v: np.ndarray, eps: float) -> list[int]:
    """Samples that are left when pieces are split at their largest deviation while it is eps or more."""
    keep, todo = {0, len(t) - 1}, [(0, len(t) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s > 1 and (d := deviations(t, v, s, e)).max() >= eps:
            k = s + 1 + int(np.argmax(d))
            keep.add(k)
            todo += [(s, k), (k, e)]
    return sorted(keep)


def at_marks(t: np.ndarray, v: np.ndarray, marks: np.ndarray) -> list[tuple]:
    """Cut at each mark between the first and the last sample, by interpolation where no sample lies on it."""
    marks = marks[(marks > t[0] + EXACT) & (marks < t[-1] - EXACT)]
    near = np.clip(np.searchsorted(t, marks - EXACT), 0, len(t) - 1)
    on = np.abs(t[near] - marks) < EXACT
    at = [(None, 0)] + [(None, int(k)) if hit else ((m, np.interp(m, t, v[:, 0]), np.interp(m, t, v[:, 1])), int(k)) for m, k, hit in zip(marks, near, on, strict=True)] + [(None, len(t) - 1)]
    # an interpolated end lies between the sample before it and `near`
    return [_bounds(t, v, s - (head is not None), e, head, tail) for (head, s), (tail, e) in pairwise(at)]


def whole_samples(t: np.ndarray, length: float) -> list[int]:
    """Samples to cut at, so that a piece is shorter than `length` or has two samples."""
    ends = [0]
    while ends[-1] < len(t) - 1:
        ends.append(min(len(t) - 1, max(ends[-1] + 1, int(np.searchsorted(t, t[ends[-1]] + length)) - 1)))
    return ends


def grid_origin(start: float, dataset_start: float, length: float) -> float:
    """The mark from which a trajectory's first piece counts: the first one whose soft end lies after `start`."""
    base = int(dataset_start) // int(length) * int(length)
    return base + max(0, math.floor((start - base - (1 - SOFT) * length) / length) + 1) * length


def pieces(method: str, length: float, t: np.ndarray, v: np.ndarray, dataset_start: float) -> list[tuple]:
    """The pieces of one trajectory.

    iss: greedy from its own start; gss: greedy on the data set's grid; rdp, rdpn: as many pieces as its time holds lengths, or eight;
    opts: few pieces by deviation, each cut on the grid; rdp_up: rdp with the number rounded up; hybrid: few pieces by deviation,
    each cut exactly at the grid's marks; samples: no interpolation; simplify: while the deviation is `length` or more.
    A cut that falls on a sample moves on by one length like any other, and a piece's s_idx is the sample that it starts at.
    """
    lengths, lines = (t[-1] - t[0]) / length, len(t) - 1

    def among(ends: list[int]) -> list[tuple]:
        return [_bounds(t, v, s, e, None, None) for s, e in pairwise(ends)]

    def in_parts(parts: int, inner: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> list[tuple]:
        return [(a + s, b + s, *rest) for s, e in pairwise(split_most(t, v, max(1, parts))) for a, b, *rest in inner(t[s : e + 1], v[s : e + 1])]

    def on_grid(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        return greedy(t, v, length, grid_origin(t[0], dataset_start, length))

    def exactly(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        origin = float(int(dataset_start))
        return at_marks(t, v, origin + length * np.arange(max(1, math.floor((t[0] - origin) / length)), math.ceil((t[-1] - origin) / length) + 1))

    if method == "iss":
        return greedy(t, v, length, t[0])
    if method == "gss":
        return on_grid(t, v)
    if method in ("rdp", "rdp_up", "rdpn"):
        parts = {"rdp": int(lengths), "rdp_up": math.ceil(lengths), "rdpn": 8}[method]
        return among(split_most(t, v, max(1, min(parts, lines))))
    if method in ("opts", "hybrid") and math.ceil(lengths) == 1:
        return among([0, lines])
    if method == "opts":
        return in_parts(min(math.ceil(lengths) // 5, math.ceil(math.sqrt(lines))), on_grid)
    if method == "hybrid":
        return in_parts(min(math.ceil(lengths) // 5, math.isqrt(lines)), exactly)
    if method == "samples":
        return among(whole_samples(t, length))
    if method == "simplify":
        return among(within(t, v, length))
    raise ValueError(f"no such cutter: {method}")


def cut(pts: DataFrame, method: str, length: float, dataset_start: float) -> DataFrame:
    """The cutters of pieces(), with a piece length in seconds, or for simplify a deviation.

    Points come sorted by trajectory and time; a task holds one batch and the trajectory that the batch before left open.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]

    def one(key: int, t: np.ndarray, v: np.ndarray) -> list[tuple]:
        first = np.concatenate(([True], t[1:] != t[:-1]))
        t, v = t[first], v[first]
        return [(key, k, *r) for k, r in enumerate(pieces(method, length, t, v, dataset_start))] if len(t) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            new = [batch.column(k).to_numpy() for k in range(4)] if batch is not None else [np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3))]
            key, t, x, y = new if left is None else [np.concatenate(p) for p in zip(left, new, strict=True)]
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), *([len(key)] if batch is None else [])]
            v = np.stack((x, y), axis=1)
            rows = [r for s, e in pairwise(edge) if e > s for r in one(int(key[s]), t[s:e], v[s:e])]
            left = [c[edge[-1] :] for c in (key, t, x, y)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = pts.select(F.col("traj_id").cast("long"), *(F.col(c).cast("double") for c in "txy"))
    return need.repartition(parts, "traj_id").sortWithinPartitions("traj_id", "t", "x", "y").mapInArrow(run, SCHEMA)


METHODS = {"cut_iss": ("iss", 259200.0), "cut_gss": ("gss", 259200.0), "cut_rdp": ("rdp", 259200.0), "cut_opts": ("opts", 86400.0), "cut_rdp_up": ("rdp_up", 259200.0), "cut_hybrid": ("hybrid", 86400.0), "cut_samples": ("samples", 259200.0), "simplify_rdp": ("simplify", 40.0), "simplify_rdpn": ("rdpn", 259200.0)}
DATASET_START = 1704067200.0


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(method: str, length: float, spark: SparkSession, sf_dir: str) -> DataFrame:
        return cut(src.points(spark, sf_dir), method, length, DATASET_START)

    return {k: functools.partial(run, *v) for k, v in METHODS.items()}
