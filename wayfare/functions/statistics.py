"""Statistics of a dataset as a row of text, fixed ones of known datasets, and estimates from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Stats:
    """In the order of the text: time base, time of all lines, lines, trajectories, mean time of a line and of a trajectory, speed, bounds
    and extents, length of all lines, spatial radius, period, fractal dimension, page fan-out, greatest speed."""

    bt: float = 0.0
    total_time: float = 0.0
    line_count: int = 0
    traj_count: int = 0
    tl: float = 0.0
    jt: float = 0.0
    v: float = 0.0
    xmin: float = 0.0
    xmax: float = 0.0
    ymin: float = 0.0
    ymax: float = 0.0
    tmin: float = 0.0
    tmax: float = 0.0
    dx: float = 0.0
    dy: float = 0.0
    dt: float = 0.0
    dist: float = 0.0
    sr: float = 0.0
    p: float = 0.0
    df: float = 2.0
    f: float = 50.0
    vmax: float = 0.0

    def text(self) -> str:
        return " ".join(repr(getattr(self, x.name)) for x in fields(self))

    @classmethod
    def parse(cls, text: str) -> Stats:
        return cls(*((int if x.type == "int" else float)(word) for x, word in zip(fields(cls), text.split(), strict=True)))


#: Fixed values of known datasets.
KNOWN = {
    "gl": {"total_time": 1.31808e08, "line_count": 20069299, "traj_count": 20619, "tl": 6.56764, "jt": 6392.55, "sr": 0.5, "df": 1.25, "p": 60000.0},
    "glexpand": {"total_time": 1.31808e09, "line_count": 200692990, "traj_count": 206190, "tl": 6.56764, "jt": 6392.55, "sr": 0.5, "df": 1.25, "p": 600000.0},
    "td": {"total_time": 5.20574e09, "line_count": 16205956, "traj_count": 10267, "tl": 321.224, "jt": 507037.0, "sr": 0.5, "df": 1.56, "p": 533315.0, "vmax": 1e-3},
    "tdexpand": {"total_time": 5.20574e10, "line_count": 162059560, "traj_count": 102670, "tl": 321.224, "jt": 507037.0, "sr": 0.5, "df": 1.56, "p": 5333150.0, "vmax": 1e-3},
    "od": {"sr": 10000.0, "df": 1.4, "p": 5000.0},
}


def known(stats: Stats, dataset: str) -> Stats:
    """stats with the fixed values of a known dataset; those of another stay."""
    return replace(stats, **KNOWN.get(dataset, {}))


def displacement(stats: Stats, dataset: str, seconds: float) -> float:
    """How far an object gets in that time."""
    kind = dataset.removesuffix("expand")
    if kind == "gl":
        return 4.5e-5 * seconds - 1e-5 / 4000 * seconds * seconds
    return {"td": 4e-5, "od": 55.0}.get(kind, stats.v) * seconds


def speed(stats: Stats, dataset: str) -> float:
    """The speed over the time base; that of the statistics for an unknown dataset."""
    return displacement(stats, dataset, stats.bt) / stats.bt if dataset.removesuffix("expand") in KNOWN else stats.v


def deviation(stats: Stats, dataset: str, seconds: float) -> float:
    """How far an object strays from the chord in that time."""
    a, b, c = {"gl": (0.0, 2e-05, 0.0023), "td": (0.0, 1e-05, 0.0003), "od": (-0.0326, 20.289, -78.702)}.get(dataset.removesuffix("expand"), (0.0, stats.v, 0.0))
    return a * seconds * seconds + b * seconds + c


def node_extent(stats: Stats, dataset: str) -> tuple[float, float]:
    """Side and time of a page's box, from the fan-out."""
    moved = displacement(stats, dataset, stats.bt)
    side = (math.pi * stats.sr**2 * stats.p * stats.total_time * moved / stats.bt**2 / stats.f) ** 0.33 + moved
    return side, side * stats.bt / moved


def steps(stats: Stats, pages: int) -> int:
    """How many time slabs to pack that many pages into."""
    n = int((pages * stats.v**2 * stats.p**2 / (math.pi * stats.sr**2) ** 2) ** (1 / 3)) if stats.sr else 1
    return n if 1 <= n <= pages else 1
