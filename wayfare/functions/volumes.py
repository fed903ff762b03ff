"""Bounding volumes of trajectory pieces as columns: boxes, cones and lines, and their text form.

A volume is a struct of three structs, each null if the piece has none: box(xmin, ymin, tmin, xmax, ymax, tmax),
cone(xs, ys, ts, xe, ye, te, rd, rv) and line(xs, ys, ts, xe, ye, te). A cone is the chord with the
largest distance rd from it and the largest speed rv away from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "tmin", "xmax", "ymax", "tmax")
CONE = ("xs", "ys", "ts", "xe", "ye", "te", "rd", "rv")
LINE = ("xs", "ys", "ts", "xe", "ye", "te")
PARTS = {"box": BOX, "cone": CONE, "line": LINE}


def volume_text(volume: Column) -> Column:
    """Three flags (0 or 1), then the numbers of the parts that are there, parted by blanks."""
    flags = [F.when(volume[p].isNotNull(), "1").otherwise("0") for p in PARTS]
    # concat_ws leaves out nulls, so an absent part adds nothing
    numbers = [volume[p][n].cast("string") for p, names in PARTS.items() for n in names]
    return F.concat_ws(" ", *flags, *numbers)


def parse_volume(text: Column) -> Column:
    """The struct that volume_text wrote; null for a null text."""
    words = F.split(F.trim(text), r"\s+")
    out, first = [], F.lit(3)
    for i, (part, names) in enumerate(PARTS.items()):
        there = F.get(words, F.lit(i)) == "1"
        fields = F.struct(*(F.get(words, first + k).cast("double").alias(n) for k, n in enumerate(names)))
        out.append(F.when(there, fields).alias(part))
        first = first + F.when(there, len(names)).otherwise(0)
    return F.when(text.isNotNull(), F.struct(*out))


def cone_centre(cone: Column, t: Column) -> tuple[Column, Column]:
    """The chord's position at t."""
    f = (t - cone["ts"]) / (cone["te"] - cone["ts"])
    return cone["xs"] + f * (cone["xe"] - cone["xs"]), cone["ys"] + f * (cone["ye"] - cone["ys"])


def cone_radius(cone: Column, t: Column) -> Column:
    """How far from the chord the object can be at t; rd alone where no finite speed is known."""
    free = F.isnan(cone["rv"]) | (F.abs(cone["rv"]) == float("inf"))
    return F.when(free, cone["rd"]).otherwise(F.least((t - cone["ts"]) * cone["rv"], cone["rd"], (cone["te"] - t) * cone["rv"]))


def box_distance(box: Column, x: Column, y: Column) -> Column:
    """Distance in the plane of a point from a box; 0 inside."""
    out = F.lit(0.0)
    return F.hypot(F.greatest(box["xmin"] - x, out, x - box["xmax"]), F.greatest(box["ymin"] - y, out, y - box["ymax"]))
