"""Bounding volumes of trajectory pieces as an index: clustered Parquet and a table of page bounds.

Pages are packed by sort-tile-recursion: slabs of equal numbers by time, in each strips by y, in each pages by x. The cut points are
approximate quantiles, which are merged from the partitions' sketches, so no task sorts a whole axis; they decide where a row lies, never whether it is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import points as src


@dataclass(frozen=True)
class IndexConfig:
    """page_rows: rows to a page; time_slab: seconds of a slab, or None for slabs of equal numbers; accuracy: of the quantiles."""

    page_rows: int = 1000
    time_slab: float | None = None
    accuracy: int = 10_000

    def __post_init__(self) -> None:
        if self.page_rows < 1 or self.accuracy < 1 or (self.time_slab is not None and not self.time_slab > 0):
            raise ValueError(f"no such index: {self}")


def _middle(axis: str) -> Column:
    return (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2


def _dealt(df: DataFrame, groups: list[str], axis: str, parts: int, out: str, accuracy: int) -> DataFrame:
    """Add out: which of `parts` quantile ranges of the axis a row lies in, within its group."""
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else None
    if shares is None:
        return df.withColumn(out, F.lit(0))
    marks = df.groupBy(*groups).agg(F.percentile_approx(_middle(axis), shares, accuracy).alias("marks"))
    joined = df.crossJoin(F.broadcast(marks)) if not groups else df.join(marks, groups)
    return joined.withColumn(out, F.size(F.filter("marks", lambda m: m < _middle(axis)))).drop("marks")


def pages(volumes: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """volumes (x1, y1, t1, x2, y2, t2 and any others) with the page of each: slab, strip, tile."""
    total = volumes.count()
    side = max(1, round(max(1, total / config.page_rows) ** (1 / 3)))
    if config.time_slab is None:
        out = _dealt(volumes, [], "t", side, "slab", config.accuracy)
    else:
        out = volumes.withColumn("slab", F.floor(_middle("t") / config.time_slab).cast("long"))
        side = max(1, math.ceil(math.sqrt(max(1, total / config.page_rows / max(1, out.select("slab").distinct().count())))))
    out = _dealt(out, ["slab"], "y", side, "strip", config.accuracy)
    return _dealt(out, ["slab", "strip"], "x", side, "tile", config.accuracy)


def page_bounds(paged: DataFrame) -> DataFrame:
    """One row a page: its number of rows and its box; leaves of the tree, and for coarser keys its inner nodes."""
    low, high = (lambda c: F.min(F.least(f"{c}1", f"{c}2")).alias(f"{c}low")), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"{c}high"))
    return paged.groupBy("slab", "strip", "tile").agg(F.count(F.lit(1)).alias("n"), *(f(c) for c in "xyt" for f in (low, high)))


def write_index(volumes: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> None:
    """path/rows: the volumes, a folder for each slab, files sorted by page; path/bounds: the pages."""
    paged = pages(volumes, config)
    paged.repartition("slab", "strip").sortWithinPartitions("slab", "strip", "tile", "x1").write.partitionBy("slab").parquet(f"{path}/rows")
    page_bounds(volumes.sparkSession.read.parquet(f"{path}/rows")).write.parquet(f"{path}/bounds")


def in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Rows whose boxes meet the box (xlow, ylow, tlow, xhigh, yhigh, thigh): only slabs and pages that meet it are read.

    The pages that meet are joined by their keys, which prunes the folders of the other slabs at run time.
    """
    x0, y0, t0, x1, y1, t1 = box
    hit = spark.read.parquet(f"{path}/bounds").filter((F.col("xlow") <= x1) & (F.col("xhigh") >= x0) & (F.col("ylow") <= y1) & (F.col("yhigh") >= y0) & (F.col("tlow") <= t1) & (F.col("thigh") >= t0))
    meets = lambda c, lo, hi: (F.least(f"{c}1", f"{c}2") <= hi) & (F.greatest(f"{c}1", f"{c}2") >= lo)
    rows = spark.read.parquet(f"{path}/rows").filter(meets("x", x0, x1) & meets("y", y0, y1) & meets("t", t0, t1))
    return rows.join(hit.select("slab", "strip", "tile"), ["slab", "strip", "tile"], "left_semi")


def statistics(bounds: DataFrame) -> DataFrame:
    """level, nodes, rows and the mean volume of a node: tiles, strips, slabs and the whole."""
    out = None
    for level, keys in enumerate((["slab", "strip", "tile"], ["slab", "strip"], ["slab"], [])):
        nodes = bounds.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.min(f"{c}low").alias(f"{c}low") for c in "xyt"), *(F.max(f"{c}high").alias(f"{c}high") for c in "xyt"))
        volume = F.avg((F.col("xhigh") - F.col("xlow")) * (F.col("yhigh") - F.col("ylow")) * (F.col("thigh") - F.col("tlow")))
        part = nodes.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("rows"), volume.alias("mean_volume"))
        out = part if out is None else out.unionByName(part)
    return out


def choose(forest: dict[tuple[float, float], str], duration: float) -> str:
    """The index whose closed range of query durations holds `duration`; at a shared end the one of the lower range."""
    for (low, high), path in sorted(forest.items()):
        if low <= duration <= high:
            return path
    raise ValueError(f"no index for queries of {duration} seconds")


def is_valid(paged: DataFrame, bounds: DataFrame) -> bool:
    """Whether every row lies in the box of its page and the pages' numbers add up."""
    out = F.lit(False)
    for c in "xyt":
        out = out | (F.least(f"{c}1", f"{c}2") < F.col(f"{c}low")) | (F.greatest(f"{c}1", f"{c}2") > F.col(f"{c}high"))
    joined = paged.join(bounds, ["slab", "strip", "tile"], "left")
    bad = joined.filter(F.col("n").isNull() | out).limit(1).count()
    return not bad and paged.count() == (bounds.agg(F.sum("n")).first()[0] or 0)


def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, seg_no) of segments that meet a box in space and time, through an index built for it."""
    from ..streaming.live import shared_folder

    path = shared_folder(spark, "index")
    write_index(src.segments(src.points(spark, sf_dir)), path)
    day0 = 1704067200.0
    return in_box(spark, path, (40.0, 40.0, day0 + 8 * 86400, 60.0, 60.0, day0 + 9 * 86400)).select("traj_id", "seg_no")


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the pages of an index by days are."""
    paged = pages(src.segments(src.points(spark, sf_dir)), IndexConfig(time_slab=86400.0))
    return page_bounds(paged).groupBy("slab").agg(F.sum("n").alias("n"), F.min("tlow").alias("tlow"), F.max("thigh").alias("thigh"))


RANGE_DUCK = "SELECT traj_id, seg_no FROM seg WHERE least(x1, x2) <= 60 AND greatest(x1, x2) >= 40 AND least(y1, y2) <= 60 AND greatest(y1, y2) >= 40 AND t1 <= 1704067200 + 9 * 86400 AND t2 >= 1704067200 + 8 * 86400"
PAGES_DUCK = "SELECT CAST(floor((t1 + t2) / 2 / 86400) AS BIGINT) AS slab, count(*) AS n, min(t1) AS tlow, max(t2) AS thigh FROM seg GROUP BY ALL"
QUERIES = {"index_range": index_range, "index_pages": index_pages}
