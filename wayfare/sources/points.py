"""Sources: points of trajectories, their segments, boxes and the text format for trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of the slabs in which a trajectory's points are sorted.
SLAB = 86400


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, t (epoch seconds), x, y from the events table; only four of its columns are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("traj_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


def segments(pts: DataFrame) -> DataFrame:
    """Adjacent points of each trajectory as traj_id, seg_no, t1, x1, y1, t2, x2, y2, has_prev, has_next.

    Points are sorted by trajectory and slab of time, and slabs are linked through their first points and numbers of points,
    so a trajectory with very many points is spread over tasks. Points without an id or a time belong to none.
    """
    rows = pts.select("traj_id", F.floor(F.col("t") / SLAB).alias("slab"), "t", "x", "y").filter("traj_id IS NOT NULL AND t IS NOT NULL")
    slab = Window.partitionBy("traj_id", "slab")
    w, whole = slab.orderBy("t", "x", "y"), slab.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # both sides sort the same shuffled points, which Spark then shuffles once
    heads = rows.select("*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(whole).alias("n")).filter("rn = 1")
    along = Window.partitionBy("traj_id").orderBy("slab")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    links = heads.select("traj_id", "slab", before.alias("before"), *(F.lead(c).over(along).alias(f"{c}3") for c in "txy"), F.sum("n").over(Window.partitionBy("traj_id")).alias("total"))
    numbered = rows.select("*", F.row_number().over(w).alias("rn"), *(F.lead(c).over(w).alias(f"{c}2") for c in "txy"))
    linked = numbered.join(links, ["traj_id", "slab"]).select(
        "traj_id", (F.col("before") + F.col("rn") - 1).alias("seg_no"), *(F.col(c).alias(f"{c}1") for c in "txy"), *(F.when(F.col("t2").isNull(), F.col(f"{c}3")).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in "txy"), "total"
    )
    return linked.filter("t2 > t1").select("traj_id", "seg_no", "t1", "x1", "y1", "t2", "x2", "y2", (F.col("seg_no") + 2 < F.col("total")).alias("has_next"), (F.col("seg_no") > 0).alias("has_prev"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x1, y1, x2, y2: a box for each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x1, y1 = F.col("c_acctbal") / 100, F.col("c_nationkey") * 4.0
    return c.select(F.col("c_custkey").alias("id"), x1.alias("x1"), y1.alias("y1"), (x1 + 1 + F.col("c_custkey") % 7).alias("x2"), (y1 + 1 + F.col("c_custkey") % 5).alias("y2"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v: points of as many dimensions as the embeddings have."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Text of alternating lines, an id and then "x,y,t x,y,t ...", one file or many.

    A line with a comma holds points; they belong to the id on the line before, blank lines aside. Files are read in blocks, and
    a block's first line looks to the last one of the block before. Points without an id are left out, as are trajectories of one point
    or whose first time is not before the last.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place")).filter("trim(value) <> ''")
    names = F.when(~F.col("value").contains(","), F.trim("value"))
    last = lines.groupBy("file", "block").agg(F.max_by(names, "place").alias("last"))
    ends = last.select("file", "block", F.lag("last").over(Window.partitionBy("file").orderBy("block")).alias("carried"))
    here = Window.partitionBy("file", "block").orderBy("place")
    paired = lines.select("file", "block", "value", F.lag(names).over(here).alias("name"), (F.row_number().over(here) == 1).alias("first")).filter(F.col("value").contains(","))
    named = paired.join(ends, ["file", "block"]).select(F.when(F.col("first"), F.col("carried")).otherwise(F.col("name")).cast("bigint").alias("traj_id"), F.split(F.trim("value"), " +").alias("p"))
    rows = named.filter("traj_id IS NOT NULL AND size(p) >= 2").select("traj_id", F.transform("p", lambda s: F.split(s, ",").cast("array<double>")).alias("p")).filter("p[0][2] < element_at(p, -1)[2]")
    return rows.select("traj_id", F.posexplode("p").alias("seq", "v")).select("traj_id", "seq", *(F.col("v")[i].alias(c) for i, c in enumerate("xyt")))


def dump_lines(pts: DataFrame) -> DataFrame:
    """The text format of read_dump: one row a trajectory, two lines in `value`; write it with df.write.text."""
    p = F.array_sort(F.collect_list(F.struct("t", "x", "y")))
    text = F.array_join(F.transform(F.col("p"), lambda s: F.format_string("%.6f,%.6f,%.6f", s["x"], s["y"], s["t"])), " ")
    return pts.groupBy("traj_id").agg(p.alias("p")).select(F.concat(F.col("traj_id").cast("string"), F.lit("\n"), text).alias("value"))


def append_dump(pts: DataFrame, path: str) -> None:
    """Add trajectories to a dump, numbered on from its greatest id in the order of their own ids."""
    spark = pts.sparkSession
    last = read_dump(spark, path).agg(F.max("traj_id")).first()[0]
    ids = pts.select("traj_id").distinct()
    # ids are numbered in ranges, not in one task
    ranged = ids.repartitionByRange("traj_id").sortWithinPartitions("traj_id").select("traj_id", F.spark_partition_id().alias("part"))
    within = Window.partitionBy("part").orderBy("traj_id")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    numbered = ranged.withColumn("rn", F.row_number().over(within)).join(before, "part").select("traj_id", (F.lit(-1 if last is None else last) + F.col("off") + F.col("rn")).alias("new_id"))
    dump_lines(pts.join(numbered, "traj_id").drop("traj_id").withColumnRenamed("new_id", "traj_id")).write.mode("append").text(path)


def append_points(pts: DataFrame, path: str) -> None:
    """Add points to a Parquet store of them; ids are kept."""
    pts.select("traj_id", "t", "x", "y").write.mode("append").parquet(path)
