"""Streams of points: daily boxes with a watermark, and segments as their second points arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENT = "traj_id long, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double"
LAST = "t double, x double, y double"


def point_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """traj_id, at (timestamp), t, x, y from the event files of a folder, new files as they come."""
    e = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", pattern).parquet(folder)
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("traj_id"), at.alias("at"), (F.unix_micros(at) / 1000000.0).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")
    )


def daily_boxes(points: DataFrame, late: str = "2 days") -> DataFrame:
    """Box and number of points by trajectory and day; points later than `late` are dropped by the watermark."""
    day = F.window("at", "1 day")
    return (
        points.withWatermark("at", late).groupBy("traj_id", day.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_points"), *(f(c).alias(f"{c}{f.__name__}") for c in ("x", "y") for f in (F.min, F.max)))
        .select("traj_id", F.unix_seconds("w.start").alias("day_start"), "n_points", "xmin", "xmax", "ymin", "ymax")
    )


def live_segments(points: DataFrame) -> DataFrame:
    """Segments between points of a trajectory that follow one another; the state of a trajectory is its last point.

    Within a batch points are sorted by time; one that is not after the last point seen makes no segment.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values(["t", "x", "y"])[["t", "x", "y"]]
        if state.exists:
            last = pd.DataFrame([state.get], columns=["t", "x", "y"])
            new = pd.concat([last, new[new["t"] > last["t"].iloc[0]]])
        new = new.drop_duplicates("t")
        state.update(tuple(float(v) for v in new.iloc[-1]))
        both = pd.concat([new.iloc[:-1].reset_index(drop=True), new.iloc[1:].reset_index(drop=True)], axis=1)
        both.columns = ["t1", "x1", "y1", "t2", "x2", "y2"]
        both.insert(0, "traj_id", key[0])
        yield both

    return points.groupBy("traj_id").applyInPandasWithState(step, SEGMENT, LAST, "append", GroupStateTimeout.NoTimeout)


def _work_dir(spark: SparkSession) -> str:
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share."""
    return f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for the files that are there now, as a written table.

    Batches go to folders of their own number, so one that is run again after a failure replaces itself;
    in complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    top = shared_folder(spark, "stream")
    schema, last = stream.schema, []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{top}/out/batch={last[0]}")
    return spark.read.schema(schema).parquet(f"{top}/out/batch=*")


def stream_daily_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(daily_boxes(point_stream(spark, sf_dir)), "complete")


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(live_segments(point_stream(spark, sf_dir)), "append")
    return out.select("traj_id", *(F.round(c, 3).alias(c) if c in ("t1", "t2") else c for c in ("t1", "x1", "y1", "t2", "x2", "y2")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_daily_boxes": stream_daily_boxes, "stream_segments": stream_segments}

SQL = {
    "stream_daily_boxes": "SELECT user_id AS traj_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_start, count(*) AS n_points, min(value) AS xmin, max(value) AS xmax, min(CAST(props->>'k' AS DOUBLE)) AS ymin, max(CAST(props->>'k' AS DOUBLE)) AS ymax FROM events GROUP BY ALL",
    "stream_segments": "WITH p AS (SELECT user_id AS traj_id, epoch(ts) AS t1, value AS x1, CAST(props->>'k' AS DOUBLE) AS y1 FROM events), l AS (SELECT *, lead(t1) OVER w AS t2, lead(x1) OVER w AS x2, lead(y1) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY traj_id ORDER BY t1)) SELECT traj_id, round(t1, 3) AS t1, x1, y1, round(t2, 3) AS t2, x2, y2 FROM l WHERE t2 > t1",
}
