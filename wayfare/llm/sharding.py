"""Sharding by longest processing time: equal texts stay together, bytes come out near equal.

Groups go largest first, each to the least loaded shard. Groups of one size may change places, so the driver goes over
sizes, not groups: of a run of equal sizes, whole layers are filled at once and the rest goes through the heap, which gives each shard
as many groups as one by one. The groups of a size then take their shards by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import ranked, read_slices, salted_join, written

#: Sizes whose placement the driver holds at once.
PLAN_SLICE = 50_000
#: A part's number in the name of its file.
PART = r"part-(\d+)[^/]*$"


def lpt(sizes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """Of (size, groups) by falling size: each size and how many of its groups each shard gets. Equal loads: the lowest shard."""
    loads = [0] * shards
    for size, n in sizes:
        below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]  # noqa: B023, E731
        # the highest level that the groups fill: every shard gets groups while its load is below it
        low, high = min(loads), max(loads) + size * (n // shards + 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(below(mid)) <= n else (low, mid - 1)
        got = below(low)
        heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
        loads = [x + k * size for x, k in zip(loads, got, strict=True)]
        yield size, got


def _written_plan(spark: SparkSession, plan: Iterator[tuple[int, list[int]]]) -> DataFrame:
    """bytes, until: the rank at which each shard's groups of that size end."""

    def ends() -> Iterator[tuple[int, list[int]]]:
        for size, got in plan:
            until = [0]
            for k in got:
                until.append(until[-1] + k)
            yield size, until[1:]

    def slices() -> Iterator[DataFrame]:
        rows = ends()
        part = list(islice(rows, PLAN_SLICE))
        while True:
            yield spark.createDataFrame(part, "bytes long, until array<long>")
            if not (part := list(islice(rows, PLAN_SLICE))):
                return

    return read_slices(spark, slices(), "bytes long, until array<long>", "shard-plan")


def _ranked_by_place(put: DataFrame, each: int = 200_000) -> DataFrame:
    """Add slot: a gapless rank from 0 within each shard by (file, row), counted in runs of at most `each` rows of a file."""
    runs = put.withColumn("run", F.floor(F.col("row") / each))
    before = Window.partitionBy("shard").orderBy("file", "run").rowsBetween(Window.unboundedPreceding, -1)
    counts = runs.groupBy("shard", "file", "run").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("shard", "file", "run", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    inner = Window.partitionBy("shard", "file", "run").orderBy("row")
    return runs.withColumn("rn", F.row_number().over(inner) - 1).join(offsets, ["shard", "file", "run"]).withColumn("slot", (F.col("rn") + F.col("off")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 24, *, in_order: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law "bytes", shard, slot, grown_shard (null under this law).

    slot is gapless from 0 in each shard, by a hash of the document. in_order: docs is a table read from Parquet
    files, and slots follow its order, file after file (by part number) and row after row; docs that
    no file holds are written first.

    size is the text's UTF-8 bytes plus 8. Documents with equal texts get one shard; a null text
    counts as empty. Groups are weighed by one aggregation on the text's SHA-256 (partial sums first,
    so a hot text costs no skew), and every group is placed by its own size. The driver streams over the distinct sizes of groups: as
    they differ, at most the square root of twice the bytes, whatever the number of groups.
    No rows give no rows; doc_id may be null or repeated; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = []
    if in_order:
        try:
            docs.select("_metadata.row_index")
        except AnalysisException:
            docs = written(docs, "shard-input")
        path = F.col("_metadata.file_path")
        # numbers of more than five digits don't sort as text
        place = [F.struct(F.length(F.regexp_extract(path, PART, 1)).alias("digits"), F.regexp_extract(path, PART, 1).alias("part"), path.alias("path")).alias("file"), F.col("_metadata.row_index").alias("row")]
    kept = ["file", "row"] if in_order else []
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *place).select(
            *kept, "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("grp")
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = ((r["bytes"], r["count"]) for r in groups.groupBy("bytes").count().orderBy(F.col("bytes").desc()).toLocalIterator())
    plan = _written_plan(docs.sparkSession, lpt(sizes, shards))
    of_size = salted_join(ranked(groups, "bytes", [F.col("grp")], "rank"), plan, ["bytes"], ["grp"])
    of_group = of_size.select("grp", F.size(F.filter("until", lambda x: x <= F.col("rank"))).alias("shard"))
    # a hot text's rows are dealt over tasks
    put = salted_join(rows, of_group, ["grp"], ["doc_id"], salts=4).select(*kept, "doc_id", "size", "text_crc32", "shard")
    put = written(put, "shard-put")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed_rows = _ranked_by_place(put) if in_order else ranked(put, "shard", order, "slot")
    return placed_rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
