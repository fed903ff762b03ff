"""Written intermediates, sizes and Arrow plumbing shared by the operators.

Intermediates are Parquet tables in the folder that ``spark.checkpoint.dir`` names,
so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The value of a null doc_id inside the operators, beside a flag, since it is a legal id too; so null sorts last.
NO_ID = np.iinfo(np.int64).max


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on this machine (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        conf = tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, gives real sizes to the planner."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    tidy(spark)
    return spark.read.schema(schema).parquet(path)


def read_slices(spark: SparkSession, slices: Iterator[DataFrame], ddl: str, name: str) -> DataFrame:
    """Append each of the slices to one table in the shared folder and read it back."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for part in slices:
        part.coalesce(1).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def buckets_for(rows: int, each: int, least: int = 8) -> int:
    """How many hash buckets hold `rows` at about `each` rows in a bucket."""
    return max(least, -(-int(rows) // each))


def ranked(df: DataFrame, group: str, order: list, out: str, each: int = 50_000) -> DataFrame:
    """Add `out`: a gapless rank from 0 within `group`, without one task per group.

    Rows are dealt by a hash of `order` into sub-buckets; a rank inside the sub-bucket plus
    the sizes of the sub-buckets before it make the rank. A hot group is spread over all of
    its sub-buckets. df should be a written table: it is read twice.
    """
    from pyspark.sql import Window

    n = buckets_for(df.count(), each, 32)
    dealt = df.withColumn("__sub", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(group, "__sub").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__g"), F.col("__sub").alias("__s"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off")
    )
    inner = Window.partitionBy(group, "__sub").orderBy(*order)
    local = dealt.withColumn("__rn", F.row_number().over(inner) - 1)
    return (
        local.join(offsets, local[group].eqNullSafe(offsets["__g"]) & (local["__sub"] == offsets["__s"]))
        .withColumn(out, (F.col("__rn") + F.col("__off")).cast("long"))
        .drop("__sub", "__g", "__s", "__rn", "__off")
    )


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 8, merge: bool = True) -> DataFrame:
    """big joined with small on keys, the rows of a hot key dealt over `salts` tasks by a hash of `by`; small has a key once.

    merge: merged at every size, for a small side that grows with the corpus; otherwise Spark broadcasts a written
    table whose files are below its limit.
    """
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    every = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = every.hint("merge") if merge else every
    return dealt.join(every, [*keys, "__salt"], how).drop("__salt")


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Runs of rows whose texts (column "text"; null reads as empty) come to about `limit` bytes."""
    rows: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        first = 0
        for i, value in enumerate(col):
            t = value.as_py() or b""
            if texts and size + len(t) > limit:
                if i > first:
                    rows.append(batch.slice(first, i - first))
                yield rows, texts
                rows, texts, size, first = [], [], 0, i
            texts.append(t)
            size += len(t) + 1
        if batch.num_rows > first:
            rows.append(batch.slice(first))
    if texts:
        yield rows, texts


def beside(docs: DataFrame, columns: str, make: Callable[[], Callable[[list[bytes]], list[np.ndarray]]], limit: int) -> DataFrame:
    """docs with further `columns` (DDL) of its texts; `make` gives a task the function from about `limit` bytes of texts to them.

    Rows stay in Arrow batches, so only the texts of one slice are Python objects at a time.
    """
    new = StructType.fromDDL(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = make()
        for rows, texts in text_slices(batches, limit):
            values, at = of_texts(texts), 0
            for b in rows:
                more = [pa.array(v[at : at + b.num_rows]) for v in values]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *new.names])
                at += b.num_rows

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new.fields]))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has, for columns of the operator's own beside them."""
    p = "__"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def column(rows: list[pa.RecordBatch], name: str) -> pa.ChunkedArray:
    return pa.chunked_array([b.column(b.schema.get_field_index(name)) for b in rows])


def ids_of(rows: list[pa.RecordBatch], name: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """The ids as int64, NO_ID for null, and whether each is null."""
    ids = column(rows, name).cast(pa.int64())
    return ids.fill_null(NO_ID).to_numpy(), ids.is_null().to_numpy().astype(bool)


def id_array(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)
