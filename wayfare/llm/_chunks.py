"""Texts in compressed chunks, and compact messages between chunks and hash buckets.

A chunk is a few MB of whole texts with their ids, written once, so that every later pass sees the
same chunk under the same number. Passes over chunks send sorted hashes to buckets (ranges of the
hash), delta-coded and compressed: two to four bytes a hash instead of a row each. Buckets answer
with bit sets, one bit a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import ids_of, text_slices, written

CHUNK_BYTES = 3 << 20
CHUNK_SCHEMA = "chunk long, n_bytes long, n_units long, ids binary, lens binary, blob binary"


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def release(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    flat = np.frombuffer(release(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(release(data), np.uint8), count=n).view(bool)


def bounds(buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's range of `bits`-bit hashes starts, the first one left out."""
    return np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)


def cuts(values: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket that has some of the sorted values."""
    edge = np.concatenate(([0], np.searchsorted(values, starts), [len(values)]))
    for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        yield b, int(edge[b]), int(edge[b + 1])


def chunk_row(ids: np.ndarray, null: np.ndarray, texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return pack(np.concatenate((ids.astype(np.int64), null.astype(np.int64)))), pack(lens), squeeze(b"".join(texts), 3)


def chunk_texts(ids: bytes, lens: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, whether each is null, texts."""
    size = unpack(lens, np.int64)
    end = np.cumsum(size)
    data = release(blob)
    both = unpack(ids, np.int64).reshape(2, -1)
    return both[0], both[1].astype(bool), [data[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]


def chunked(docs: DataFrame, units: Callable[[list[bytes]], int], name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of docs. In a chunk, texts stand by doc_id; a null id sorts last, a null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for rows, texts in text_slices(batches, chunk_bytes):
            ids, null = ids_of(rows)
            order = np.lexsort((null, ids))
            texts = [texts[i] for i in order]
            values = (at, sum(map(len, texts)), units(texts), *chunk_row(ids[order], null[order], texts))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])
            at += 1

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(need.mapInArrow(cut, CHUNK_SCHEMA), name, "uncompressed")


def frame(schema: str, rows: list[dict]) -> pa.Table:
    """Rows as an Arrow table with the columns of a Spark DDL schema; absent values are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields})
