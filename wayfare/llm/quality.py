"""Quality rules with host-level verdicts.

Every document gets counts and a few rule failures; failures are summed by host, host rates are
shrunk with a beta prior that is fitted to all hosts, and each host's verdict is joined back.
A document goes if it fails the base rules, or if it fails a soft rule and its host is bad, so
a clean document of a bad host stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import SPACE, Words
from ._tables import beside, column, free_prefix, text_slices, written

SLICE_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_CHAR = ~SPACE
_CHAR[0x80:0xC0] = False  # continuation bytes
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def repeated_words(w: Words) -> np.ndarray:
    """By text, the words in three-word windows that occur twice or more in the text."""
    at, run = w.tuples(w.numbers()[0], 3)
    if not len(at):
        return np.zeros(len(w.n_words), np.int64)
    # runs are numbered exactly, and each text has its own
    key = np.unique(run << 32 | w.doc[at], return_inverse=True)[1]
    hit = at[np.bincount(key)[key] > 1]
    covered = np.zeros(len(w.doc), bool)
    for d in range(3):
        covered[hit + d] = True
    return _per_text(covered, w.first)


def count_features(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = Words(texts)
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t.count(b"\n"):
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": w.n_words.astype(np.int64),
        "word_chars": _per_text(_CHAR[w.buf], w.doc_start),
        "n_symbols": _per_text(_SYMBOL[w.buf], w.doc_start),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(w),
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_slices(batches, SLICE_BYTES):
        out = count_features(texts)
        keys = [column(rows, n).combine_chunks() for n in ("doc_id", "source")]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(out[n], pa.int64()) for n in COUNTS)], names=["doc_id", "source", *COUNTS])


def failures(symbol_share: float, dup_lines: int, word_length: tuple[float, float], prefix: str = "") -> tuple[Column, Column]:
    """(base_failed, any rule failed) over the counts."""
    n, chars, symbols, dup, repeat = (F.col(prefix + c) for c in COUNTS)
    base = (n < 50) | (100 * repeat > 50 * n)
    mean = chars / F.greatest(n, F.lit(1))
    soft = (symbols > symbol_share * n) | (dup >= dup_lines) | (mean < word_length[0]) | (mean > word_length[1])
    return base, base | soft


def host_verdicts(rows: DataFrame, bad_rate: float) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, verdict.

    The prior Beta(a, b) has the mean of all documents and, by the method of moments, the spread
    of the hosts' rates; a + b is held in 1 .. 1000. Two aggregations, the second over hosts only.
    """
    hosts = rows.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mu"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v")
    ).withColumn("strength", F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1))).otherwise(1000.0))
    shrunk = (F.col("n_failed") + F.col("mu") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    # one row of moments, so the cross with the hosts adds none
    return hosts.crossJoin(F.broadcast(moments)).select("host", "n_docs", "n_failed", F.round(shrunk, 6).alias("host_rate"), (F.round(shrunk, 6) > bad_rate).alias("host_bad"))


def quality_rules(
    docs: DataFrame,
    *,
    symbol_share: float = 0.1,
    dup_lines: int = 5,
    word_length: tuple[float, float] = (2.0, 15.0),
    bad_rate: float = 0.5,
) -> DataFrame:
    """doc_id, source, the counts, base_failed, failed, host_rate, host_bad, kept; one row per input row.

    A null text counts as empty (and fails, having under 50 words); a null source is a host of its own;
    doc_id may be null or repeated; other columns are not read. No rows give no rows.
    Text is read once and never shuffled; the counts are written (about 70 bytes a row) because
    the host rates and the join back both read them.
    """
    need = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    base, failed = failures(symbol_share, dup_lines, word_length)
    rows = written(need.select("doc_id", "source", "text").mapInArrow(_features, schema).withColumns({"base_failed": base, "failed": failed}), "quality")
    hosts = written(host_verdicts(rows, bad_rate), "hosts")
    # a small host table is broadcast by its file size; a large one is joined by sort-merge, whose hot hosts AQE splits
    joined = rows.join(hosts, rows["source"].eqNullSafe(hosts["host"]), "left")
    return joined.select(
        "doc_id", "source", *COUNTS, "base_failed", "failed", "host_rate", "host_bad",
        (~F.col("base_failed") & ~(F.col("host_bad") & F.col("failed"))).alias("kept"),
    )


def keep_good(docs: DataFrame, *, bad_rate: float = 0.5, symbol_share: float = 0.1, dup_lines: int = 5, word_length: tuple[float, float] = (2.0, 15.0)) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns as they are; texts are not shuffled.

    The hosts' verdicts come from a first pass; the second counts again beside each text.
    """
    rules = {"symbol_share": symbol_share, "dup_lines": dup_lines, "word_length": word_length}
    judged = quality_rules(docs, bad_rate=bad_rate, **rules)
    own = free_prefix(docs.columns)
    bad = written(judged.filter("host_bad").select(F.col("source").alias(f"{own}host")).distinct(), "bad-hosts")

    def counting():
        def counts(texts: list[bytes]) -> list[np.ndarray]:
            found = count_features(texts)
            return [found[c].astype(np.int64) for c in COUNTS]

        return counts

    columns = docs.columns
    counted = beside(docs, ", ".join(f"{own}{c} long" for c in COUNTS), counting, SLICE_BYTES)
    base, failed = failures(**rules, prefix=own)
    sound = counted.filter(~base).withColumn(f"{own}failed", failed)
    return sound.join(bad, sound["source"].cast("string").eqNullSafe(bad[f"{own}host"]) & sound[f"{own}failed"], "left_anti").select(*columns)
