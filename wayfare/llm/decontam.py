"""Benchmark decontamination by spaced seeds.

Each mask picks some positions of a short token window and ignores the others. The picked
tokens' hashes of every benchmark window are the index; every window of every document is joined
with it. A hit fixes a diagonal (document position minus item position); along it the item and
the document are compared token by token, and the longest stretch with four fifths of matches is the overlap.

The three masks together miss nothing: whatever tokens are substituted, a stretch of 13 matches or more of which four fifths
match holds a window that one of them fits (the tests prove it for every length by dynamic programming).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import Numbers, U, mix
from ._tables import NO_ID, beside, free_prefix, id_array, ids_of, text_slices, written

SLICE_BYTES = 1 << 20
#: 1: the token counts; 0: any token may stand there. Every mask has six ones.
MASKS = ("1101111", "1100010111", "110010001011")
#: A block of the benchmark that is held at once; more items are worked off in further blocks.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 20
#: Hits, and tokens of their diagonals, that are looked at at once.
HITS, TOKENS = 1 << 20, 1 << 22

#: Lower-cased runs of letters and digits; any character beyond ASCII counts as a letter.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


class Tokens:
    """The tokens of many texts by number. A vocabulary that is given stays as it is; what it lacks gets -1."""

    def __init__(self, texts: list[bytes], vocabulary: dict[bytes, int] | None = None) -> None:
        found = [TOKEN.findall(t.decode("utf-8", "replace").lower().encode()) for t in texts]
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=self.first[1:])
        self.vocabulary = Numbers() if vocabulary is None else vocabulary
        of = self.vocabulary.__getitem__ if vocabulary is None else lambda t: vocabulary.get(t, -1)
        self.number = np.fromiter(map(of, chain.from_iterable(found)), np.int64, int(self.first[-1]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def seed_hashes(number: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every window start."""
    n = len(number) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mix(number.astype(np.uint64) + U(1))
    out = np.zeros(n, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * U(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> U(29)
    return mix(out + U(len(mask)))


@dataclass
class Index:
    """A block of the benchmark: its tokens and, by mask, the sorted seed hashes with their positions."""

    ids: np.ndarray
    null: np.ndarray
    tokens: Tokens
    seeds: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]


def build_index(ids: np.ndarray, null: np.ndarray, texts: list[bytes]) -> Index:
    """Items of fewer tokens than the longest mask, all of which must match, are probed by a mask of their own whole length too."""
    t = Tokens(texts)
    n = np.diff(t.first)
    longest = max(map(len, MASKS))
    short = sorted({int(x) for x in n if 0 < x < longest})
    seeds = []
    for mask, only in (*((m, None) for m in MASKS), *(("1" * x, x) for x in short)):
        h = seed_hashes(t.number, mask)
        at = np.flatnonzero(t.doc[len(mask) - 1 :] == t.doc[: len(h)]) if len(h) else np.zeros(0, np.int64)
        if only:
            at = at[n[t.doc[at]] == only]
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(h[at] >> U(64 - TABLE_BITS)).astype(np.int64)] = True
        if len(at):
            seeds.append((mask, h[at], at, table))
    return Index(ids, null, t, seeds)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the longest stretch of which at least four fifths match, without mismatches at its ends.

    No other such stretch has more matches: one that has m, and room, grows to 5 * m // 4 tokens, of which at least m
    must match. Ties: the first stretch.
    """
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    # the last end at which the score is not below a start's: the greatest score from there on never rises
    most = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-most, -score, "right") - 1
    start = int(np.argmax(end - np.arange(len(score))))
    at = np.flatnonzero(same[start : end[start]])
    return (start + int(at[0]), start + int(at[-1]) + 1, len(at)) if len(at) else (start, start, 0)


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes come to at most `most`, or of one entry."""
    total = np.cumsum(size)
    s = 0
    while s < len(size):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def _diagonals(index: Index, docs: Tokens) -> Iterator[np.ndarray]:
    """Rows of document, item and shift at which a seed hits; some come again."""
    item = index.tokens
    for mask, keys, at, table in index.seeds:
        h = seed_hashes(docs.number, mask)
        maybe = np.flatnonzero(table[(h >> U(64 - TABLE_BITS)).astype(np.int64)])
        maybe = maybe[docs.doc[maybe] == docs.doc[maybe + len(mask) - 1]]
        lo = np.searchsorted(keys, h[maybe], "left")
        count = np.searchsorted(keys, h[maybe], "right") - lo
        hit = count > 0
        maybe, lo, count = maybe[hit], lo[hit], count[hit]
        # a seed that many items share is worked off in parts
        for s, e in _runs(count, HITS):
            c = count[s:e]
            where = np.repeat(maybe[s:e], c)
            k = at[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[s:e], c)]
            yield np.unique(np.stack([docs.doc[where], item.doc[k], where - (k - item.first[item.doc[k]])], axis=1), axis=0)


def find_overlaps(index: Index, docs: Tokens, min_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document row, item row, first document token, tokens, matches, item tokens): the best per pair, at equal matches that of the least shift."""
    item = index.tokens
    best: dict[tuple[int, int], tuple] = {}
    for found in _diagonals(index, docs):
        d, i, shift = found.T
        a, b = item.first[i], item.first[i + 1]
        lo, hi = np.maximum(shift, docs.first[d]), np.minimum(shift + (b - a), docs.first[d + 1])
        need = np.minimum(min_tokens, b - a)
        for s, e in _runs(hi - lo, TOKENS):
            n = (hi - lo)[s:e]
            start = np.cumsum(n) - n
            at = np.repeat(lo[s:e] - start, n) + np.arange(n.sum())
            same = docs.number[at] == item.number[at + np.repeat((a - shift)[s:e], n)]
            enough = np.flatnonzero(np.add.reduceat(same, start, dtype=np.int64) >= need[s:e])
            for k in enough.tolist():
                x = s + k
                first, last, matches = best_stretch(same[start[k] : start[k] + n[k]])
                pair = int(d[x]), int(i[x])
                if matches >= need[x] and (pair not in best or (-matches, shift[x]) < best[pair][0]):
                    best[pair] = (-matches, shift[x]), (*pair, int(lo[x] + first - docs.first[pair[0]]), last - first, matches, int(b[x] - a[x]))
    return [row for _, row in sorted(best.values(), key=lambda x: x[1])]


def bench_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[tuple[np.ndarray, np.ndarray, list[bytes]], bool]]:
    """The benchmark in blocks of a checked size, each with whether another one follows; the driver holds two at most."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        whole = lambda: (np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), texts)
        for r in rows.orderBy("item_id", "text").toLocalIterator():
            ids.append(r.item_id)
            texts.append(r.text.encode())
            size += len(texts[-1]) + 64
            if size >= block_bytes:
                yield whole()
                ids, texts, size = [], [], 0
        if ids:
            yield whole()

    before = None
    for block in blocks():
        if before is not None:
            yield before, True
        before = block
    if before is not None:
        yield before, False


OVERLAP_SCHEMA = "doc_id long, item_id long, start_token long, n_tokens long, n_matched long, item_tokens long"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, min_tokens: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and item whose overlap has min_tokens matching tokens or more
    (all tokens of a shorter item), at least four fifths of the stretch matching: every such pair if min_tokens is 13 or
    more, since the masks miss none; for each the stretch with most matches.

    The search is one pass over the documents without a shuffle for each benchmark block of
    block_bytes; one block is what an executor holds, and all passes but the last are written. Null texts have no tokens; items without
    tokens match nothing; repeated rows are reported each; no rows on either side give no rows.
    doc_id or item_id may be null. Other columns are not read.
    """
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for (ids, null, texts), more in bench_blocks(benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], ids=ids, null=null, texts=texts) -> Iterator[pa.RecordBatch]:
            index = build_index(ids, null, texts)
            for rows, batch in text_slices(batches, SLICE_BYTES):
                found = find_overlaps(index, Tokens(batch, index.tokens.vocabulary), min_tokens)
                if found:
                    own, none = ids_of(rows)
                    d, i, *rest = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([id_array(own[d], none[d]), id_array(ids[i], null[i]), *map(pa.array, rest)], names=[x.split()[0] for x in OVERLAP_SCHEMA.split(", ")])

        part = need.mapInArrow(search, OVERLAP_SCHEMA)
        part = written(part, "overlaps") if more else part
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], OVERLAP_SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_tokens: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, without any overlap that find_contamination reports."""
    out, flag = docs, f"{free_prefix(docs.columns)}clean"
    for (ids, null, texts), more in bench_blocks(benchmark, block_bytes):

        def judge(ids=ids, null=null, texts=texts):
            index = build_index(ids, null, texts)

            def clean(batch: list[bytes]) -> list[np.ndarray]:
                flags = np.ones(len(batch), bool)
                flags[[d for d, *_ in find_overlaps(index, Tokens(batch, index.tokens.vocabulary), min_tokens)]] = False  # an empty list changes nothing
                return [flags]

            return clean

        out = beside(out, f"{flag} boolean", judge, SLICE_BYTES).filter(flag).drop(flag)
        out = written(out, "clean") if more else out
    return out
