"""Substring dedup by fixed-block anchors.

Of two texts that share a run of WINDOW words, the one has a whole block of BLOCK words inside the
run, at a multiple of BLOCK; the other has the same words at some rolling window.

1. Blocks are the index, rolling windows the probes. Both travel as short hashes to hash buckets,
   which answer which hashes a block of one document shares with a window of another.
2. Around each hit, all WINDOW-word windows that contain it are extended to: 128-bit BLAKE2b digests of their
   words meet in buckets, where the smallest doc_id of each is found.
3. A window that also starts in a document with a smaller doc_id is removed; overlapping ones
   join to maximal repeats.

Short hashes only pick candidates, so their collisions cost time and change nothing; the digests are of the words
themselves, so different windows are not taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import (
    CHUNK_BYTES,
    bounds,
    chunk_row,
    chunk_texts,
    chunked,
    cuts,
    frame,
    pack,
    pack_bits,
    pack_sorted,
    unpack,
    unpack_bits,
    unpack_sorted,
)
from ._hashing import WORD_BASE, Prefix, U, Words, grouped, mix
from ._tables import written

WINDOW, BLOCK = 50, 25
#: Words to a bucket of hashes.
BUCKET_WORDS = 2_500_000

PROBES = "bucket int, chunk long, n long, hashes binary, flags binary"
HITS = "chunk long, bucket int, n long, hits binary"
STEP2 = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, chunk long, bucket int, n long, hashes binary, checks binary, owners binary, nulls binary, ids binary, lens binary, blob binary, windows binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
DONE, SENT, LEFT = 0, 1, 2


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where each distinct hash starts in that order, the distinct hashes."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first]


def probes(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all rolling BLOCK-word windows and their short hashes."""
    at = np.flatnonzero(w.inside(BLOCK))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, mix(Prefix(w.hashes(), WORD_BASE).windows(BLOCK)[at]) >> U(64 - bits)


def _send_probes(bits: int, buckets: int):
    starts = bounds(buckets, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                *_, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
                w = Words(texts)
                at, h = probes(w, bits)
                if not len(at):
                    continue
                order, first, uniq = _groups(h)
                doc = w.doc[at][order]
                block = np.logical_or.reduceat(((at - w.first[w.doc[at]]) % BLOCK == 0)[order], first)
                multi = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                rows = [
                    {"bucket": b, "chunk": r["chunk"], "n": e - s, "hashes": pack_sorted(uniq[s:e]), "flags": pack_bits(np.concatenate((block[s:e], multi[s:e])))}
                    for b, s, e in cuts(uniq, starts)
                ]
                yield from frame(PROBES, rows).to_batches()

    return send


def _find_hits(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    values, index, shared = [], [], []
    for r in rows:
        u, flags = unpack_sorted(r["hashes"]), unpack_bits(r["flags"], 2 * r["n"])
        values.append(u)
        index.append(u[flags[: r["n"]]])
        shared.append(u[flags[r["n"] :]])
    every = np.sort(np.concatenate(values))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *shared]))
    hot = np.intersect1d(shared, np.unique(np.concatenate(index)), assume_unique=True)
    out = []
    for r, u in zip(rows, values, strict=True):
        at = np.searchsorted(u, hot)
        at = at[(at < len(u)) & (u[np.minimum(at, len(u) - 1)] == hot)]
        if len(at):
            bits = np.zeros(len(u), bool)
            bits[at] = True
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "hits": pack_bits(bits)})
    return frame(HITS, out)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _extend(bits: int, buckets: int):
    ranges, starts = bounds(buckets, bits), bounds(buckets)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for r in left.to_pylist():
            ids, null, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
            w = Words(texts)
            hot = np.zeros(len(w.doc) + 1, np.int64)
            if right.num_rows:
                at, h = probes(w, bits)
                uniq = np.unique(h)
                where = {b: (s, e) for b, s, e in cuts(uniq, ranges)}
                flags = np.zeros(len(uniq), bool)
                for x in right.to_pylist():
                    s, e = where[x["bucket"]]
                    flags[s:e] = unpack_bits(x["hits"], x["n"])
                found = uniq[flags]
                k = np.minimum(np.searchsorted(found, h), len(found) - 1)
                hot[at[found[k] == h]] = 1
            seen = np.concatenate(([0], np.cumsum(hot)))
            inside = np.flatnonzero(w.inside(WINDOW))
            cand = inside[seen[inside + WINDOW - BLOCK + 1] > seen[inside]]
            keep = np.zeros(len(texts), bool)
            keep[w.doc[cand]] = True
            for i in np.flatnonzero(~keep).tolist():
                words = w.words[i]
                out.append({"kind": DONE, "doc_id": None if null[i] else int(ids[i]), "n_words": len(words), "n_removed": 0, "kept_sha256": digest(words)})
            if not len(cand):
                continue
            kept = np.flatnonzero(keep)
            flags = np.zeros(len(w.doc), bool)
            flags[cand] = True
            own = [texts[i] for i in kept]
            i, n, b = chunk_row(ids[kept], null[kept], own)
            out.append({"kind": LEFT, "chunk": r["chunk"], "ids": i, "lens": n, "blob": b, "windows": pack_bits(flags[keep[w.doc]])})
            h = w.runs(cand, WINDOW)
            order, first, _ = grouped(h)
            uniq = h[order[first]]
            # texts stand by doc_id, so the first of equal windows has the least
            owner = w.doc[cand][order[first]]
            for b, s, e in cuts(uniq[:, 0], starts):
                out.append({
                    "kind": SENT, "chunk": r["chunk"], "bucket": b, "n": e - s, "hashes": pack_sorted(uniq[s:e, 0]), "checks": pack(uniq[s:e, 1]),
                    "owners": pack(ids[owner[s:e]]), "nulls": pack_bits(null[owner[s:e]]),
                })
        return frame(STEP2, out)

    return extend


def _find_first(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    n = [r["n"] for r in rows]
    h = np.concatenate([unpack_sorted(r["hashes"]) for r in rows])
    check = np.concatenate([unpack(r["checks"], np.uint64) for r in rows])
    owner = np.concatenate([unpack(r["owners"], np.int64) for r in rows])
    null = np.concatenate([unpack_bits(r["nulls"], r["n"]) for r in rows])
    order = np.lexsort((null, owner, check, h))
    new = np.concatenate(([True], (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])))
    least = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(h), bool)
    later[order] = (owner[order] != owner[least]) | (null[order] != null[least])
    parts = np.split(later, np.cumsum(n)[:-1])
    return frame(HITS, [{"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "hits": pack_bits(p)} for r, p in zip(rows, parts, strict=True) if p.any()])


def _remove(buckets: int):
    starts = bounds(buckets)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            ids, null, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
            w = Words(texts)
            at = np.flatnonzero(unpack_bits(r["windows"], len(w.doc)))
            h = w.runs(at, WINDOW)
            order, first, group = grouped(h)
            own = w.doc[at]
            owner = own[order[first]][group]
            later = np.zeros(len(first), bool)
            where = {b: (s, e) for b, s, e in cuts(h[order[first], 0], starts)}
            for x in right.to_pylist():
                s, e = where[x["bucket"]]
                later[s:e] = unpack_bits(x["hits"], x["n"])
            gone = at[later[group] | (ids[own] != ids[owner]) | (null[own] != null[owner])]
            step = np.zeros(len(w.doc) + 1, np.int64)
            step[gone] += 1
            step[gone + WINDOW] -= 1
            keep = np.cumsum(step[:-1]) == 0
            for i, words in enumerate(w.words):
                flags = keep[w.first[i] : w.first[i + 1]]
                left_over = words if flags.all() else [x for x, k in zip(words, flags.tolist(), strict=True) if k]
                out.append({"doc_id": None if null[i] else int(ids[i]), "n_words": len(words), "n_removed": len(words) - len(left_over), "kept_sha256": digest(left_over)})
        return frame(RESULT, out)

    return remove


def remove_repeats(docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each input row.

    Words are runs of anything but U+0020 and U+0009 to U+000D. A null text has none; a null doc_id sorts
    after all others; rows that share a doc_id count as one document, so they remove nothing from each
    other. No rows give no rows; other columns are not read. A window may recur any number of times:
    a chunk sends it once, so a bucket gets it at most once a chunk.
    """
    chunks = chunked(docs, lambda texts: sum(len(t.split()) for t in texts), "repeat-chunks", chunk_bytes)
    words = chunks.agg(F.sum("n_units")).first()[0] or 0
    buckets = max(8, -(-words // BUCKET_WORDS))
    # a short hash hits some unrelated block by chance once in 4096 or less
    bits = min(64, max(24, (words // BLOCK).bit_length() + 12))
    sent = chunks.select("chunk", "ids", "lens", "blob").mapInArrow(_send_probes(bits, buckets), PROBES)
    hits = written(sent.groupBy("bucket").applyInArrow(_find_hits, HITS), "repeat-hits", "uncompressed")
    step = chunks.select("chunk", "ids", "lens", "blob").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(bits, buckets), STEP2)
    step = written(step, "repeat-windows", "uncompressed")
    later = step.filter(F.col("kind") == SENT).select("chunk", "bucket", "n", "hashes", "checks", "owners", "nulls").groupBy("bucket").applyInArrow(_find_first, HITS)
    later = written(later, "repeat-later", "uncompressed")
    left = step.filter(F.col("kind") == LEFT).select("chunk", "ids", "lens", "blob", "windows")
    cut = left.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(_remove(buckets), RESULT)
    return step.filter(F.col("kind") == DONE).select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(cut)
