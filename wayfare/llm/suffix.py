"""Suffix-array dedup of bytes: suffixes compared by prefix hashes, sorted by merging.

Sorting every suffix of a corpus would move it many times over. Equal DEPTH-byte windows have the
same smallest GRAM-byte hash at the same place (their anchor), so only windows around anchors
that occur twice can be equal. A run of windows with one anchor is a span.

1. Anchors meet in hash buckets. A span whose bytes are those of an earlier span goes as a whole: equal
   spans are told by 128-bit BLAKE2b digests of their bytes, so that a hot passage is sorted once, not once a copy.
   An anchor that stands in one kind of span only is done. The first of each kind is left over
   where an anchor stands in several kinds: copies that differ nearby.
2. The left-over spans meet by anchor. Their suffixes are sorted by mergesort; two suffixes are
   compared by a binary search for their common extension on prefix polynomial hashes.
   Neighbours are then compared byte by byte: equal ones are told by their bytes alone, and an order that a
   collision of hashes has spoilt is noticed and made anew from the bytes.
   Anchors in very many kinds of span send single windows, dealt by their own hash, instead.
3. Windows that also start earlier are removed; overlapping ones join to maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import bounds, chunk_row, chunk_texts, chunked, cuts, frame, pack, pack_bits, pack_sorted, squeeze, unpack, unpack_bits, unpack_sorted
from ._chunks import release as unsqueeze
from ._hashing import BYTE_BASE, Prefix, U, digests, grouped, mix
from ._tables import written

DEPTH, GRAM = 100, 32
#: Every byte of a chunk takes about a hundred bytes of memory on the way.
CHUNK_BYTES = 3 << 19
SPREAD = DEPTH - GRAM + 1
#: Bytes of text to a bucket.
BUCKET_BYTES = 24_000_000
#: Suffixes that are sorted at once; a bucket is worked off in ranges of its routes.
SORT_WINDOWS = 400_000
#: An anchor in more kinds of span than this is dealt window by window.
MANY_KINDS = 256
ANCHOR_BITS = 48
POSITION = (1 << 30) - 1

ANCHORS = "bucket int, chunk long, n long, grams binary, spans binary, checks binary, docs binary, nulls binary, positions binary"
STATES = "chunk long, bucket int, n long, gone binary, left binary, many binary"
STEP2 = "kind int, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, chunk long, bucket int, n long, routes binary, docs binary, nulls binary, positions binary, counts binary, bytes binary, ids binary, lens binary, blob binary, gone binary, left_at binary, left_n binary, left_to binary"
LATER = "chunk long, bucket int, n long, later binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DONE, SENT, LEFT = 0, 1, 2


class Spans:
    """The anchors of a chunk's windows and the runs of windows that share each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.doc_start = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        self.prefix = Prefix(self.buf.astype(np.uint64) + U(1), BYTE_BASE)
        n = len(self.buf) - DEPTH + 1
        starts = [np.arange(a, b - DEPTH + 1) for a, b in zip(self.doc_start[:-1].tolist(), self.doc_start[1:].tolist(), strict=True) if b - a >= DEPTH]
        if n <= 0 or not starts:
            self.anchor = self.lo = self.hi = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        gram = mix(self.prefix.windows(GRAM))
        at = self._leftmost_least(gram)[: n]
        s = np.concatenate(starts)
        a = at[s]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))))
        end = np.concatenate((new[1:], [len(s)])) - 1
        self.anchor, self.lo, self.hi = a[new], s[new], s[end]
        self.gram = mix(gram[self.anchor] + U(1))  # least hashes crowd near zero; spread them over the buckets

    @staticmethod
    def _leftmost_least(gram: np.ndarray) -> np.ndarray:
        """Where the least of each SPREAD neighbouring hashes stands; the leftmost of equal ones."""
        n = len(gram)
        key = (gram & ~U(POSITION)) | np.arange(n, dtype=np.uint64)
        pad = -n % SPREAD
        rows = np.concatenate((key, np.full(pad, ~U(0)))).reshape(-1, SPREAD)
        del key
        before = np.minimum.accumulate(rows, axis=1).ravel()
        np.minimum.accumulate(rows[:, ::-1], axis=1, out=rows[:, ::-1])
        after = rows.ravel()
        return (np.minimum(after[: n - SPREAD + 1], before[SPREAD - 1 : n]) & U(POSITION)).astype(np.int64)

    def order(self) -> np.ndarray:
        return np.argsort(self.gram >> U(64 - ANCHOR_BITS), kind="stable")

    def kinds(self) -> np.ndarray:
        """Digests of the spans' bytes and of where the anchor stands in them."""
        where = zip(self.lo.tolist(), (self.hi + DEPTH).tolist(), (self.anchor - self.lo).tolist(), strict=True)
        return digests(self.raw[s:e] + bytes((a,)) for s, e, a in where)

    def docs(self) -> np.ndarray:
        return np.searchsorted(self.doc_start, self.lo, "right") - 1


def _send_anchors(buckets: int):
    starts = bounds(buckets, ANCHOR_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, null, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
                x = Spans(texts)
                order = x.order()
                gram, kind, doc = (x.gram >> U(64 - ANCHOR_BITS))[order], x.kinds()[order], x.docs()[order]
                pos = (x.lo[order] - x.doc_start[doc]).astype(np.uint32)
                own, none = ids[doc], null[doc]
                rows = [
                    {"bucket": b, "chunk": r["chunk"], "n": e - s, "grams": pack_sorted(gram[s:e]), "spans": pack(kind[s:e, 0]), "checks": pack(kind[s:e, 1]), "docs": pack(own[s:e]), "nulls": pack_bits(none[s:e]), "positions": pack(pos[s:e])}
                    for b, s, e in cuts(gram, starts)
                ]
                if rows:
                    yield from frame(ANCHORS, rows).to_batches()

    return send


def _starts_of(*keys: np.ndarray) -> np.ndarray:
    """Flags where any of the keys changes."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return new


def _judge_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    gram = np.concatenate([unpack_sorted(r["grams"]) for r in rows])
    kind = np.concatenate([unpack(r["spans"], np.uint64) for r in rows])
    check = np.concatenate([unpack(r["checks"], np.uint64) for r in rows])
    doc = np.concatenate([unpack(r["docs"], np.int64) for r in rows])
    null = np.concatenate([unpack_bits(r["nulls"], r["n"]) for r in rows])
    pos = np.concatenate([unpack(r["positions"], np.uint32) for r in rows])
    order = np.lexsort((pos, null, doc, check, kind, gram))
    g, d, z, p = gram[order], doc[order], null[order], pos[order]
    new_gram, new_kind = _starts_of(g), _starts_of(g, kind[order], check[order])
    kind_no, gram_no = np.cumsum(new_kind) - 1, np.cumsum(new_gram) - 1
    first = np.flatnonzero(new_kind)[kind_no]
    kinds = np.add.reduceat(new_kind.astype(np.int64), np.flatnonzero(new_gram))[gram_no]
    gone = (d != d[first]) | (z != z[first]) | (p != p[first])
    left = ~gone & (kinds > 1)
    flags = np.zeros((3, len(g)), bool)
    flags[:, order] = gone, left, left & (kinds > MANY_KINDS)
    out, at = [], 0
    for r in rows:
        part = flags[:, at : at + r["n"]]
        at += r["n"]
        if part.any():
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], **{n: pack_bits(f) for n, f in zip(("gone", "left", "many"), part, strict=True)}})
    return frame(STATES, out)


def _windows(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All starts lo .. lo + n - 1, run after run."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(lo) else np.zeros(0, np.int64)


def _piece_rows(chunk: int, starts: np.ndarray, route: np.ndarray, doc_id: np.ndarray, null: np.ndarray, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, buf: np.ndarray, plus: int = 0) -> list[dict]:
    return [
        {"kind": SENT, "chunk": chunk, "bucket": b + plus, "n": int(n[s:e].sum()), "routes": pack_sorted(route[s:e]), "docs": pack(doc_id[s:e]), "nulls": pack_bits(null[s:e]), "positions": pack(pos[s:e].astype(np.uint32)), "counts": pack(n[s:e].astype(np.uint32)), "bytes": squeeze(buf[_windows(lo[s:e], n[s:e] + DEPTH - 1)].tobytes())}
        for b, s, e in cuts(route, starts)
    ]


def _resolve(buckets: int):
    ranges, starts = bounds(buckets, ANCHOR_BITS), bounds(buckets)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for r in left.to_pylist():
            ids, null, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
            keep = np.zeros(len(texts), bool)
            if right.num_rows:
                x = Spans(texts)
                order = x.order()
                where = {b: (s, e) for b, s, e in cuts((x.gram >> U(64 - ANCHOR_BITS))[order], ranges)}
                flags = np.zeros((3, len(order)), bool)
                for y in right.to_pylist():
                    s, e = where[y["bucket"]]
                    for i, name in enumerate(("gone", "left", "many")):
                        flags[i, order[s:e]] = unpack_bits(y[name], y["n"])
                gone, lone, many = flags
                doc = x.docs()
                keep[doc[gone | lone]] = True
            for i in np.flatnonzero(~keep).tolist():
                t = texts[i]
                out.append({"kind": DONE, "doc_id": None if null[i] else int(ids[i]), "n_bytes": len(t), "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(t).hexdigest()})
            if not keep.any():
                continue
            kept = np.flatnonzero(keep)
            i, n, b = chunk_row(ids[kept], null[kept], [texts[k] for k in kept])
            new_start = np.zeros(len(texts) + 1, np.int64)
            np.cumsum(np.where(keep, np.diff(x.doc_start), 0), out=new_start[1:])
            moved = new_start[doc] - x.doc_start[doc]  # from the chunk's to the left-over texts' positions
            covered = np.zeros(int(new_start[-1]) + 1, np.int64)
            covered[x.lo[gone] + moved[gone]] += 1
            np.add.at(covered, x.hi[gone] + moved[gone] + DEPTH, -1)
            own, none = ids[doc], null[doc]
            a = np.flatnonzero(lone & ~many)
            a = a[np.argsort(x.gram[a], kind="stable")]
            size = x.hi - x.lo + 1
            out += _piece_rows(r["chunk"], starts, x.gram[a], own[a], none[a], x.lo[a] - x.doc_start[doc[a]], x.lo[a], size[a], x.buf)
            m = np.flatnonzero(many)
            w, wd = _windows(x.lo[m], size[m]), np.repeat(doc[m], size[m])
            h = digests(x.raw[k : k + DEPTH] for k in w.tolist())
            by, start, back = grouped(h)
            first = by[start]  # texts stand by doc_id, so the first is the least
            route, wp = h[first, 0], w - x.doc_start[wd]
            again = (ids[wd] != ids[wd[first]][back]) | (null[wd] != null[wd[first]][back]) | (wp != wp[first][back])
            np.add.at(covered, (w + np.repeat(moved[m], size[m]))[again], 1)
            np.add.at(covered, (w + np.repeat(moved[m], size[m]))[again] + DEPTH, -1)
            out += _piece_rows(r["chunk"], starts, route, ids[wd[first]], null[wd[first]], wp[first], w[first], np.ones(len(first), np.int64), x.buf, buckets)
            out.append({
                "kind": LEFT, "chunk": r["chunk"], "ids": i, "lens": n, "blob": b, "gone": pack_bits(np.cumsum(covered)[:-1] > 0),
                "left_at": pack(np.concatenate((x.lo[a] + moved[a], w[first] + np.repeat(moved[m], size[m])[first]))), "left_n": pack(np.concatenate((size[a], np.ones(len(first), np.int64)))),
                "left_to": pack(np.concatenate((np.searchsorted(starts, x.gram[a], "right"), np.searchsorted(starts, route, "right") + buckets))),
            })
        return frame(STEP2, out)

    return resolve


class Suffixes:
    """Suffixes of one text, compared over DEPTH bytes by hash."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> None:
        self.text, self.at, self.rank = text, starts, rank
        p = Prefix(text.astype(np.uint64) + U(1), BYTE_BASE)
        self.c, self.inv = p.c, p.inv
        self.whole = self._hash(starts, DEPTH)

    def _hash(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.c[at + length] - self.c[at]) * self.inv[at]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, at most DEPTH - 1: a binary search on hashes."""
        a, b = self.at[i], self.at[j]
        low = np.zeros(len(a), np.int64)
        step = 64
        while step:
            up = low + step
            ok = up < DEPTH
            up = np.minimum(up, DEPTH - 1)
            ok &= self._hash(a, up) == self._hash(b, up)
            low = np.where(ok, up, low)
            step //= 2
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones stand by rank."""
        out = self.rank[i] < self.rank[j]
        differ = np.flatnonzero(self.whole[i] != self.whole[j])
        if len(differ):
            i, j = i[differ], j[differ]
            n = self.common(i, j)
            out[differ] = self.text[self.at[i] + n] < self.text[self.at[j] + n]
        return out

    def sort(self) -> np.ndarray:
        """The suffixes in order.

        Eight leading bytes twice over part them into groups; each group is merged from runs of
        one, two, four, ... All groups are merged at once: a suffix finds its place among the
        other run's suffixes by binary search.
        """
        lead = np.zeros((2, len(self.at)), np.uint64)
        for k in range(16):
            lead[k // 8] = (lead[k // 8] << U(8)) | self.text[self.at + k].astype(np.uint64)
        order = np.lexsort((lead[1], lead[0]))
        new = _starts_of(lead[0][order], lead[1][order])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(order)])))
        busy = np.flatnonzero(size > 1)
        width = 1
        while len(busy):
            begin, count = first[busy], size[busy]
            slot = _windows(begin, count)
            local, base, total = slot - np.repeat(begin, count), np.repeat(begin, count), np.repeat(count, count)
            run = local // width
            other = (run ^ 1) * width
            some = other < total
            slot, local, base, total, run, other = slot[some], local[some], base[some], total[some], run[some], other[some]
            length = np.minimum(other + width, total) - other
            me = order[slot]
            low, high = np.zeros(len(slot), np.int64), length.copy()
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                less = self.before(order[base[live] + other[live] + mid], me[live])
                low[live] = np.where(less, mid + 1, low[live])
                high[live] = np.where(less, high[live], mid)
            merged = order.copy()
            merged[base + (run // 2) * 2 * width + (local - run * width) + low] = me
            order = merged
            width *= 2
            busy = busy[size[busy] > width]
        return order

    def verified(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, made anew from the bytes if any neighbours stand wrongly, and whether each has the DEPTH bytes of the one before it."""
        for again in (False, True):
            same = np.zeros(len(order), bool)
            right = True
            for part in np.array_split(np.arange(1, len(order)), max(1, len(order) // 100_000)):
                k = np.arange(DEPTH)
                a, b = (self.text[self.at[order[x]][:, None] + k] for x in (part - 1, part))
                differ = a != b
                at, row = differ.argmax(axis=1), np.arange(len(part))
                same[part] = ~differ[row, at]
                right &= bool((same[part] | (a[row, at] < b[row, at])).all())
            if right:
                return order, same
            assert not again
            windows = np.ascontiguousarray(self.text[self.at[:, None] + np.arange(DEPTH)]).view(f"V{DEPTH}").ravel()
            order = np.lexsort((self.rank, np.unique(windows, return_inverse=True)[1].ravel()))
        raise AssertionError


def _later(text: np.ndarray, at: np.ndarray, doc: np.ndarray, null: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether each window's bytes also start earlier, by the sorted suffixes."""
    rank = np.zeros(len(at), np.int64)
    rank[np.lexsort((pos, null, doc))] = np.arange(len(at))
    s = Suffixes(text, at, rank)
    order, same = s.verified(s.sort())
    # the earliest of equal windows, wherever it stands among them
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(rank[order], np.flatnonzero(~same))[run]
    head = np.argsort(rank)[least]
    out = np.zeros(len(at), bool)
    out[order] = (doc[order] != doc[head]) | (null[order] != null[head]) | (pos[order] != pos[head])
    return out


def _sort_spans(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    route = np.concatenate([unpack_sorted(r["routes"]) for r in rows])
    doc = np.concatenate([unpack(r["docs"], np.int64) for r in rows])
    null = np.concatenate([unpack_bits(r["nulls"], len(unpack(r["docs"], np.int64))) for r in rows])
    pos = np.concatenate([unpack(r["positions"], np.uint32) for r in rows]).astype(np.int64)
    n = np.concatenate([unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    text = np.frombuffer(b"".join(unsqueeze(r["bytes"]) for r in rows), np.uint8)
    size = n + DEPTH - 1
    begin = np.cumsum(size) - size
    window = np.cumsum(n) - n  # where each piece's windows are in the answer
    later = np.zeros(int(n.sum()), bool)
    order = np.argsort(route, kind="stable")
    done = np.cumsum(n[order])
    new = np.flatnonzero(_starts_of(route[order]))  # pieces of one route are sorted together
    first = 0
    while first < len(order):
        before = done[first - 1] if first else 0
        k = np.searchsorted(new, np.searchsorted(done, before + SORT_WINDOWS, "right"), "right") - 1
        end = int(new[k]) if new[k] > first else int(new[k + 1]) if k + 1 < len(new) else len(order)
        if done[-1] - before <= SORT_WINDOWS:
            end = len(order)
        p = order[first:end]
        own = size[p]
        part = text[_windows(begin[p], own)]
        later[_windows(window[p], n[p])] = _later(part, _windows(np.cumsum(own) - own, n[p]), np.repeat(doc[p], n[p]), np.repeat(null[p], n[p]), _windows(pos[p], n[p]))
        first = end
    out, start = [], 0
    for r in rows:
        part = later[start : start + r["n"]]
        start += r["n"]
        if part.any():
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "later": pack_bits(part)})
    return frame(LATER, out)


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    for r in left.to_pylist():
        ids, null, texts = chunk_texts(r["ids"], r["lens"], r["blob"])
        total = sum(map(len, texts))
        step = np.zeros(total + 1, np.int64)
        at, n, bucket = unpack(r["left_at"], np.int64), unpack(r["left_n"], np.int64), unpack(r["left_to"], np.int64)
        for x in right.to_pylist():
            mine = bucket == x["bucket"]
            w = _windows(at[mine], n[mine])[unpack_bits(x["later"], x["n"])]
            np.add.at(step, w, 1)
            np.add.at(step, w + DEPTH, -1)
        gone = (np.cumsum(step)[:-1] > 0) | unpack_bits(r["gone"], total)
        end = 0
        for i, t in enumerate(texts):
            begin, end = end, end + len(t)
            g = gone[begin:end]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0]))
            kept = np.frombuffer(t, np.uint8)[~g].tobytes() if spans else t
            out.append({"doc_id": None if null[i] else int(ids[i]), "n_bytes": len(t), "n_removed": len(t) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return frame(RESULT, out)


def remove_repeated_bytes(docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each input row.

    A null text is empty; a null doc_id sorts after all others; rows that share a doc_id count as one
    document, in which equal starts are not earlier. No rows give no rows; other columns are not read.
    """
    chunks = chunked(docs, lambda texts: len(texts), "suffix-chunks", chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    need = chunks.select("chunk", "ids", "lens", "blob")
    sent = need.mapInArrow(_send_anchors(buckets), ANCHORS)
    states = written(sent.groupBy("bucket").applyInArrow(_judge_anchors, STATES), "suffix-states", "uncompressed")
    step = written(need.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(_resolve(buckets), STEP2), "suffix-spans", "uncompressed")
    pieces = step.filter(F.col("kind") == SENT).select("chunk", "bucket", "n", "routes", "docs", "nulls", "positions", "counts", "bytes")
    later = written(pieces.groupBy("bucket").applyInArrow(_sort_spans, LATER), "suffix-later", "uncompressed")
    left = step.filter(F.col("kind") == LEFT).select("chunk", "ids", "lens", "blob", "gone", "left_at", "left_n", "left_to")
    done = left.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(_remove, RESULT)
    return step.filter(F.col("kind") == DONE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(done)
