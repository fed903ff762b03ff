"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A signature is cut into TREES labels of DEPTH hashes, the leaves of TREES prefix tries; the texts below one
node share a prefix. Each text starts at its full labels and shortens its prefixes, one tree at a time and
first where the next node is least crowded, until a neighbour at the threshold shares a node with it with the
target probability: prefixes stay long in crowded tries and get short in sparse ones.

Texts that share such a node are candidates; candidates that hang together form a block, and all pairs
inside a block are verified on their whole shingle sets, numbered exactly by their words, so a block finds
links that the forest alone would miss and no collision makes one.

Equal word sequences (128-bit BLAKE2b digests) are one class before all this; pairs are between classes. Blocks over
BLOCK classes are cut, and each pair of parts is verified by itself; only counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._hashing import WORD_BASE, Numbers, Prefix, U, Words, digests, mix
from ._tables import salted_join, text_slices, written

SLICE_BYTES = 1 << 20
SHINGLE = 5
#: Trees, and the longest and the shortest prefix that is looked at.
TREES, DEPTH, LEAST = 16, 6, 3
BLOCK = 1500
#: Columns of the shingle matrix that are held at once.
STRIP = 4096

SIGNED = "doc_id long, text string, h1 long, h2 long, sig binary"
VERIFIED = "row long, links long, root long"


class Shingles:
    """The shingles of many texts. A text of one to four words is one shingle."""

    def __init__(self, texts: list[bytes]) -> None:
        self.w = w = Words(texts)
        self.long = w.n_words >= SHINGLE
        self.count = np.where(self.long, w.n_words - SHINGLE + 1, np.minimum(w.n_words, 1))
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count

    def same(self) -> np.ndarray:
        """Digests of the word sequences."""
        return digests(b" ".join(words) for words in self.w.words)

    def _laid(self, of_long: np.ndarray, of_short: np.ndarray) -> np.ndarray:
        values = np.zeros(int(self.count.sum()), of_long.dtype)
        values[np.repeat(self.long, self.count)] = of_long
        values[self.start[~self.long & (self.count > 0)]] = of_short
        return values

    def hashes(self) -> np.ndarray:
        h = self.w.hashes()
        short = digests(b" ".join(x) for x in self.w.words if 0 < len(x) < SHINGLE)[:, 0]
        return self._laid(mix(Prefix(h, WORD_BASE).windows(SHINGLE)[np.flatnonzero(self.w.inside(SHINGLE))]), short)

    def sets(self) -> list[np.ndarray]:
        """The shingles of each text by an exact number: equal for the same words only."""
        _, run = self.w.tuples(self.w.numbers()[0], SHINGLE)
        table = Numbers()
        short = np.array([table[b" ".join(x)] for x in self.w.words if 0 < len(x) < SHINGLE], np.int64) + len(run)
        values = self._laid(run, short)
        return [np.unique(values[s:e]) for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def signatures(self) -> np.ndarray:
        """TREES * DEPTH smallest hashes of each text that has shingles."""
        some = self.count > 0
        out = np.zeros((len(self.count), TREES * DEPTH), np.uint32)
        if some.any():
            start, values = self.start[some], self.hashes()
            for j, a in enumerate(mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | U(1)):
                out[some, j] = np.minimum.reduceat(values * a, start) >> U(32)
        return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_slices(batches, SLICE_BYTES):
        s = Shingles(texts)
        sig, same = s.signatures(), s.same().view(np.int64)
        at = 0
        for r in rows:
            e = at + r.num_rows
            short = pa.array([x.tobytes() if n else None for x, n in zip(sig[at:e], s.count[at:e].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(r.column(r.schema.get_field_index(n)) for n in ("doc_id", "text")), pa.array(same[at:e, 0]), pa.array(same[at:e, 1]), short], names=["doc_id", "text", "h1", "h2", "sig"])
            at = e


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, least: Fraction) -> np.ndarray:
    """Which sets of a and b (or of a alone) have a similarity of `least` or more."""
    every = a + (b or [])
    n = np.fromiter(map(len, every), np.int64, len(every))
    values = np.concatenate(every)
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    number = np.cumsum(new) - 1
    twice = np.bincount(number) > 1
    col = np.empty(len(s), np.int64)
    col[order] = np.where(twice[number], (np.cumsum(twice) - 1)[number], -1)
    row = np.repeat(np.arange(len(every)), n)
    row, col = row[col >= 0], col[col >= 0]
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    m = len(a)
    both = np.zeros((m, len(b) if b else m), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, STRIP):
        lo, hi = np.searchsorted(col, (first, first + STRIP))
        x = np.zeros((len(every), min(STRIP, int(col[-1]) + 1 - first)), np.float32)
        x[row[lo:hi], col[lo:hi] - first] = 1
        both += x[:m] @ (x[m:] if b else x).T
    p, q = least.numerator, least.denominator
    size = n[:m, None] + (n[None, m:] if b else n[None, :m])
    return both.astype(np.int64) * (p + q) >= p * size


def _roots(link: np.ndarray) -> np.ndarray:
    """The least index that each row hangs together with, in a square symmetric relation."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(least: Fraction):
    def verify(table: pa.Table) -> pa.Table:
        t = table.sort_by([("comp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("row", "ascending")])
        get = lambda name: t.column(name).to_numpy()
        comp, i, j, row, own, n = (get(x) for x in ("comp", "i", "j", "row", "own", "n"))
        texts = t.column("text").cast(pa.binary())
        out = []
        new = np.flatnonzero(np.concatenate(([True], (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))).tolist()
        for s, e in zip(new, [*new[1:], len(comp)], strict=True):
            sets = Shingles([x.as_py() for x in texts[s:e]]).sets()
            r, w, mine = row[s:e], n[s:e], own[s:e]
            if i[s] == j[s]:
                link = _links(sets, None, least)
                np.fill_diagonal(link, False)
                root = r[_roots(link)]
                count = link @ w
                out += [(int(a), int(b), int(c)) for a, b, c in zip(r, count, root, strict=True)]
                continue
            left, right = np.flatnonzero(mine == i[s]), np.flatnonzero(mine == j[s])
            if not len(left) or not len(right):
                continue
            link = _links([sets[k] for k in left], [sets[k] for k in right], least)
            square = np.zeros((len(r), len(r)), bool)
            square[np.ix_(left, right)] = link
            square[np.ix_(right, left)] = link.T
            root = r[_roots(square)]
            count = square @ w
            out += [(int(a), int(b), int(c)) for a, b, c in zip(r, count, root, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("row", "links", "root"), cols, strict=True)})

    return verify


def _shorten(threshold: float, recall: float):
    """For each text, the node at which it looks in each tree.

    A tree's prefix is first as long as its labels. Prefixes are shortened, each time in the tree whose next node brings
    the fewest further texts, until a neighbour at the threshold shares one of the nodes with the target probability.
    """
    hit = np.log1p(-(threshold ** np.arange(LEAST, DEPTH + 1, dtype=np.float64)))  # log of the chance to miss at each depth

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            nodes = batch.column(1)
            lens = np.diff(nodes.offsets.to_numpy())
            flat = nodes.flatten()
            tree, depth, size, key = (flat.field(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(n), lens)
            sizes = np.ones((n, TREES, DEPTH - LEAST + 1), np.int64)
            keys = np.zeros(sizes.shape, np.int64)
            sizes[row, tree, depth - LEAST] = size
            keys[row, tree, depth - LEAST] = key
            at = np.full((n, TREES), DEPTH - LEAST)
            every, trees = np.arange(n)[:, None], np.arange(TREES)[None, :]
            while True:
                busy = np.flatnonzero((hit[at].sum(axis=1) > np.log1p(-recall)) & (at > 0).any(axis=1))
                if not len(busy):
                    break
                here, below = sizes[every[busy], trees, at[busy]], sizes[every[busy], trees, np.maximum(at[busy] - 1, 0)]
                more = np.where(at[busy] > 0, below - here, np.iinfo(np.int64).max)
                at[busy, more.argmin(axis=1)] -= 1
            found = keys[every, trees, at][sizes[every, trees, at] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], names=["key"])

    return shorten


def forest_edges(labels: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b): each text below a node at which some text looks, and the least text below it.

    labels: row, sig. The tries are kept as their nodes: a hash of tree, depth and prefix, with its size and least row.
    """
    prefix = lambda d: F.xxhash64("t", F.lit(d), F.substring("label", 1, 4 * d))
    tree = F.array(*(F.struct(F.lit(t).alias("t"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("label")) for t in range(TREES)))
    leaves = labels.select("row", F.inline(tree)).withColumn("key", prefix(LEAST))
    leaves = written(leaves, "near-leaves")
    size_of = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("lead")).filter("c > 1")
    # a text that is alone at the shortest prefix is alone below it too
    live = salted_join(leaves, size_of(leaves), ["key"], ["row"])
    depths = F.array(*(F.struct(F.lit(d).alias("d"), prefix(d).alias("key")) for d in range(LEAST, DEPTH + 1)))
    below = written(live.select("row", "t", F.inline(depths)), "near-below")
    sizes = written(size_of(below), "near-sizes")
    seen = salted_join(below, sizes, ["key"], ["row"]).groupBy("row").agg(F.collect_list(F.struct("t", "d", "c", "key")).alias("nodes"))
    looked = written(seen.mapInArrow(_shorten(threshold, recall), "key long").distinct(), "near-looked")
    nodes = sizes.join(looked, "key", "left_semi")
    return salted_join(below.select("row", "key"), nodes, ["key"], ["row"]).filter("row <> lead").select(F.col("row").alias("a"), F.col("lead").alias("b"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_id, n_links; one row per input row.

    class_id is the least doc_id of all documents that hang together by links; copy_id the least with the same
    words; n_links the number of other documents (rows) with a similarity of at least `threshold`, copies included.
    Similarity is the Jaccard index of sets of five-word shingles; a text of one to four words is one
    shingle. Texts without words, null ones too, are copies of each other and like nothing else. A null doc_id
    sorts last and stays null; rows that share a doc_id are rows of their own. No rows give no rows.
    """
    least = Fraction(str(threshold))
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(need.mapInArrow(_sign, SIGNED).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    # a null doc_id is no least one unless all are null
    classes = written(
        signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "near-classes"
    )
    labels = signed.filter("sig is not null").select("row", "sig").join(classes.select("row"), "row")
    blocks = written(components(forest_edges(labels, threshold, recall)), "near-blocks")
    sizes = blocks.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = (
        salted_join(blocks, sizes, ["root"], ["node"])
        .withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .select(F.col("node").alias("row"), F.col("root").alias("comp"), "own", "parts")
        .join(classes.select("row", "n"), "row")
    )
    members = written(members, "near-members")
    # text moves once by row, and a second time by block for the members only; merged at every size,
    # since members grow with the corpus
    texts = signed.select("row", "text").join(members.hint("merge"), "row")
    # each part meets each part of its block, itself included; most blocks have one part
    pairs = texts.select("comp", "own", "row", "n", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "n", "text"
    )
    many = max(8, -(-members.count() // 500))
    verified = written(pairs.withColumn("g", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(many))).groupBy("g").applyInArrow(_verify(least), VERIFIED), "near-links")
    roots = components(verified.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    grouped = roots.withColumnRenamed("node", "row").join(classes.select("row", "copy_id"), "row")
    names = grouped.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    linked = grouped.join(names, "root").select("row", "class_id").join(verified.groupBy("row").agg(F.sum("links").alias("links")), "row")
    of_class = classes.join(linked, "row", "left").select("h1", "h2", "copy_id", "n", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    of_class = written(of_class, "near-of-class")
    return signed.select("doc_id", "h1", "h2").join(of_class, ["h1", "h2"]).select(
        "doc_id", "class_id", "copy_id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they are, whose doc_id is their class_id; null ids stay."""
    found = near_duplicates(docs, **options)
    gone = written(found.filter("doc_id <> class_id").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti")
