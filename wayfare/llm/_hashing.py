"""Word numbers, digests and window hashes over many texts at once.

Equality is settled by exact word numbers within a slice or by 128-bit BLAKE2b digests between slices. The
polynomial hashes (numpy, 64-bit wrap-around) only choose candidates and orders that are checked afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b
from itertools import chain

import numpy as np

U = np.uint64
#: The white space that parts words: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

BYTE_BASE, WORD_BASE = 0xD1342543DE82EF95, 0x9E6C63D0876A9A47
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, n + n // 4 + 2)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, U(b), np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a bijection)."""
    t = x >> U(30)
    x = np.bitwise_xor(x, t, out=t)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Prefix polynomial hashes of a sequence: span(s, e) hashes values[s:e] by content alone."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        pw, self.inv = powers(base, n)
        self.c = np.zeros(n + 1, np.uint64)
        np.multiply(values, pw[:n], out=self.c[1:])
        np.cumsum(self.c[1:], out=self.c[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.c[e] - self.c[s]) * self.inv[s]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of every run of k values, by start."""
        n = len(self.c) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        out = self.c[k:] - self.c[: n - k + 1]
        out *= self.inv[: n - k + 1]
        return out


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """A row of two 64-bit numbers for each part, the same only for the same bytes (BLAKE2b)."""
    return np.frombuffer(b"".join(blake2b(p, digest_size=16).digest() for p in parts), np.uint64).reshape(-1, 2)


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of digests: their order (equal ones by place), where each distinct one starts in it, and the number of each one's group."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


class Numbers(dict):
    """Numbers its keys from 0 as they come."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Words:
    """The words of many texts, in one buffer with a space after each text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.doc_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=self.doc_start[1:])
        #: bytes.split parts at exactly the white space of SPACE
        self.words = [t.split() for t in texts]
        self.n_words = np.fromiter(map(len, self.words), np.int64, len(texts))
        #: doc i has the words first[i] .. first[i + 1]
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.n_words, out=self.first[1:])
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)

    def numbers(self) -> tuple[np.ndarray, Numbers]:
        """An exact number for each word, from 0, and the numbering."""
        table = Numbers()
        return np.fromiter(map(table.__getitem__, chain.from_iterable(self.words)), np.int64, int(self.first[-1])), table

    def hashes(self) -> np.ndarray:
        """64 bits of each word's digest."""
        number, table = self.numbers()
        return digests(table)[:, 0][number] if table else np.zeros(0, np.uint64)

    def runs(self, at: np.ndarray, k: int) -> np.ndarray:
        """Digests of the k words from each place on, joined by one space; the runs lie within a text."""
        every = list(chain.from_iterable(self.words))
        edge = np.zeros(len(every) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1, out=edge[1:])
        joined = b" ".join(every)
        return digests(joined[s:e] for s, e in zip(edge[at].tolist(), (edge[at + k] - 1).tolist(), strict=True))

    def inside(self, k: int) -> np.ndarray:
        """For each word, whether k words from it on lie in one text."""
        n = len(self.doc)
        return self.doc[k - 1 :] == self.doc[: n - k + 1] if n >= k else np.zeros(0, bool)

    def tuples(self, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of k words within a text, and an exact number for each run's words."""
        at = np.flatnonzero(self.inside(k))
        run = number[at]
        for i in range(1, k):
            # two numbers below 2**32 make one; equal pairs get one number again
            run = np.unique(run << 32 | number[at + i], return_inverse=True)[1]
        return at, run
