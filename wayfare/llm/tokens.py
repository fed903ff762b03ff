"""Token counts under a unigram tokenizer, without the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; Viterbi carries the best score
and its number of pieces. The tokenizer's rules: a piece replaces the best one so far at its end
only if strictly better, candidates come by start; a character that is no piece by itself is unknown, scores
ten below the least piece, and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import id_array, ids_of, text_slices

SLICE_BYTES = 1 << 20
#: Word counts kept by a task; then it starts anew.
CACHE_WORDS = 300_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0
TOKENIZER_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = TOKENIZER_FILE) -> list[tuple[str, float]]:
    """The pieces of a public vocabulary with unigram scores.

    The file's pieces stand in the order of their merges; their score is the logarithm of a
    Zipf law over that rank. Control and byte pieces are no matches.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [(p, -math.log(rank + 10.0)) for rank, p in enumerate(pieces)]


class Counter(dict):
    """Piece counts by word (bytes); a missing word is counted and kept."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        n = len(text)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        pieces = [0] * (n + 1)
        single = [False] * n
        done = 0  # ends up to here are final
        for end, (size, score) in self.automaton.iter(text):
            while done < end:  # ends without a match: the character before is unknown
                done += 1
                if not single[done - 1]:
                    self._unknown(text, best, pieces, done)
            if size == 1:
                single[end] = True
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], pieces[end + 1] = s, pieces[end + 1 - size] + 1
        while done < n:
            done += 1
            if not single[done - 1]:
                self._unknown(text, best, pieces, done)
        return pieces[n]

    def _unknown(self, text: str, best: list[float], pieces: list[int], end: int) -> None:
        s = best[end - 1] + self.unknown
        if s > best[end]:
            best[end], pieces[end] = s, pieces[end - 1] + len(text[end - 1].encode("utf-8", "replace"))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.count(MARK + word.decode("utf-8", "replace"))
        return n


SCHEMA = "doc_id long, n_words long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_words, n_tokens; one row per input row.

    Words are runs of anything but U+0020 and U+0009 to U+000D, each led by the mark of a word start, so
    the best path of a text is that of its words. A null text has no words; doc_id may be null or
    repeated; no rows give no rows; other columns are not read. No shuffle; the vocabulary goes to the
    executors with the plan, and its size is that of the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for rows, texts in text_slices(batches, SLICE_BYTES):
            words = [t.split() for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            tokens = np.fromiter((sum(map(counter.__getitem__, w)) for w in words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([id_array(*ids_of(rows)), pa.array(n), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
