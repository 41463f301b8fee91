"""Token counts of a unigram vocabulary without the tokens: Aho-Corasick matches and a Viterbi pass that keeps counts.

The tokenizer: a space (or the mark U+2581) begins a new word, written with the mark in front; each word is cut into
vocabulary pieces of the largest total score. Of equal totals the path found first wins, with starts in ascending
order, so the last piece is the longest. A character that no single piece covers costs the least score less 10 and
counts one token for each UTF-8 byte (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Fixed by the unigram tokenizers: the penalty of an unknown character below the least score.
UNKNOWN_PENALTY = 10.0
#: Words that one worker process remembers; then it starts afresh.
CACHE_WORDS = 1_000_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.breaks = not any("\n" in piece for piece, _ in vocabulary)
        self.words: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """(score, tokens) of the best segmentation."""
        n = len(word)
        by_start: list[list] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(word):
            by_start[end + 1 - size].append((end + 1, score))
        scores: list = [None] * (n + 1)
        counts = [0] * (n + 1)
        scores[0] = 0.0
        for i in range(n):
            base, count = scores[i], counts[i] + 1
            single = False
            for end, score in by_start[i]:
                single |= end == i + 1
                got = base + score
                if scores[end] is None or got > scores[end]:
                    scores[end], counts[end] = got, count
            if not single:
                got = base + self.unknown
                if scores[i + 1] is None or got > scores[i + 1]:
                    scores[i + 1], counts[i + 1] = got, counts[i] + len(word[i].encode("utf-8", "surrogatepass"))
        return scores[n], counts[n]

    def _learn(self, word: str) -> int:
        if self.breaks and "\n" in word:  # no piece has a line feed, so it stands alone
            first, *rest = word.split("\n")
            return self.best(MARK + first)[1] + sum(1 + self.best(p)[1] for p in rest)
        return self.best(MARK + word)[1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = text[1:].split(" ") if text[0] == " " else text.split(" ")
        known = self.words
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self._learn(w)
            return sum(map(known.__getitem__, words))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """docs with n_tokens (long) of every whole text; null and empty texts have 0. A column of that name is replaced.

    Every row counts for itself; other columns, and an empty table, pass through.
    """
    common.ship(docs.sparkSession)
    keep = docs.drop("n_tokens")
    rest = keep.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep.columns]).alias("rest"))
    schema = T.StructType([rest.schema["rest"], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path).count
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([count(t) for t in part.column(0).to_pylist()], pa.int64())], names=["rest", "n_tokens"])

    return rest.mapInArrow(run, schema).select("rest.*", "n_tokens")
