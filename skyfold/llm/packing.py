"""Packing token ids into sequences by vector bin packing.

Each task packs its own documents, with no exchange. Whole sequences are cut off long documents first; what
remains waits in a pool of bounded size, and bins are filled one after the other: always with the waiting piece
whose vector (tokens, segments, loss-bearing tokens) has the largest dot product with what the bin has left, among
those that fit. When none fits, a piece is cut to fill the bin. A task's last bin is cut into powers of two.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, words

#: Waiting pieces at which a task begins to fill bins, and with how many it stops.
POOL, REST = 768, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids array<int>"


class Packer:
    def __init__(self, limits: tuple[int, int, int], first_id: int, with_ids: bool):
        self.limits = np.array(limits, float)
        self.next_id, self.with_ids = first_id, with_ids
        self.size = 0
        self.vec = np.zeros((POOL * 2, 3))
        self.items: list = [None] * (POOL * 2)
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes, loss_from: int) -> None:
        """One document: whole bins at once, the rest waits."""
        n, start = len(ids) // 4, 0
        most = int(min(self.limits[0], self.limits[2]))
        while n - start >= self.limits[0] and self._loss(start, start + most, loss_from) <= self.limits[2] and most == self.limits[0]:
            self._emit([(doc_id, ids, start, start + most, loss_from)])
            start += most
        while start < n:
            end = min(n, start + most)
            self._wait((doc_id, ids, start, end, loss_from))
            start = end
        if self.size >= POOL:
            while self.size > REST:
                self._emit(self._fill())

    def finish(self) -> None:
        while self.size:
            got = self._fill()
            total = sum(x[3] - x[2] for x in got)
            if total == self.limits[0] or total & (total - 1) == 0 or self.size:
                self._emit(got)
                continue
            power = 1 << (total.bit_length() - 1)
            head, left = [], power
            for k, x in enumerate(got):
                take = min(left, x[3] - x[2])
                head.append((*x[:3], x[2] + take, x[4]))
                left -= take
                if not left:
                    if x[2] + take < x[3]:
                        self._wait((*x[:2], x[2] + take, *x[3:]))
                    for y in got[k + 1 :]:
                        self._wait(y)
                    break
            self._emit(head)

    @staticmethod
    def _loss(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _wait(self, item: tuple) -> None:
        if self.size == len(self.items):
            self.items += [None] * len(self.items)
            self.vec = np.concatenate([self.vec, np.zeros_like(self.vec)])
        self.items[self.size] = item
        self.vec[self.size] = (item[3] - item[2], 1, self._loss(*item[2:]))
        self.size += 1

    def _pop(self, i: int) -> tuple:
        self.size -= 1
        item = self.items[i]
        self.items[i], self.vec[i] = self.items[self.size], self.vec[self.size]
        self.items[self.size] = None
        return item

    def _fill(self) -> list[tuple]:
        """Take one bin's pieces from the pool."""
        left, got = self.limits.copy(), []
        scale = 1 / (self.limits * self.limits)
        while self.size and left[0] > 0 and left[1] > 0:
            vec = self.vec[: self.size]
            value = np.where((vec <= left).all(1), vec @ (left * scale), -1.0)
            i = int(np.argmax(value))
            if value[i] >= 0:
                left -= vec[i]
                got.append(self._pop(i))
                continue
            i = int(np.argmax(vec[:, 0]))
            doc_id, ids, start, end, loss_from = self.items[i]
            end_ = min(end, start + int(left[0]), max(start, loss_from) + int(left[2]))
            if end_ <= start:
                break
            self._pop(i)
            piece = (doc_id, ids, start, end_, loss_from)
            left -= (end_ - start, 1, self._loss(*piece[2:]))
            got.append(piece)
            if end_ < end:
                self._wait((doc_id, ids, end_, end, loss_from))
        return got

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, end, loss_from in pieces:
            raw = ids[start * 4 : end * 4]
            own = np.frombuffer(raw, np.int32) if self.with_ids else None
            self.out.append((doc_id, start, end - start, zlib.crc32(raw), len(ids) // 4, self.next_id, at, self._loss(start, end, loss_from), own))
            at += end - start
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[]] * 9
        self.out = []
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, max_segments: int = 512, max_loss: int | None = None, end_id: int = 2, loss_from: str | None = None, with_ids: bool = True, cache_words: int = tokens.CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    A document's ids are those of its whole text by the tokenizer, without special tokens, then end_id; null text
    is empty (one id). Every id lies in exactly one piece. loss_from names a column with the number of leading ids
    that bear no loss (null or no column: 0). A sequence never exceeds max_tokens, max_segments pieces, or max_loss
    loss-bearing tokens (null: max_tokens); it is shorter than max_tokens only where the other two limits are met,
    or as one of a task's last sequences, whose lengths are powers of two. sequence_id is unique; rows with equal
    doc_id are packed each on its own; other columns are ignored. An empty table gives no rows. A worker remembers
    the ids of cache_words words at most (some 300 bytes each), if the tokenizer splits at spaces; any other file of the
    tokenizers library is used text by text.
    """
    common.ship(docs.sparkSession)
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("limits are at least 1")
    skip = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.tokenizer_of(tokenizer_path, cache_words)
        packer = Packer(limits, TaskContext.get().partitionId() << 36, with_ids)
        end = int(end_id).to_bytes(4, "little")
        gc.disable()  # nothing here makes cycles, and collections would walk all remembered words
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    ids, texts, firsts = (part.column(c).to_pylist() for c in range(3))
                    for doc_id, own, first in zip(ids, tokenizer.encode(texts), firsts, strict=True):
                        packer.add(doc_id, own + end, first)
                    if packer.out:
                        yield packer.batch()
            packer.finish()
            yield packer.batch()
        finally:  # also where the task fails or is ended early: the worker lives on
            gc.enable()
            words.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), skip.alias("skip")).mapInArrow(run, SCHEMA)
