"""Operator 10: vector bin packing of examples into training sequences.

Each example is a vector (tokens, segments, loss-bearing tokens); a sequence has a limit on each.  Whole sequences
are cut off long examples first.  What is left of them waits in a pool of bounded size.  To fill a sequence, the
waiting example with the largest dot product of its need and the sequence's free capacity (both scaled by the
limits) is placed again and again, as long as one fits under all limits; then a piece that fills the sequence is
cut off the longest one.  A sequence that meets its segment or loss limit first is cut back to a power of two
tokens, and the tail waits again.  What the pool holds at the end of a partition becomes sequences whose lengths are
powers of two, so nothing is padded.

A partition is packed in one pass in the order of its rows; nothing is shuffled and nothing unbounded is held.  Sequence ids are ``partition << 40 | number``, the same when a task is repeated.

Instruction data has a prompt beside the text: its ids come first and bear no loss, the text's and the end id do.  Plain documents have
none, so each of their ids bears loss.

Cases: null text is the end id alone, and a null prompt empty; null keys stay null; repeated rows are packed each on its own; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.common import slices

TOKENS = 1024
SEGMENTS = 64
POOL = 512
NO_IDS = np.empty(0, "<u4")


class Packer:
    """Takes examples one by one and yields closed sequences, lists of pieces ``(example, start, length)``.

    An example's ``loss`` is a bool array over its tokens, or None where every token bears loss.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        if min(tokens, segments, loss or tokens) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array([tokens, segments, loss or tokens], "f8")
        self.tokens, self.pool = tokens, pool
        self.needs = np.zeros((0, 3))
        self.waiting: list[tuple] = []  # (example, start, length, cumulative loss or None)

    @staticmethod
    def need(item: tuple) -> tuple[float, float, float]:
        _, start, n, cum = item
        return n, 1, n if cum is None else int(cum[start + n] - cum[start])

    @staticmethod
    def longest(item: tuple, room: np.ndarray) -> int:
        """Tokens of the item's start that fit in the room."""
        _, start, n, cum = item
        k = int(min(n, room[0]))
        if room[1] < 1:
            return 0
        return int(min(k, room[2])) if cum is None else int(np.searchsorted(cum[start + 1 : start + k + 1] - cum[start], room[2], side="right"))

    def wait(self, items: list[tuple]) -> None:
        if items:
            self.waiting += items
            self.needs = np.vstack([self.needs, [self.need(x) for x in items]])

    def take(self, k: int, n: int) -> tuple:
        """Cut ``n`` tokens off the start of waiting item ``k``."""
        ex, start, length, cum = self.waiting[k]
        if n == length:
            last = len(self.waiting) - 1
            self.waiting[k] = self.waiting[last]
            self.needs[k] = self.needs[last]
            self.waiting.pop()
            self.needs = self.needs[:last]
        else:
            self.waiting[k] = (ex, start + n, length - n, cum)
            self.needs[k] = self.need(self.waiting[k])
        return (ex, start, n, cum)

    def add(self, example, n: int, loss: np.ndarray | None = None) -> Iterator[list[tuple]]:
        cum = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        start = 0
        while n - start >= self.tokens and self.longest((example, start, self.tokens, cum), self.limit) == self.tokens:
            yield [(example, start, self.tokens)]
            start += self.tokens
        if start < n:
            self.wait([(example, start, n - start, cum)])
        while len(self.waiting) > self.pool:
            yield self.fill()

    def fill(self) -> list[tuple]:
        room, placed = self.limit.copy(), []
        while room.min() >= 1 and self.waiting:
            fits = (self.needs <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, (self.needs / self.limit) @ (room / self.limit), -1.0)))
                n = self.waiting[k][2]
            else:
                k = int(np.argmax(self.needs[:, 0]))
                n = self.longest(self.waiting[k], room)
                if n == 0:
                    break
            item = self.take(k, n)
            room -= self.need(item)
            placed.append(item)
        used = sum(x[2] for x in placed)
        if used < self.tokens:
            placed, rest = self.split(placed, 1 << (used.bit_length() - 1))
            self.wait(rest)
        return [x[:3] for x in placed]

    @staticmethod
    def split(items: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``size`` tokens of the items, and the others."""
        head, tail = [], []
        for ex, start, n, cum in items:
            k = min(size, n)
            size -= k
            if k:
                head.append((ex, start, k, cum))
            if k < n:
                tail.append((ex, start + k, n - k, cum))
        return head, tail

    def finish(self) -> Iterator[list[tuple]]:
        while self.waiting:
            yield self.fill()


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt: str | None = None, finish=None, schema: pa.Schema | None = None) -> DataFrame:
    """Rows ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one for each piece of a document.

    ``loss`` limits a sequence's loss-bearing tokens (none: as many as tokens); ``prompt`` names the column of prompts.  ``finish(ids) -> value`` with a one-column ``schema`` puts another
    column in the place of ``ids``.
    """
    fin = finish or (lambda ids: ids.tobytes())
    last = schema.field(0) if schema else pa.field("ids", pa.binary())
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), last, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        codec, packer = bpe.codec(tokenizer), Packer(tokens, segments, loss)
        docs: dict[int, list] = {}  # serial -> key, ids, tokens not yet placed
        number, serial, rows = TaskContext.get().partitionId() << 40, 0, []

        def closed(sequences: Iterable[list[tuple]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for doc, start, n in sequence:
                    entry = docs[doc]
                    rows.append((entry[0], start, n, fin(entry[1][start : start + n]), len(entry[1]), number, offset))
                    offset += n
                    entry[2] -= n
                    if not entry[2]:
                        del docs[doc]
                number += 1

        def flush():
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
            rows.clear()
            return batch

        for batch in batches:
            for part in slices(batch, 2048, 2 << 20):
                ahead = codec.encode(part.column(2).to_pylist()) if prompt else [NO_IDS] * part.num_rows
                for k, first, ids in zip(part.column(0).to_pylist(), ahead, codec.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([first, ids, np.array([end_id], "<u4")])
                    docs[serial] = [k, ids, len(ids)]
                    closed(packer.add(serial, len(ids), np.arange(len(ids)) >= len(first) if prompt else None))
                    serial += 1
                if rows:
                    yield flush()
        closed(packer.finish())
        if rows:
            yield flush()

    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    ddl = ", ".join(f"{f.name} {kinds[f.type]}" for f in out)
    columns = [F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *([F.col(prompt).alias("prompt")] if prompt else [])]
    return df.select(*columns).mapInArrow(run, ddl)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
