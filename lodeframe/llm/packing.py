"""Best-fit decreasing packing of token pieces into sequences.

Lengths are whole numbers up to the capacity, so best-fit decreasing runs over the histogram of lengths: a
segment tree over remaining capacities finds the tightest open bin, and all pieces of one length that go into
bins of one remaining capacity are placed in one step. The result is that of placing piece after piece, while
the plan has a number of steps bounded by the square of the capacity, whatever the input. Pieces get their rank
within their length in a distributed pass and read sequence and offset off the plan.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import cut, spread, text_blocks, utf8, with_prefix

CAPACITY = 2048


class TightestBin:
    """Segment tree over remaining capacities 0..capacity: counts of open bins, and the least capacity of at
    least some size that has one, in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += bins
            i >>= 1

    def count(self, remaining: int) -> int:
        return self.tree[remaining + self.size]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Plan:
    """Steps in order of (length, first rank): pieces of this length from that rank on go to bins from `bin` on,
    `per` of them in each bin, the first at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    per: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # steps of a length are contiguous: find the last step that starts at or before the rank
        first = np.searchsorted(self.length, length, side="left")
        last = np.searchsorted(self.length, length, side="right")
        low, high = first.copy(), last - 1
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.rank[mid] <= rank
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        past = rank - self.rank[low]
        return self.bin[low] + past // self.per[low], self.offset[low] + past % self.per[low] * length


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over {length: pieces}, lengths 1..capacity."""
    tree = TightestBin(capacity)
    open_: dict[int, deque[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            open_.setdefault(remaining, deque()).append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            found = tree.tightest(length)
            if found is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    steps.append((length, rank, bins, 0, per))
                    keep(capacity - per * length, bins, full)
                    bins, rank = bins + full, rank + full * per
                if rest:
                    steps.append((length, rank, bins, 0, rest))
                    keep(capacity - rest * length, bins, 1)
                    bins += 1
                break
            first, count = open_[found].popleft()
            used = min(left, count)
            if used < count:
                open_[found].appendleft((first + used, count - used))
            tree.add(found, -used)
            steps.append((length, rank, first, capacity - found, 1))
            keep(found - length, first, used)
            left, rank = left - used, rank + used
    steps.sort()
    columns = np.array(steps, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, bins=bins)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of every row, 0 at the end of each, cut into pieces
    of capacity ids; only the last piece may be shorter. Null and empty texts have the id 0 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodeframe.llm.bpe import ids_crc32, word_bpe

        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts, row, number, start, length, crc = utf8(batch.column(1)), [], [], [], [], []
            for low, high in text_blocks(texts, 2 << 20):
                for i, ids in enumerate(bpe.encode(texts[low:high]), low):
                    ids = np.append(ids, np.uint32(0))
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        row.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(ids_crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, per_bucket: int = 5_000) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences hold at most capacity ids, gapless from offset 0. Repeated rows and equal texts are packed each for
    itself; null and empty texts are one piece of length 1; an empty table gives an empty result. Which of
    several pieces of equal length goes where is decided by a hash of the id, so reruns agree unless rows repeat.
    """
    cut_up = cut(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(histogram, capacity)
    keyed = cut_up.withColumn("_hash", spread(F.struct("doc_id", "piece"))).withColumn("_one", F.lit(1))
    ranked = with_prefix(keyed, ["length"], ["_hash", "doc_id", "piece", "ids_crc32"], "_one", sum(histogram.values()), before="_rank", per_bucket=per_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            where, offset = plan.place(length, rank) if len(length) else (length, length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
