"""Packing of token pieces into sequences: best fit, then local search by moves and swaps."""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import give_back, only, small_batches, written
from siltstone.llm.encoding import encoder

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, fill long"


def _cutter(path: str, end_id: int, size: int):
    def run(batches):
        only("tokens")
        enc, uid = encoder(path), TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, rows = b.slice(i, 512), []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        own = ids[at : at + size]
                        rows.append((uid, doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
                        uid += 1
                types = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return run


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions in lengths: the longest first, each into the fullest bin that it fits in."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # sorted (room, bin) of bins with room
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        k = bisect.bisect_left(free, (need, -1))
        if k == len(free):
            bins.append([i])
            room, b = size - need, len(bins) - 1
        else:
            room, b = free.pop(k)
            bins[b].append(i)
            room -= need
        if room:
            bisect.insort(free, (room, b))
    return bins


def _sums(lengths: list[int], size: int) -> list[int]:
    """0, and the lengths of one or two of the documents together, each once, below size."""
    own = sorted(set(lengths))
    twice = {2 * x for x in own if lengths.count(x) > 1}
    return sorted({0, *own, *twice, *(x + y for i, x in enumerate(own) for y in own[:i])} - set(range(size, 2 * size + 1)))


class _Open:
    """Underfull bins by what they can give: for each sum of up to two of their documents, the roomiest bin that has it."""

    def __init__(self, size: int):
        self.size = size
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        self.room = np.full(size, -1, np.int64)
        self.state: dict[int, tuple[int, list[int]]] = {}
        self.rooms: list[tuple[int, int]] = []
        self.changes = 0

    def add(self, b: int, room: int, lengths: list[int]) -> None:
        self.changes += 1
        sums = _sums(lengths, self.size)
        self.state[b] = (self.changes, sums, room)
        bisect.insort(self.rooms, (room, b))
        for x in sums:
            heapq.heappush(self.heaps[x], (-room, b, self.changes))
            self.room[x] = max(self.room[x], room)

    def remove(self, b: int) -> None:
        _, sums, room = self.state.pop(b)
        self.rooms.pop(bisect.bisect_left(self.rooms, (room, b)))
        for x in sums:
            heap = self.heaps[x]
            while heap and self.state.get(heap[0][1], (0,))[0] != heap[0][2]:
                heapq.heappop(heap)
            self.room[x] = -heap[0][0] if heap else -1

    def best(self, out: int) -> tuple[int, int, int] | None:
        """(gain, bin, sum that comes back) of the most tokens that a bin can take for documents of `out` tokens."""
        low = max(0, out - self.rooms[-1][0]) if self.rooms else out
        fits = np.flatnonzero(self.room[low:out] >= np.arange(out - low, 0, -1))
        if not len(fits):
            return None
        back = low + int(fits[0])
        # without anything in return: where the least room is left
        return out - back, self.heaps[back][0][1] if back else self.rooms[bisect.bisect_left(self.rooms, (out, -1))][1], back


def _pick(items: list[int], lengths: list[int], total: int) -> list[int]:
    """Up to two of items whose lengths add up to total."""
    if not total:
        return []
    if total in lengths:
        return [items[lengths.index(total)]]
    where = {x: i for i, x in enumerate(lengths)}
    return next([items[i], items[where[total - x]]] for i, x in enumerate(lengths) if where.get(total - x, i) != i)


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empties underfull bins: one or two documents of a bin go to a fuller one, for none, one or two of that bin's.

    Bins give in the order of their fill, the emptiest first, and only to those that are still to come in the order, so each
    step raises the sum of squared fills. Passes go on until one finds no step, or the room left in all bins together
    is less than one bin.
    """
    held = [list(b) for b in bins]
    fill = [int(lengths[b].sum()) for b in held]
    of = lengths.tolist()
    while True:
        order = sorted((k for k in range(len(held)) if 0 < fill[k] < size), key=lambda k: (fill[k], k))
        if len(order) < 2 or sum(size - fill[k] for k in order) < size:
            break
        rest, steps = _Open(size), 0
        for k in order[1:]:
            rest.add(k, size - fill[k], [of[i] for i in held[k]])
        for k in order:
            if k in rest.state:
                rest.remove(k)
            if fill[k] >= size:
                continue
            while held[k] and rest.rooms:
                own = [of[i] for i in held[k]]
                found = [(rest.best(out), out) for out in _sums(own, size)[1:]]
                (gain, to, back), out = max((x for x in found if x[0]), default=((0, 0, 0), 0))
                if not gain:
                    break
                give, take = _pick(held[k], own, out), _pick(held[to], [of[i] for i in held[to]], back)
                held[k] = [i for i in held[k] if i not in give] + take
                held[to] = [i for i in held[to] if i not in take] + give
                fill[k] -= gain
                fill[to] += gain
                rest.remove(to)
                if fill[to] < size:
                    rest.add(to, size - fill[to], [of[i] for i in held[to]])
                steps += 1
        if not steps:
            break
    return [b for b in held if b]


def _packer(size: int, round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = local_search(best_fit(lengths, size), lengths, size)
        order = np.array([i for b in bins for i in b])
        numbers = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = pdf.iloc[order].drop(columns="block")
        own = lengths[order]
        first = np.searchsorted(numbers, np.arange(len(bins)))
        ends = np.cumsum(own)
        before = ends - own
        fill = np.add.reduceat(own, first)
        out["sequence_id"] = (round_ << 56) + (int(pdf["block"].iloc[0]) << 24) + numbers
        out["offset"] = before - before[first][numbers]
        out["fill"] = fill[numbers]
        return out

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096, block: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    A document is its ids and end_id; only one longer than size is cut. Pieces are dealt into even blocks of
    about `block` rows and packed there, so that a task's work is bounded; the bins that stay underfull are pooled, dealt and
    packed again, until one block holds them all or a round doesn't lower their number (then they stay as they were). A null
    text is the single end_id. Repeated rows, and rows of one id, are packed one by one; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    left = written(rows.mapInArrow(_cutter(tokenizer_path, end_id, size), _PIECES), "pieces")
    closed, n, round_, before, under = [], left.count(), 0, None, None
    while True:
        blocks = max(1, -(-n // block))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(blocks)))
        if blocks > 1:
            dealt = dealt.repartition(blocks, "block")
        packed = written(dealt.groupBy("block").applyInPandas(_packer(size, round_), _PACKED), "packed")
        bins = packed.where("offset = 0")
        if before is not None and bins.count() >= before:
            closed.append(under)
            break
        if blocks == 1:
            closed.append(packed)
            break
        closed.append(packed.where(F.col("fill") == size))
        under = packed.where(F.col("fill") < size)
        left = under.select(*left.columns)
        n, before, round_ = left.count(), bins.where(F.col("fill") < size).count(), round_ + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("uid", "fill")
