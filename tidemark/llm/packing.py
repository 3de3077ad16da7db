"""Best-fit packing of documents into sequences by swap-based local search.

Documents are tokenized, an id is appended, and only those longer than a sequence are cut.  Full pieces are sequences
of their own.  The rest is dealt by hash to shards of about ``SHARD`` pieces; each starts from best-fit decreasing and
is improved by moves and by one-for-one, two-for-one and one-for-two exchanges between underfull bins.  A change is made
if it raises the sum of squared fills, so the emptiest bins drain until they are gone; a shard leaves about one
underfull bin more than a global packing would.

Null and empty texts are one piece of the appended id.  Null ids and repeated rows are packed row by row; ties go to
the earlier piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import wide, written
from tidemark.llm.tokens import encoded

SHARD, PASSES, TRIES = 16_384, 6, 24


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and with ``ids`` the ids."""
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found, bounds in encoded(batch.column(1), tokenizer):
                rows, piece, start, length, crc, held = [], [], [], [], [], []
                for k in range(len(bounds) - 1):
                    own = np.append(found[bounds[k]:bounds[k + 1]].astype("<u4"), np.uint32(end_id))
                    for p, at in enumerate(range(0, len(own), capacity)):
                        part = own[at:at + capacity]
                        rows.append(i + k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if ids:
                            held.append(part.tolist())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(v, pa.int64()) for v in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.list_(pa.int64()))] * ids, names)

    names = [id_column, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    schema = T.StructType([docs.schema[id_column], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names[2:5]],
                           *[T.StructField("ids", T.ArrayType(T.LongType()))] * ids])
    return wide(docs.select(id_column, text)).mapInArrow(tokenize, schema)


class Bins:
    """Bins of items, and where exchanges that fill a bin can be found.

    ``swaps[v]`` lists ``(bin, version, item places)``: taking those items out makes room for ``v``."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.version: list[int] = []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.room_mask = 0
        self.swaps: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(2 * capacity + 1)]
        self.swap_mask = 0

    def best_fit_decreasing(self) -> None:
        """Each item, longest first, into the fullest bin that has room."""
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            b = self._fullest(self.lengths[i])
            if b is None:
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
                self.version.append(0)
            self.items[b].append(i)
            self.fill[b] += self.lengths[i]
            self._touch(b, swaps=False)

    def _fullest(self, size: int, apart: int = -1) -> int | None:
        """The fullest bin but ``apart`` with room for ``size``."""
        mask = self.room_mask >> size << size
        while mask:
            v = (mask & -mask).bit_length() - 1
            stack = self.room[v]
            while stack and self.version[stack[-1][0]] != stack[-1][1]:
                stack.pop()
            if not stack:
                self.room_mask &= ~(1 << v)
            else:
                found = next((b for b, ver in reversed(stack[-TRIES:]) if b != apart and self.version[b] == ver), None)
                if found is not None:
                    return found
            mask &= mask - 1
        return None

    def _touch(self, b: int, swaps: bool = True) -> None:
        """List a changed bin anew."""
        self.version[b] += 1
        slack = self.capacity - self.fill[b]
        if not self.items[b] or not slack:
            return
        self.room[slack].append((b, self.version[b]))
        self.room_mask |= 1 << slack
        if swaps:
            own = [self.lengths[i] for i in self.items[b]]
            few = range(min(len(own), 32))
            for out in [(k,) for k in range(len(own))] + [(j, k) for j in few for k in few if j < k]:
                v = slack + sum(own[k] for k in out)
                self.swaps[v].append((b, self.version[b], out))
                self.swap_mask |= 1 << v

    def _exchange(self, a: int, given: tuple[int, ...]) -> bool:
        """Give items of bin ``a`` (places) to the bin they fill best, for items that are shorter; True if one gains."""
        size = sum(self.lengths[self.items[a][k]] for k in given)
        mask, tries = self.swap_mask >> size << size, 0
        while mask and tries < TRIES:
            v = (mask & -mask).bit_length() - 1
            stack, keep = self.swaps[v], []
            while stack and tries < TRIES:
                b, version, out = stack.pop()
                if self.version[b] != version:
                    continue
                keep.append((b, version, out))
                tries += 1
                gain = size - sum(self.lengths[self.items[b][k]] for k in out)
                if b != a and gain > 0 and self.fill[b] + gain > self.fill[a] and len(given) + len(out) < 4:
                    stack.extend(reversed(keep[:-1]))
                    mine, theirs = [self.items[a][k] for k in given], [self.items[b][k] for k in out]
                    self.items[a] = [i for i in self.items[a] if i not in mine] + theirs
                    self.items[b] = [i for i in self.items[b] if i not in theirs] + mine
                    self.fill[a] -= gain
                    self.fill[b] += gain
                    self._touch(a)
                    self._touch(b)
                    return True
            stack.extend(reversed(keep))
            if not stack:
                self.swap_mask &= ~(1 << v)
            mask &= mask - 1
        return False

    def _move(self, a: int, k: int) -> bool:
        size = self.lengths[self.items[a][k]]
        b = self._fullest(size, a)
        if b is None or self.fill[b] + size <= self.fill[a]:
            return False
        self.items[b].append(self.items[a].pop(k))
        self.fill[a] -= size
        self.fill[b] += size
        self._touch(a)
        self._touch(b)
        return True

    def improve(self, passes: int = PASSES) -> None:
        """Drain underfull bins, emptiest first, until a pass changes nothing."""
        for b in range(len(self.items)):
            self._touch(b)
        for _ in range(passes):
            changed = False
            for a in sorted(range(len(self.items)), key=lambda b: (self.fill[b], b)):
                again = bool(self.items[a]) and self.fill[a] < self.capacity
                while again:
                    own = sorted(range(len(self.items[a])), key=lambda k: -self.lengths[self.items[a][k]])
                    pairs = [(j, k) for n, j in enumerate(own[:16]) for k in own[n + 1:16]]
                    again = (any(self._move(a, k) for k in own) or any(self._exchange(a, (k,)) for k in own)
                             or any(self._exchange(a, p) for p in pairs))
                    changed |= again
                    again = again and bool(self.items[a])
            if not changed:
                return


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers for lengths of at most ``capacity``."""
    bins = Bins(lengths, capacity)
    bins.best_fit_decreasing()
    bins.improve()
    return [b for b in bins.items if b]


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0)."""
    names = pieces.columns
    rows = written(pieces.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    total = rows.where(F.col("length") < capacity).count()
    shards = max(1, -(-total // SHARD))
    full = rows.where(F.col("length") >= capacity).select(*names, (F.col("row_") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, order = key[0].as_py(), table.column("row_").to_numpy()
        by_row = np.argsort(order, kind="stable")
        lengths = table.column("length").to_numpy()[by_row]
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for n, items in enumerate(pack_lengths(lengths.tolist(), capacity)):
            place = by_row[items]
            sequence[place] = (shard << 32) + n
            offset[place] = np.cumsum(lengths[items]) - lengths[items]
        kept = table.select(names)
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = rows.where(F.col("length") < capacity).withColumn("shard_", F.pmod(F.xxhash64("row_"), F.lit(shards)))
    return rest.groupBy("shard_").applyInArrow(one, schema).unionByName(full)
