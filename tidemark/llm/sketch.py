"""Counts of hashed items in a table of fixed size, built by Spark and small enough to broadcast.

Items are evenly spread 64-bit hashes; the top ``bits`` of each name its cell.  The result has two bits a cell (``2 ** bits / 4``
bytes whatever the input), so its size is bounded: level 0 is a count of at most one, levels 1 to 3 are higher
counts.  Cells can be shared by several items, which only ever raises a level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import enter, held

BITS, HELD = 27, 1 << 20


def _packed(cells: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte plane by byte plane, compressed."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def count_levels(df: DataFrame, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> Levels:
    """Levels of the hashes that ``items`` yields for each batch of ``df``; ranges of cells are added up apart, as
    many as the session has shuffle partitions (rounded up to a power of two, 4096 at most)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4096, 1 << max(3, (parts - 1).bit_length()))
    per_range = (1 << bits) // ranges

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("counts")
        found_, n = [], 0

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(found_))
            edges = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.int64) * per_range)
            full = [r for r in range(ranges) if edges[r] < edges[r + 1]]
            data = [_packed(cells[edges[r]:edges[r + 1]] - np.uint32(r * per_range)) for r in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])

        for batch in batches:
            for found in items(batch):
                found_.append((found >> np.uint64(64 - bits)).astype(np.uint32))
                n += len(found)
                if n >= HELD:
                    yield flush()
                    found_, n = [], 0
        if n:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the rows of one range after the other as they stream in."""
        now, counts = None, None
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    if now is not None:
                        yield finish(now, counts)
                    now, counts = r, np.zeros(per_range, np.int64)
                cells = _unpacked(data.as_py())
                counts += np.bincount(cells, minlength=per_range)
        if now is not None:
            yield finish(now, counts)

    def finish(r: int, counts: np.ndarray) -> pa.RecordBatch:
        mean = counts.mean()  # what chance adds to a cell
        level = (counts > 1).astype(np.uint8) + (counts >= 16 + 4 * mean) + (counts >= 200 + 16 * mean)
        four = level.astype(np.uint8).reshape(-1, 4)
        packed = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(packed)], pa.binary())], ["range", "data"])

    rows = df.mapInArrow(scatter, "range int, data binary").repartition(ranges, "range").sortWithinPartitions("range")
    found = rows.mapInArrow(gather, "range int, data binary").collect()  # 2 ** bits / 4 bytes in all, compressed
    return Levels(bits, per_range // 4, {r["range"]: bytes(r["data"]) for r in found})


class Levels:
    """The packed levels, range by range as the tasks compressed them: the driver hands them on, each worker unpacks them once."""

    def __init__(self, bits: int, size: int, ranges: dict[int, bytes]):
        self.name, self.shift = uuid.uuid4().hex, np.uint64(64 - bits)
        self.bits, self.size, self.ranges = bits, size, ranges

    def _unpack(self) -> np.ndarray:
        out = np.zeros(1 << (self.bits - 2), np.uint8)
        for r, data in self.ranges.items():
            out[r * self.size:(r + 1) * self.size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        return out

    def packed(self) -> np.ndarray:
        return held(f"levels {self.name}", "packed", self._unpack)


def level_of(levels: Levels, hashes: np.ndarray) -> np.ndarray:
    """Level of each hash."""
    cell = hashes >> levels.shift
    return (levels.packed()[(cell >> np.uint64(2)).astype(np.int64)] >> ((cell & np.uint64(3)) * np.uint64(2)).astype(np.uint8)) & np.uint8(3)
