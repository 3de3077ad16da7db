"""Helpers the operators share: the cluster's shared folder, and vectorised hashing of words in Arrow text columns.

Python tasks see a text column as one byte buffer with offsets, so words, lines and n-grams of thousands of
documents are hashed by a few numpy passes; buffers are worked through in pieces of ``PIECE`` bytes, which bounds
memory whatever the length of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 18
#: Rows and bytes of one Arrow batch on its way to a Python task, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of a row group of written tables: what a writing task buffers.
ROW_GROUP = 16 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []
_state: dict = {"kind": None, "held": {}}


def held(kind: str, name: str, make: Callable[[], object]) -> object:
    """Something a worker keeps from task to task of one kind (a tokenizer, a model, a table).  A worker that turns to
    another kind of task forgets the rest, so that one kind's memory is all that a reused worker ever holds."""
    enter(kind)
    if name not in _state["held"]:
        _state["held"][name] = make()
    return _state["held"][name]


def enter(kind: str) -> None:
    """Start work of a kind: what was kept for another kind is given up."""
    if _state["kind"] != kind:
        _state["kind"], _state["held"] = kind, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its free pages
            ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``; local sessions without it get a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, keeps column pruning; ``by``: one folder a value."""
    folder = shared_folder(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(by) if by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def wide(df: DataFrame, tasks_per_core: int = 1) -> DataFrame:
    """``df`` dealt round robin over all cores if its scan has fewer partitions (no key, so no skew).  Bounds the session's Arrow
    batches, unless they are smaller already: rows are whole texts, and each batch is in memory on both sides."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    want = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def sampled(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """About ``n`` rows (at most ``4 n``) whose hash of ``columns`` is below the share that ``n`` is of all rows."""
    share = min(1.0, n / max(1, df.count()))
    return df.where(chance(*columns) < share).limit(4 * n)


def chance(*columns: str) -> Column:
    """A number in [0, 1) by a hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``limit`` bytes, one longer document alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, for positions below ``n``."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, PIECE + 4096)
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """``h`` with ``(h[e] - h[s]) * inverse ** s`` a polynomial hash of ``b[s:e]``."""
    power, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[b] * power[:len(b)], out=out[1:])
    return out


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``b[starts[i]:ends[i]]`` for spans in ascending order that do not overlap."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        lo = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        if ends[stop - 1] - lo > 2 * PIECE:  # one very long span
            out[k] = xxhash.xxh64_intdigest(b[lo:ends[k]].tobytes())
            k += 1
            continue
        h = prefix_hash(b[lo:ends[stop - 1]])
        s, e = starts[k:stop] - lo, ends[k:stop] - lo
        with np.errstate(over="ignore"):
            out[k:stop] = (h[e] - h[s]) * powers(len(h))[1][s] + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        k = stop
    return mix(out)


def word_spans(b: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^ \\t-\\r]+``; none crosses a document start."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _SPACE[b]
    solid = ~blank
    cut = doc_starts[(doc_starts > 0) & (doc_starts < len(b))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return _LOWER[b]


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and their documents; a document with fewer words gives one of its whole sequence.

    ``bounds``: word index at which each document starts, and the total.
    """
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        value = np.full(len(words), 0x1B873593CC9E2D51, np.uint64)
        for k in range(size):
            value[:len(words) - k] = mix(value[:len(words) - k] + words[k:])
        short = np.flatnonzero((counts > 0) & (counts < size))
        docs = np.repeat(np.arange(len(counts)), counts)
        position = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
        keep = position + size <= np.repeat(counts, counts)
        whole = np.full(len(short), 0x2127599BF4325C37, np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] = mix(whole[has] + words[bounds[short[has]] + k])
    return np.concatenate([value[keep], whole]), np.concatenate([docs[keep], short])
