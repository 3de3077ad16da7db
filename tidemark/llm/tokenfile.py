"""Token-id files of independent Zstandard frames with a trailing seek table.

Layout: data frames (the ids of consecutive documents, little-endian unsigned, 16 bits if the vocabulary allows, else
32), one index frame (document ids, null flags and id counts), then a skippable frame with the seek table of the
seekable format: per frame its compressed size, decompressed size and the low 32 bits of its content's XXH64, and a
footer.  A reader opens the table and the index, then decompresses only the frames of the documents it is asked for,
checking each against its checksum (``ValueError`` if they differ).

Documents are written in ascending id order (null ids first, repeated ids in any order), each with the end id
appended; null and empty texts consist of the end id alone.  A document larger than a frame has a frame of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, written
from tidemark.llm.tokens import encoded

# The seekable format's magic numbers.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS, FILE_IDS = 1 << 16, 1 << 26


class Writer:
    """Appends documents to one file."""

    def __init__(self, stream, width: int, frame_ids: int = FRAME_IDS):
        self.stream, self.dtype, self.frame_ids = stream, np.dtype(f"<u{width}"), frame_ids
        self.context = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.held_ids = self.total = 0
        self.names: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, data: bytes) -> None:
        packed = self.context.compress(data)
        self.stream.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).astype(self.dtype).tobytes())
            self.held, self.held_ids = [], 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        if self.held_ids and self.held_ids + len(ids) > self.frame_ids:
            self._flush()
        self.held.append(ids)
        self.held_ids += len(ids)
        self.names.append(name)
        self.counts.append(len(ids))
        self.total += len(ids)

    def close(self) -> None:
        self._flush()
        names = np.array([n or 0 for n in self.names], "<i8")
        nulls = np.array([n is None for n in self.names], np.uint8)
        self._frame(struct.pack("<QQ", len(names), self.dtype.itemsize) + names.tobytes() + nulls.tobytes() + np.array(self.counts, "<u8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, FOOTER)  # the bit says that checksums are present
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        raw = self._at(size - 9 - 12 * frames - 8, 8 + 12 * frames)
        if struct.unpack("<II", raw[:8]) != (SKIPPABLE, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(raw[8:], "<u4").reshape(-1, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(frames - 1)
        n, width = struct.unpack("<QQ", index[:16])
        self.dtype = np.dtype(f"<u{width}")
        self.names = np.frombuffer(index, "<i8", n, 16)
        self.nulls = np.frombuffer(index, np.uint8, n, 16 + 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u8", n, 16 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first = np.concatenate([[0], np.cumsum(self.table[:-1, 1] // width)])  # ids before each data frame

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offset[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} differs from its checksum")
        return data

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Ids of the documents at ``rows`` (ascending places in the file; all by default); each frame is read once."""
        last, ids = -1, np.zeros(0, self.dtype)
        for row in range(len(self.counts)) if rows is None else rows:
            if not self.counts[row]:
                yield int(row), np.zeros(0, self.dtype)
                continue
            k = int(np.searchsorted(self.first, self.starts[row], side="right")) - 1
            if k != last:
                last, ids = k, np.frombuffer(self.frame(k), self.dtype)
            lo = int(self.starts[row] - self.first[k])
            yield int(row), ids[lo:lo + int(self.counts[row])]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text",
                      folder: str | None = None) -> DataFrame:
    """Write all documents in id order; the list of files ``(path, part, number, docs, ids)``, in order of part and number."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        stem, done, out = f"part-{part:05d}-{uuid.uuid4().hex}", [], None

        def finish() -> None:
            out.close()
            done.append((f"{folder}/{stem}-{len(done):04d}.ids.zst", part, len(done), len(out.counts), out.total))

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids, bounds in encoded(batch.column(1), tokenizer):
                for k in range(len(bounds) - 1):
                    if out is None:
                        width = 2 if ids.dtype == np.uint16 and end_id < 1 << 16 else 4
                        out = Writer(store.open_output_stream(f"{root}/{stem}-{len(done):04d}.ids.zst", compression=None), width)
                    out.add(names[i + k], np.append(ids[bounds[k]:bounds[k + 1]].astype(np.uint32), np.uint32(end_id)))
                    if out.total >= FILE_IDS:
                        finish()
                        out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                         ["path", "part", "number", "docs", "ids"])

    return written(ordered.mapInArrow(write, "path string, part int, number int, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame, wanted: frozenset[int] | None = None, ids: bool = False) -> DataFrame:
    """Documents of the files, or the ``wanted`` ones: id, ``start`` (ids of all documents before it), count, CRC-32 of its
    ids as 32-bit integers, and with ``ids`` the ids."""
    listed = files.select("path", "part", "number", "ids").orderBy("part", "number").collect()  # one row a file
    starts, total = [], 0
    for r in listed:
        starts.append((r["path"], total))
        total += r["ids"]
    spark = files.sparkSession
    plan = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    rows = None if wanted is None else np.flatnonzero(np.isin(reader.names, list(wanted)) & ~reader.nulls)
                    out, held = [], 0
                    for row, found in reader.documents(rows):
                        out.append((None if reader.nulls[row] else int(reader.names[row]), before + int(reader.starts[row]), len(found),
                                    zlib.crc32(found.astype("<u4").tobytes())) + ((found.tolist(),) if ids else ()))
                        held += len(found) if ids else 1
                        if held >= 1 << 17:
                            yield table(out)
                            out, held = [], 0
                    yield table(out)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
