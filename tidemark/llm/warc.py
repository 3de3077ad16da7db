"""WARC archives of independent Zstandard frames, one per record, with a shared dictionary.

A file starts with a skippable frame that holds the dictionary; the reader loads it, decodes one frame per record,
and validates version line, headers, lengths, trailer and payload digest (``ValueError`` otherwise).

Of records with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is the response and
the others revisit it; rows that repeat the smallest id are responses too.  A null payload is empty; a null id is
written as ``null``, counts as larger than all others and comes back null; a null url leaves the header out.
Files are written under new names by each task attempt, and only those of the attempts that count are listed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sampled, shared_folder, written

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 1 << 16, 400, 1 << 14
FILE_BYTES = 64 << 20
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if kind == "revisit":
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of one record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key:
            raise ValueError(f"malformed header line {line[:80]!r}")
        fields[key.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing headers {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where {length} were announced")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP headers in the block")
    told = dict(x.lower().split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    size, digest = int(told["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit refers to a record and has no payload")
    return fields | {"payload": payload, "payload_bytes": size, "payload_digest": digest}


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, with the dictionary of its leading skippable frame."""
    head = stream.read(8)
    dictionary = None
    pending = head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        dictionary = zstandard.ZstdCompressionDict(raw) if size else None
        pending = b""
    context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        pending = pending or stream.read(chunk)
        if not pending:
            return
        one, out = context.decompressobj(), []
        while not one.eof:
            if not pending and not (pending := stream.read(chunk)):
                raise ValueError("the last frame is cut short")
            out.append(one.decompress(pending))
            pending = b""
        pending = one.unused_data
        yield b"".join(out)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or the samples' own bytes where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def classify(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``digest`` (hex SHA-1) and ``first``, the id that a row with an equal payload revisits.

    Only digests that occur twice or more are joined, salted, so a payload of many pages is spread."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    twice = (rows.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select("digest", "first", F.lit(True).alias("many"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(twice.hint("shuffle_hash"), ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, revisit_from: int = 0, folder: str | None = None) -> DataFrame:
    """Write every page as a record; the list of files ``(path, records)``."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    sample = sampled(pages.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")), SAMPLE, "page_id", "url")
    dictionary = train_dictionary([r["html"].encode() for r in sample.collect() if r["html"]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        context = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        stem, done, out, path, size, count = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], None, "", 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, first, many = (batch.column(k)[row].as_py() for k in range(6))
                payload = html.encode()
                kind = "revisit" if many and page_id != first else "response"
                if out is None:
                    path, size, count = f"{root}/{stem}-{len(done):04d}.warc.zst", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                frame = context.compress(record(page_id, url, base64.b32encode(bytes.fromhex(digest)).decode(), payload, kind, first))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[1]}" for p, _ in done], pa.string()),
                                          pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    rows = classify(pages, revisit_from).select("page_id", "url", "html", "digest", "first", F.coalesce("many", F.lit(False)))
    return written(rows.mapInArrow(write, "path string, records long"), "warc-files")


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the listed files; ``payload`` adds their bytes (a revisit's are empty)."""
    def number(urn: str | None) -> int | None:
        return None if urn is None or urn == "<urn:page:null>" else int(urn.removeprefix("<urn:page:").removesuffix(">"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for frame in frames(stream):
                        r = parse(frame)
                        size += len(r["payload"]) if payload else 200
                        rows.append((number(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], number(r.get("warc-refers-to")), r["payload_digest"], r["payload_bytes"]) + ((r["payload"],) if payload else ()))
                        if size >= 4 << 20:
                            yield table(rows)
                            rows, size = [], 0
                    yield table(rows)

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payload
    n = max(1, files.count())
    return files.repartition(n).select("path").mapInArrow(read, schema)
