"""Removal of repeated byte strings by winnowed fingerprints: hashes at sampled positions, in place of prefix doubling.

A byte goes if a string of ``threshold`` bytes that covers it also starts anywhere else.  Doubling ranks of every byte
position would shuffle each byte many times, so it runs over positions sampled by content: each start ``p`` of a
``threshold``-byte string belongs to its anchor, the position of the smallest hash of ``w`` bytes among the ``w`` first
ones (``w`` the largest power of two up to a third of the threshold).  Equal strings have their anchors at the same
place, so nothing is missed.

Ranks of anchors grow from ``2 w`` bytes (inside every string of the anchor) to the whole stretch that the strings of the
anchor cover; Spark sorts and groups (position, rank) pairs, and anchors whose rank is unique drop out.  Ranks are named
by hashes.  The first round, at ``2 w`` bytes, drops what a fixed-size count table shows to be unique; the rest are
ranked by the pair of the names of ``2 w`` bytes and of the stretch.  A stretch that
occurs twice is repeated altogether.  Where a stretch is unique although its ``2 w`` bytes are not - the ends of
repeated passages - the last doubling to ``threshold`` ranks each of its positions.

With ``words``, runs of so many words that start anywhere else go too, whatever their length in bytes and the blanks in
between: each text becomes the ``WORD`` byte hashes of its words, the same search runs over these, and of what it finds
only whole words count.

Null texts are empty; texts shorter than the threshold lose nothing.  Repeated rows are occurrences of their own, so
they remove each other.  Texts of any length are worked through in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import PIECE, buffers, enter, mix, pieces, powers, prefix_hash, span_hashes, wide, word_spans, written
from tidemark.llm.sketch import BITS, count_levels, level_of

KEY_BITS = 24
WORD = 4
_PLACE = np.uint64((1 << 24) - 1)


def window(threshold: int) -> int:
    return 1 << max(0, ((threshold + 1) // 3).bit_length() - 1)


class Strings:
    """Hashes of substrings of a buffer."""

    def __init__(self, b: np.ndarray):
        self.h, self.inverse = prefix_hash(b), powers(len(b) + 1)[1]

    def __call__(self, starts: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.h[starts + size] - self.h[starts]) * self.inverse[starts])


def anchors(b: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Anchors in a buffer of documents: place, first and last start of their strings, and hashes of 2 w bytes and the stretch."""
    w, n = window(threshold), len(b)
    starts, stops = offsets[:-1], np.maximum(offsets[1:] - threshold + 1, offsets[:-1])
    if not (stops > starts).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    of = Strings(b)
    place = np.arange(n - w + 1)
    key = (of(place, w) & ~_PLACE) | place.astype(np.uint64)  # the leftmost of the smallest
    step = 1
    while step < w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    level = np.zeros(n + 1, np.int32)
    np.add.at(level, starts, 1)
    np.add.at(level, stops, -1)
    p = np.flatnonzero(np.cumsum(level)[:len(key)] > 0)
    at = (key[p] & _PLACE).astype(np.int64)
    first = np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
    cut = np.flatnonzero(first)
    lo, hi, a = p[cut], p[np.append(cut[1:], len(p)) - 1], at[cut]
    return a, lo, hi, of(a, 2 * w), of(lo, hi - lo + threshold)


def scanned(column: pa.Array, threshold: int) -> Iterator[tuple]:
    """Anchors of a text column by piece: document number, place, first and last start in the document, and the two hashes."""
    b, offsets = buffers(column)
    for i, j in pieces(offsets):
        size = int(offsets[j] - offsets[i])
        for begin in range(0, size if j == i + 1 else 1, PIECE):  # a long text in stretches of starts
            part = b[offsets[i] + begin:min(offsets[j], offsets[i] + begin + PIECE + threshold - 1)] if j == i + 1 else b[offsets[i]:offsets[j]]
            own = np.array([0, len(part)]) if j == i + 1 else offsets[i:j + 1] - offsets[i]
            a, lo, hi, *names = anchors(part, own, threshold)
            doc = np.searchsorted(own, lo, side="right") - 1
            base = own[doc] - (begin if j == i + 1 else 0)
            yield (doc + i, a - base, lo - base, hi - base, *names)


def repeated_spans(docs: DataFrame, threshold: int, bits: int = BITS) -> DataFrame:
    """``docs(key, text)`` -> ``(key, start, end)``: byte ranges ``[start, end)`` to remove (they may overlap)."""
    w = window(threshold)
    docs = wide(docs.where(F.octet_length("text") >= threshold))

    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, _, core, _ in scanned(batch.column(1), threshold):
            yield mix(core)

    levels = docs.sparkSession.sparkContext.broadcast(count_levels(docs, items, bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, a, lo, hi, core, whole in scanned(batch.column(1), threshold):
                keep = np.flatnonzero(level_of(levels.value, mix(core)) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[keep])), pa.array(a[keep]), pa.array(((a - lo) << 32 | a - hi)[keep]),
                                                  pa.array(core[keep].view(np.int64)), pa.array(whole[keep].view(np.int64))], ["key", "a", "reach", "core", "whole"])

    found = written(docs.mapInArrow(rows, "key long, a long, reach long, core long, whole long"), "anchors")
    levels.destroy()
    before, after = F.shiftright("reach", 32), -F.col("reach").bitwiseAND(F.lit((1 << 32) - 1))  # from the anchor to the first and last start
    rank = ["core", "whole", "reach"]
    classes = written(found.groupBy(*rank).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a")).alias("one")), "stretches")
    # only anchors whose stretch may be one that occurs once meet the classes again; the others are repeated
    singles = classes.where("n = 1")
    one_by_one = found.select(F.xxhash64(*rank).alias("key"), F.col("key").alias("doc"), "a", *rank)
    some, others = among(one_by_one, singles.select(F.xxhash64(*rank).alias("key")), bits)
    decided = (some.join(singles.select(*rank), rank, "left_anti").select(*others.columns).union(others)
               .select(F.col("doc").alias("key"), (F.col("a") - before).alias("start"), (F.col("a") + after + threshold).alias("end")))
    near = among(classes.withColumnRenamed("core", "key"), singles.select("core"), bits)[0].withColumnRenamed("key", "core")
    mixed = (near.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("singles"))
                 .where("kinds > 1 AND singles > 0").select("core"))
    open_ = near.join(mixed, "core").select("one.key", F.struct(F.col("one.a").alias("a"), before.alias("before"), after.alias("after"), "core", (F.col("n") == 1).alias("single")).alias("x"))
    by_doc = written(open_.groupBy("key").agg(F.collect_list("x").alias("open")), "open")
    positions = written(rank_positions(among(docs, by_doc.select("key"), bits)[0].dropDuplicates(["key"]).join(by_doc, "key"), threshold), "positions")
    last = repeated_positions(positions, bits)
    return decided.union(last.select("key", F.col("p").alias("start"), (F.col("p") + threshold).alias("end")))


def merged(lists: DataFrame) -> DataFrame:
    """``(key, lists of ranges [start, end)...)`` with the ranges of a list that overlap made one."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0)]
            for column in batch.columns[1:]:
                doc, flat = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())), column.flatten()
                start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(2))
                order = np.lexsort((start, doc))
                doc, start, end = doc[order], start[order], end[order]
                size = int(end.max(initial=0)) + 1
                reach = np.maximum.accumulate(end + doc * size)
                first = np.flatnonzero(np.concatenate([[True], start[1:] + doc[1:] * size >= reach[:-1]])[:len(doc)])
                ends = np.maximum.reduceat(end, first) if len(first) else end
                offsets = np.searchsorted(doc[first], np.arange(batch.num_rows + 1))
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(start[first]), pa.array(ends)], ["start", "end"])))
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return lists.mapInArrow(rows, lists.schema)


def word_names(docs: DataFrame) -> DataFrame:
    """``docs(key, text)`` with the hashes of the words, ``WORD`` bytes each, in place of the text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets):
                part, own = b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                starts, ends = word_spans(part, own[:-1])
                names = (span_hashes(part, starts, ends) >> np.uint64(32)).astype(np.uint32)
                cuts = np.searchsorted(starts, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([names[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["key", "text"])

    return wide(docs).mapInArrow(rows, "key long, text binary")


def among(docs: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs(key, ...)`` whose key may be among ``keys``, and those whose key surely is not, by a table of fixed size."""
    def twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        one = mix(batch.column(0).to_numpy().view(np.uint64).copy())
        yield np.concatenate([one, one])

    levels = docs.sparkSession.sparkContext.broadcast(count_levels(keys, twice, min(bits, KEY_BITS)))
    at = docs.columns.index("key")

    def part(inside: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = level_of(levels.value, mix(batch.column(at).to_numpy().view(np.uint64).copy())) > 0
                yield batch.filter(pa.array(may == inside))
        return docs.mapInArrow(keep, docs.schema)

    return part(True), part(False)


def rank_positions(joined: DataFrame, threshold: int) -> DataFrame:
    """``(key, text, open)`` -> one row a document: starts ``p`` of its open stretches, their rank at the threshold, and whether they are undecided."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ranks")
        for batch in batches:
            texts, marks = batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                b, _ = buffers(texts.slice(k, 1))
                m = marks[k].values
                a, before, after, core, single = (m.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5))
                order = np.argsort(a, kind="stable")
                p, names, flags = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
                i = 0
                while i < len(order):  # anchors close enough to share a buffer
                    base = a[order[i]] - before[order[i]]
                    j = i
                    while j < len(order) and a[order[j]] + after[order[j]] - base < PIECE:
                        j += 1
                    use = order[i:max(j, i + 1)]
                    counts = before[use] + after[use] + 1
                    own = np.repeat(a[use] - before[use] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    of = Strings(b[base:int(own.max()) + threshold])
                    with np.errstate(over="ignore"):
                        names.append(mix(of(own - base, threshold) + np.repeat(core[use], counts).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    p.append(own)
                    flags.append(np.repeat(single[use] > 0, counts))
                    i = max(j, i + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([np.concatenate(p)], pa.list_(pa.int64())),
                                                  pa.array([np.concatenate(names).view(np.int64)], pa.list_(pa.int64())), pa.array([np.concatenate(flags)], pa.list_(pa.bool_()))],
                                                 ["key", "p", "name", "single"])

    return joined.select("key", "text", "open").mapInArrow(rows, "key long, p array<long>, name array<long>, single array<boolean>")


def repeated_positions(positions: DataFrame, bits: int) -> DataFrame:
    """``(key, p)`` of the undecided starts whose rank is not unique."""
    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).flatten().to_numpy().view(np.uint64)

    levels = positions.sparkSession.sparkContext.broadcast(count_levels(positions.select("name"), items, bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(2).flatten().to_numpy()
            keep = np.flatnonzero(level_of(levels.value, names.view(np.uint64)) > 0)
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[keep])), batch.column(1).flatten().take(pa.array(keep)), pa.array(names[keep]),
                                              batch.column(3).flatten().take(pa.array(keep))], ["key", "p", "name", "single"])

    left = positions.mapInArrow(rows, "key long, p long, name long, single boolean")
    twice = written(left.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "ranks-last")
    return left.where("single").join(twice, "name").select("key", "p")


def remove_repeats(docs: DataFrame, threshold: int = 400, id_column: str = "doc_id", text: str = "text", columns: list[str] | None = None,
                   kept: bool = False, bits: int = BITS, words: int | None = None) -> DataFrame:
    """For every row its ``columns`` (the id by default), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``; with ``kept`` the
    remaining bytes as text (a character cut in two is left out).  ``words``: repeated runs of so many words are removed as well."""
    names, measures = [id_column] if columns is None else columns, MEASURES[:4 + kept]
    key = F.xxhash64(F.col(id_column).cast("string"), text).alias("key")
    texts = docs.select(key, F.col(text).alias("text"))
    spans = repeated_spans(texts, threshold, bits).withColumn("list", F.lit("spans"))
    if words:
        runs = repeated_spans(word_names(texts), words * WORD, bits)  # of these the whole words
        runs = runs.select("key", F.ceil(F.col("start") / WORD).alias("start"), F.floor(F.col("end") / WORD).alias("end"), F.lit("runs").alias("list"))
        spans = spans.union(runs.where(F.col("end") - F.col("start") >= words))
    marks = ["spans", "runs"] if words else ["spans"]
    lists = [F.collect_list(F.when(F.col("list") == c, F.struct("start", "end"))).alias(c) for c in marks]
    spans = written(merged(spans.groupBy("key").agg(*lists)), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("cut")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                b, _ = buffers(batch.column(0).slice(k, 1))
                level = np.zeros(len(b) + 1, np.int32)
                if batch.column(1)[k].is_valid:
                    m = batch.column(1)[k].values
                    np.add.at(level, m.field(0).to_numpy(), 1)
                    np.add.at(level, m.field(1).to_numpy(), -1)
                if words and batch.column(2)[k].is_valid:
                    m = batch.column(2)[k].values
                    starts, ends = word_spans(b, np.zeros(1, np.int64))
                    np.add.at(level, starts[m.field(0).to_numpy()], 1)
                    np.add.at(level, ends[m.field(1).to_numpy() - 1], -1)
                gone = np.cumsum(level)[:len(b)] > 0
                left = b[~gone].tobytes()
                edges = np.diff(gone.astype(np.int8), prepend=0)
                for c, v in zip(out, (len(b), int(gone.sum()), int((edges > 0).sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if kept else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[:4 + kept]
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(1 + len(marks)), *arrays], ["rest_", *measures])

    rows = docs.select(key, F.col(text).alias("text_"), F.struct(*names).alias("rest_"))
    fields = [T.StructField(c, T.StringType() if c.startswith("kept") else T.LongType()) for c in measures]
    some, none = among(rows, spans.select("key"), bits)
    unmarked = [F.lit(None).cast(spans.schema["spans"].dataType).alias(c) for c in marks]
    marked = some.join(spans, "key", "left").select("text_", *marks, "rest_").unionByName(none.select("text_", *unmarked, "rest_"))
    cleaned = marked.mapInArrow(cut, T.StructType([rows.schema["rest_"], *fields]))
    return cleaned.select(*[F.col("rest_")[c].alias(c) for c in names], *measures)


MEASURES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
