"""Periodic runs of words, found online by dyadic square catching.

The words of a text are appended to ``Catchers``.  When two blocks of ``m = 2 ** k`` words, the first at a multiple of ``m``,
are complete, a catcher starts on the ``2 m`` words from there: each appended word moves on the suffix that is compared with
them, and the first suffix equal to them at a distance ``p`` in ``m .. 2 m - 1`` reports the squares of period ``p`` from the
block on.  Squares of one period that overlap are one run, which is stretched to both sides while words repeat at its period
and grows on with later words.  Suffixes are compared by hashes of 64 bits built from halves (``2 m`` words from two of ``m``),
so a word costs a few steps a level; all words of an append go through a level together in array passes.

Why nothing is missed: a run of smallest period ``q``, ``m <= q < 2 m``, and at least ``4 q`` words holds a block that starts in its
first ``m`` words, with the block's ``2 m >= q + 1`` words and their next copy, ``q`` later.  An earlier equal suffix would lie in
the run and shift it by less than its primitive period, which is impossible, so the first one reported is ``q``.  A square that lies in a
known run of smaller period has a multiple of that period and is left out; by the same argument such a run is known by then.  (Inside a
run of a period less than ``2 m`` the span of more than two of its own periods has their common divisor as a period, so the check needs no
comparison of the two periods.)

Words are ``[^ \\t-\\r]+`` and compared exactly (dictionary codes); a run is compared word by word as it is stretched.  Null and empty
texts have no runs and collapse to the empty string.  Repeated rows, null ids and ties are worked through row by row; runs are ordered by
start, then period.  Memory is bounded by the longest text (about 100 bytes a word) or a piece of 1 MB of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import buffers, mix, pieces, wide, word_spans

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_LEFT = np.uint64(0x9E3779B97F4A7C15)


class Catchers:
    """Runs of the words appended so far; words are whole numbers."""

    def __init__(self):
        self.words = np.zeros(0, np.int64)
        self.tails: list[np.ndarray] = []     # by level: hashes of 2^k words that later words still complete to 2^(k+1)
        self.known: list[int] = []            # by level: number of windows of 2^(k+1) words hashed so far
        self.anchors: list[dict[int, int]] = []  # by level: hash of the window at the last two blocks
        self.fired: list[int] = []            # by level: last block that has reported
        self.runs = np.zeros((0, 3), np.int64)  # start, end, period

    def append(self, words: np.ndarray) -> None:
        """Add words at the end."""
        before = len(self.words)
        self.words = np.concatenate([self.words, words])
        for r in np.flatnonzero(self.runs[:, 1] == before):
            self.runs[r, 1] = self._right(before, self.runs[r, 2])
        with np.errstate(over="ignore"):
            fresh, level = mix(words.astype(np.uint64) * _LEFT + np.uint64(1)), 0
            while len(fresh):
                if level == len(self.tails):
                    self.tails.append(np.zeros(0, np.uint64))
                    self.known.append(0)
                    self.anchors.append({})
                    self.fired.append(-1)
                m, both = 1 << level, np.concatenate([self.tails[level], fresh])
                fresh = mix(both[:-m] * _LEFT + both[m:]) if len(both) > m else both[:0]
                self.tails[level] = both[-m:]
                self._catch(level, fresh)
                self.known[level] += len(fresh)
                level += 1

    def _catch(self, level: int, fresh: np.ndarray) -> None:
        """Compare new windows of ``2 m`` words, from window ``known`` on, with the catchers of the blocks before."""
        m, at = 1 << level, self.known[level]
        if not len(fresh):
            return
        anchors = self.anchors[level]
        heads = np.arange(-(-at // m) * m, at + len(fresh), m)  # blocks whose window is new
        first = max(at // m - 1, 0)
        values = np.zeros((at + len(fresh) - 1) // m + 1 - first, np.uint64)
        for block in (first, first + 1):
            if block in anchors and block - first < len(values):
                values[block - first] = anchors[block]
        values[heads // m - first] = fresh[heads - at]
        start = max(at, m)  # windows before the second block have no catcher
        if start < at + len(fresh):
            lo, hi = start // m, (at + len(fresh) - 1) // m
            against = np.repeat(values[lo - 1 - first:hi - first], m)[start - lo * m:start - lo * m + at + len(fresh) - start]
            hits = np.flatnonzero(fresh[start - at:] == against) + start
            if len(hits):
                self._report(level, hits)
        last = (at + len(fresh) - 1) // m
        anchors.clear()
        anchors.update({block: values[block - first] for block in (last - 1, last) if block >= first})

    def _report(self, level: int, hits: np.ndarray) -> None:
        """First hit of each block: spans of squares; those outside known runs become runs."""
        m = 1 << level
        blocks, which = np.unique(hits // m - 1, return_index=True)
        new = blocks > self.fired[level]
        self.fired[level] = max(self.fired[level], int(blocks[-1]))
        starts = blocks[new] * m
        periods = hits[which[new]] - starts
        ends = starts + periods + 2 * m
        fresh = {(self._left(s, p), self._right(e, p), p) for s, e, p in self._merged(*self._outside(starts, ends, periods, 2 * m))}
        if fresh:
            self.runs = np.concatenate([self.runs, np.array(sorted(fresh), np.int64)])

    def _outside(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray, below: int) -> tuple[np.ndarray, ...]:
        """Spans that lie in no known run of a period less than ``below``."""
        runs = self.runs[self.runs[:, 2] < below]
        if not len(runs) or not len(starts):
            return starts, ends, periods
        order = np.argsort(runs[:, 0], kind="stable")
        reach = np.maximum.accumulate(runs[order, 1])
        at = np.searchsorted(runs[order, 0], starts, side="right") - 1
        free = (at < 0) | (reach[np.maximum(at, 0)] < ends)
        return starts[free], ends[free], periods[free]

    @staticmethod
    def _merged(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Spans of one period that share a period's length of words, merged."""
        order = np.lexsort((starts, periods))
        s, e, p = starts[order], ends[order], periods[order]
        opens = np.ones(len(s), bool)
        opens[1:] = (p[1:] != p[:-1]) | (s[1:] + p[1:] > e[:-1])
        heads = np.flatnonzero(opens)
        lasts = np.append(heads[1:], len(s))[:len(heads)] - 1
        return zip(s[heads].tolist(), e[lasts].tolist(), p[heads].tolist(), strict=True)

    def _right(self, end: int, p: int) -> int:
        """The first place from ``end`` on whose word differs from that ``p`` before."""
        w, n, step = self.words, len(self.words), 8
        while end < n:
            stop = min(n, end + step)
            differs = w[end:stop] != w[end - p:stop - p]
            if differs.any():
                return end + int(differs.argmax())
            end, step = stop, step * 2
        return end

    def _left(self, start: int, p: int) -> int:
        w, step = self.words, 8
        while start > 0:
            stop = max(0, start - step)
            differs = (w[stop:start] != w[stop + p:start + p])[::-1]
            if differs.any():
                return start - int(differs.argmax())
            start, step = stop, step * 2
        return start

    def found(self, least_words: int, least_exponent: int) -> np.ndarray:
        """Runs ``start, end, period`` of at least so many words and periods, by start, then period."""
        length = self.runs[:, 1] - self.runs[:, 0]
        kept = self.runs[length >= np.maximum(least_words, least_exponent * self.runs[:, 2])]
        return kept[np.lexsort((kept[:, 2], kept[:, 0]))]


def codes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal where the words are: codes of an Arrow dictionary."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = ends - starts
    inside = np.zeros(len(b) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = b[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def joined(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the words of each document, joined by one space."""
    lengths = ends - starts + 1
    size = np.bincount(doc, lengths, n).astype(np.int64)
    out = np.concatenate([[0], np.cumsum(lengths)])
    data = np.append(b, np.uint8(32))[np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])]
    data[out[1:] - 1] = 32
    offsets = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(data), bool)
    keep[offsets[1:][size > 0] - 1] = False  # the space after each document's last word
    return data[keep], np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])


def _piece(b: np.ndarray, offsets: np.ndarray, least_words: int, least_exponent: int):
    """Of whole documents: numbers of words and runs, all runs, bytes and offsets of the collapsed texts."""
    n = len(offsets) - 1
    starts, ends = word_spans(b, offsets[:-1])
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(n), counts)
    stream = np.empty(len(starts) + n, np.int64)
    place = np.arange(len(starts)) + doc
    stream[place] = codes(b, starts, ends)
    stream[bounds[1:] + np.arange(n)] = -1 - np.arange(n)  # after each document a word of its own: no run crosses it
    catchers = Catchers()
    catchers.append(stream)
    runs = catchers.found(least_words, least_exponent)
    change = np.zeros(len(stream) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = (np.cumsum(change[:-1]) == 0)[place]
    first = bounds[:-1] + np.arange(n)
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    shown = np.stack([runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1) if len(runs) else runs
    return counts, np.bincount(owner, minlength=n), shown, *joined(b, starts[kept], ends[kept], doc[kept], n)


def periodic_runs(docs: DataFrame, columns: list[str], text: str = "text", least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """``columns`` of every row, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text: of each run only the first period.

    ``least_exponent`` is 4 or more: shorter repetitions may be missed.
    """
    if least_exponent < 4:
        raise ValueError("runs of fewer than four periods are not all caught")
    kept = [c for c in columns if c not in ("n_words", "runs", "collapsed")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = buffers(batch.column(len(kept)))
            for i, j in pieces(offsets):
                words, counts, runs, data, ends = _piece(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], least_words, least_exponent)
                parts = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"])
                texts = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(kept))], pa.array(words, pa.int64()), lists,
                                                  texts.cast(pa.string())], [*kept, "n_words", "runs", "collapsed"])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_words", T.LongType())])
    schema.add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])))
    schema.add("collapsed", T.StringType())
    return wide(docs.select(*kept, text)).mapInArrow(find, schema)
