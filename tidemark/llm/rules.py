"""Quality rules as a short-circuit cascade.

Each rule rejects documents by measures of the whole text.  Its cost and selectivity are estimated on a bounded
sample (about ``SAMPLE`` documents, by a hash of their id and text), rules are ordered by rejections per second, and every document
meets them in that order until one rejects it.  The order changes the work, never the verdict.

Null and empty texts have no words and fail the base rules.  Repeated rows, ties and null ids are judged row by row.
Words are ``[^ \\t-\\r]+``; lines are separated by ``\\n``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import buffers, mix, pieces, sampled, span_hashes, wide, word_spans

SAMPLE = 512
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_LETTER = np.array([chr(c).isalpha() or c >= 128 for c in range(128)] + [True] * 128)
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_ASCII = _UPPER | np.isin(np.arange(256), np.arange(97, 123))


class Texts:
    """Some whole documents as bytes, with their words; what the rules share is computed once, when first asked for."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        self.b, self.offsets, self.n = b, offsets, len(offsets) - 1
        self.starts, self.ends = word_spans(b, offsets[:-1])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self.hashes = span_hashes(b, self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document's bytes."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def keyed(self, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def word_chars(self) -> np.ndarray:
        points = np.concatenate([[0], np.cumsum((self.b & 0xC0) != 0x80, dtype=np.int64)])
        return np.bincount(self.doc, points[self.ends] - points[self.starts], self.n).astype(np.int64)

    def symbols(self) -> np.ndarray:
        return self.per_doc(_SYMBOL[self.b])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word of each document, and how many of them equal an earlier one."""
        breaks = np.flatnonzero(self.b == 10)
        edges = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = edges[edges < len(self.b)]
        ends = np.append(starts[1:], len(self.b))
        ends = np.where((ends > starts) & (self.b[ends - 1] == 10), ends - 1, ends)
        has = np.searchsorted(self.starts, starts) < np.searchsorted(self.starts, ends)
        starts, ends = starts[has], ends[has]
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        _, first = np.unique(self.keyed(span_hashes(self.b, starts, ends), doc), return_index=True)
        count = np.bincount(doc, minlength=self.n)
        return count, count - np.bincount(doc[first], minlength=self.n)

    def repeated(self, size: int = 3) -> np.ndarray:
        """Words inside ``size``-word windows that occur twice or more in their document."""
        m = len(self.hashes) - size + 1
        if m < 1:
            return np.zeros(self.n, np.int64)
        with np.errstate(over="ignore"):
            key = np.full(m, 7, np.uint64)
            for k in range(size):
                key = mix(key + self.hashes[k:k + m])
        inside = np.flatnonzero(self.doc[:m] == self.doc[size - 1:])
        _, which, counts = np.unique(self.keyed(key[inside], self.doc[inside]), return_inverse=True, return_counts=True)
        covered = np.zeros(len(self.hashes), bool)
        for k in range(size):
            covered[inside[counts[which] > 1] + k] = True
        return np.bincount(self.doc[covered], minlength=self.n)

    def take(self, rows: np.ndarray) -> Texts:
        """The documents ``rows`` alone."""
        if len(rows) == self.n:
            return self
        parts = [self.b[self.offsets[r]:self.offsets[r + 1]] for r in rows]
        lengths = np.array([len(p) for p in parts], np.int64)
        return Texts(np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(lengths)]))


@dataclass(frozen=True)
class Rule:
    """``rejects(texts)`` gives a flag per document."""
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _upper(t: Texts) -> np.ndarray:
    return 2 * t.per_doc(_UPPER[t.b]) > t.per_doc(_ASCII[t.b])


def _lettered(t: Texts) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_LETTER[t.b], dtype=np.int64)])
    with_letter = np.bincount(t.doc[letters[t.ends] > letters[t.starts]], minlength=t.n)
    return 10 * with_letter < 6 * t.n_words


def _word_length(t: Texts) -> np.ndarray:
    chars = t.word_chars()
    return (chars < 2 * t.n_words) | (chars > 16 * t.n_words)


def _duplicate_lines(t: Texts) -> np.ndarray:
    lines, again = t.lines()
    return 2 * again > lines


def _vocabulary(t: Texts) -> np.ndarray:
    """Long documents of few different words; the bound falls with length, as it does in prose."""
    _, first = np.unique(t.keyed(t.hashes, t.doc), return_index=True)
    different = np.bincount(t.doc[first], minlength=t.n)
    return different < np.minimum(t.n_words * 0.15, 2 * np.sqrt(t.n_words))


def _commonest_word(t: Texts) -> np.ndarray:
    keys, first, counts = np.unique(t.keyed(t.hashes, t.doc), return_index=True, return_counts=True)
    most = np.zeros(t.n, np.int64)
    np.maximum.at(most, t.doc[first], counts)
    return 5 * most > 2 * t.n_words


# The rules of the verdict and their bounds.
RULES = (
    Rule("symbols", lambda t: 10 * t.symbols() > t.n_words),
    Rule("upper case", _upper),
    Rule("words with a letter", _lettered),
    Rule("word length", _word_length),
    Rule("duplicate lines", _duplicate_lines),
    Rule("vocabulary", _vocabulary),
    Rule("commonest word", _commonest_word),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[int]:
    """Rules by rejections per second on about ``sample`` documents (only rule totals return)."""
    rows = sampled(docs.where(F.length(text) > 0), sample, id_column, text).select(F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected = np.full(len(rules), 1e-9), np.zeros(len(rules), np.int64)
        for batch in batches:
            b, offsets = buffers(batch.column(0))
            for i, j in pieces(offsets):
                texts = Texts(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += int(rule.rejects(texts).sum())
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(rejected)], ["rule", "cost", "rejected"])

    found = rows.mapInArrow(measure, "rule int, cost double, rejected long").groupBy("rule").agg(F.sum("cost").alias("c"), F.sum("rejected").alias("r"))
    rate = {r["rule"]: ((r["r"] + 0.5) / r["c"]) for r in found.collect()}  # one row a rule
    return sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
            order: list[int] | None = None) -> DataFrame:
    """Per document: its id, the base measures, ``base_failed`` and ``kept``."""
    order = cascade_order(docs, rules, id_column, text) if order is None else order

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = buffers(batch.column(1))
            columns: list[list[np.ndarray]] = [[] for _ in range(len(OUT) + 2)]
            for i, j in pieces(offsets):
                texts = Texts(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                repeat = texts.repeated()
                failed = (texts.n_words < 50) | (100 * repeat > 50 * texts.n_words)
                kept, left = ~failed, texts
                alive = within = np.flatnonzero(kept)
                for k in order:
                    if not len(alive):
                        break
                    bad = rules[k].rejects(left := left.take(within))
                    kept[alive[bad]] = False
                    within = np.flatnonzero(~bad)
                    alive = alive[within]
                for c, v in zip(columns, (texts.n_words, texts.word_chars(), texts.symbols(), texts.lines()[1], repeat, failed, kept), strict=True):
                    c.append(v)
            flat = [np.concatenate([*c, np.zeros(0, bool if k >= len(OUT) else np.int64)]) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.bool_() if k >= len(OUT) else pa.int64()) for k, v in enumerate(flat)]],
                                             [id_column, *OUT, "base_failed", "kept"])

    schema = T.StructType([docs.schema[id_column], *[T.StructField(c, T.LongType()) for c in OUT],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return wide(docs.select(id_column, text)).mapInArrow(judge, schema)
