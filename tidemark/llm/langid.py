"""Language identification by string kernels.

A text is the set of its character 1- to 3-grams (a blended spectrum of presence bits) over lower-cased code points;
code points beyond ASCII share ``SLOTS - 95`` hashed slots.  The kernel of two texts is the number of shared n-grams
over the root of the product of their set sizes.  Nystroem landmarks are sampled texts; one-versus-rest kernel ridge
regression is solved on a bounded sample of every language that is labelled: about ``PER_LANGUAGE`` texts of each, fewer
(but ``FEW`` or all it has) of each beyond ``LANGUAGES`` languages; ``LANDMARKS`` of them are landmarks, two a language
at least.  Sample and model grow with the number of languages, not with the rows.  Every whole text is scored by batched products
of its presence rows with the landmarks' rows and the coefficients.

Whether a text is in any learned language is told by its letters, not by the score (a text that shares nothing with the
landmarks scores 0.5): the share of letters whose trigram the learned languages know, in words without a digit.  The
least share is ``KNOWN_SHARE`` of the median over the sample, each text measured without its own trigrams; short texts
are given two standard errors.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
Equal scores go to the language first in alphabetical order.  Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chance, held, wide

PER_LANGUAGE, LANGUAGES, LANDMARKS, FEW = 400, 64, 256, 32
KNOWN_SHARE = 0.7
SLOTS = 176
_SIZES = (SLOTS, SLOTS**2, SLOTS**3)
_BLOCK = 64


def _slots() -> np.ndarray:
    """Slot of every code point: printable ASCII has its own, controls are blanks, others are hashed."""
    def make() -> np.ndarray:
        cp = np.arange(0x110000, dtype=np.uint64)
        slot = 95 + ((cp * np.uint64(2654435761)) % np.uint64(2**32) >> np.uint64(12)) % np.uint64(SLOTS - 95)
        slot[:128] = np.clip(np.arange(128), 32, 126) - 32
        slot[:32] = 0
        return slot.astype(np.uint32)

    return held("languages", "slots", make)


def _kinds() -> np.ndarray:
    """Letter, digit and blank flags of every code point."""
    return held("languages", "kinds", lambda: np.frombuffer(bytes(c.isalpha() + 2 * c.isdigit() + 4 * c.isspace() for c in map(chr, range(0x110000))), np.uint8))


def ngrams(text: str) -> np.ndarray:
    """Distinct n-grams of a text, as numbers below ``sum(_SIZES)``, in no order; linear in its length."""
    slots = _slots()
    last = held("languages", "last", lambda: np.zeros(sum(_SIZES), np.int32))
    out = []
    span = 1 << 20
    for begin in range(0, max(len(text), 1), span):  # long texts in overlapping pieces
        c = slots[np.frombuffer(text[begin:begin + span + 2].lower().encode("utf-32-le", "replace"), np.uint32)]
        two = c[:-1] * SLOTS + c[1:]
        three = two[:-1] * SLOTS + c[2:]
        keys = np.concatenate([c, two + _SIZES[0], three + (_SIZES[0] + _SIZES[1])]).astype(np.int64)
        place = np.arange(len(keys), dtype=np.int32)
        last[keys] = place
        out.append(keys[last[keys] == place])
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def letters(text: str) -> np.ndarray:
    """The trigram around every letter, as numbers below ``SLOTS ** 3``; other characters and words with a digit are blanks."""
    slots, kinds = _slots(), _kinds()
    out = [np.zeros(0, np.int32)]
    span = 1 << 20
    for begin in range(0, len(text), span):
        cp = np.frombuffer(text[begin:begin + span].lower().encode("utf-32-le", "replace"), np.uint32)
        kind = kinds[cp]
        word = np.cumsum(kind & 4 > 0)
        numbered = np.zeros(len(cp) + 1, bool)
        numbered[word[kind & 2 > 0]] = True
        c = np.zeros(len(cp) + 2, np.int32)
        c[1:-1] = np.where((kind & 1 > 0) & ~numbered[word], slots[cp], 0)
        out.append(((c[:-2] * SLOTS + c[1:-1]) * SLOTS + c[2:])[c[1:-1] > 0])
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``rows``: presence of each n-gram of the landmarks (n-grams x landmarks), scaled; ``weights``: landmarks x languages;
    ``known``: letter trigrams of the languages; ``least``: share of them below which a text is in none."""
    languages: list[str]
    grams: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    least: float


def _presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Presence rows of some texts over a sorted vocabulary, each divided by the root of its set's size."""
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, grams in zip(out, sets, strict=True):
        if len(grams) and len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
            row[at[vocabulary[at] == grams]] = 1 / np.sqrt(len(grams))
    return out


def _known(found: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Letter trigrams in more than a hundredth of a language's sampled texts, and the least share; ``found``: trigrams of each text and their counts."""
    ways, only = np.zeros(SLOTS**3, np.int32), []
    for k in range(target.max() + 1):
        own = [found[i][0] for i in np.flatnonzero(target == k)]
        grams, texts = np.unique(np.concatenate(own), return_counts=True)
        need = 1 + len(own) // 100
        ways[grams[texts >= need]] += 1
        only.append(grams[texts == need])  # not known without one of these texts
    shares, lost = [], np.zeros(SLOTS**3, bool)
    for k, edge in enumerate(only):
        lost[edge] = True
        shares += [counts[ways[grams] > lost[grams]].sum() / counts.sum() for grams, counts in (found[i] for i in np.flatnonzero(target == k)) if len(grams)]
        lost[edge] = False
    return np.flatnonzero(ways).astype(np.int32), KNOWN_SHARE * float(np.median(shares)) if shares else 0.0


def learn(docs: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", label: str = "lang", ridge: float = 1e-3,
          per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on a sample of the ``usable`` labelled rows, chosen by a hash of id and text."""
    rows = (docs.where(usable & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
                .select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(id_column).alias("id")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("id", "text")).alias("n")).collect()}
    if not counts:
        return None
    each = min(per_language, max(FEW, per_language * LANGUAGES // len(counts)))
    large = [F.lit(x) for name, n in sorted(counts.items()) if n > each for x in (name, each / n)]
    share = F.coalesce(F.create_map(*large)[F.col("label")], F.lit(1.0)) if large else F.lit(1.0)
    chosen = rows.where(chance("id", "text") < share).distinct()  # repeated rows are chosen together

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(ngrams(t).astype(np.int32).tobytes(), n, *(x.astype(np.int32).tobytes() for x in np.unique(letters(t), return_counts=True)))
                     for t, n in zip(texts, names, strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.string(), pa.binary(), pa.binary()))],
                                             ["grams", "label", "letters", "times"])

    sample = sorted(((r["label"], bytes(r["grams"]), bytes(r["letters"]), bytes(r["times"]))
                     for r in chosen.mapInArrow(sets, "grams binary, label string, letters binary, times binary").collect()),
                    key=lambda x: (x[0], x[1][-32:], *x[1:]))
    languages = sorted({x[0] for x in sample})
    if not languages:
        return None
    grams = [np.sort(np.frombuffer(x[1], np.int32).astype(np.int64)) for x in sample]
    target = np.array([languages.index(x[0]) for x in sample])
    known, least = _known([(np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.int32)) for x in sample], target)
    each = max(2, landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(target == k)[:each] for k in range(len(languages))])
    vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
    landmark_rows = _presence([grams[i] for i in marks], vocabulary)
    kernel = np.concatenate([_presence(grams[i:i + _BLOCK], vocabulary) @ landmark_rows.T for i in range(0, len(grams), _BLOCK)]).astype(np.float64)
    among = kernel[marks]
    goal = np.where(target[:, None] == np.arange(len(languages)), 1.0, -1.0)
    left = kernel.T @ kernel + ridge * len(grams) * (among + among.T) / 2 + 1e-6 * len(grams) * np.eye(len(marks))
    weights = np.linalg.solve(left, kernel.T @ goal)
    return Model(languages, vocabulary, np.ascontiguousarray(landmark_rows.T), weights.astype(np.float32), known, least)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", reject: bool = False) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (0 to 1) for every row; with ``reject``, texts in none of the languages learned
    are ``und`` with score 0 too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = None
        if m is not None:
            table = np.full(sum(_SIZES), -1, np.int32)
            table[m.grams] = np.arange(len(m.grams))
            known = np.zeros(SLOTS**3, bool)
            known[m.known] = True
        for batch in batches:
            column = batch.column(0)
            names, scores = ["und"] * len(column), np.zeros(len(column))
            for i in range(0, len(column) if m is not None else 0, _BLOCK):
                texts = column.slice(i, _BLOCK).to_pylist()
                present = np.zeros((len(texts), len(m.grams)), np.float32)
                told = []
                for k, t in enumerate(texts):
                    if has_letter(t):
                        if reject and len(own := letters(t)) and known[own].mean() + 2 * np.sqrt(m.least * (1 - m.least) / len(own)) < m.least:
                            continue
                        grams = ngrams(t)
                        at = table[grams]
                        present[k, at[at >= 0]] = 1 / np.sqrt(len(grams))
                        told.append(k)
                values = (present @ m.rows) @ m.weights
                best = values.argmax(axis=1)
                for k in told:
                    names[i + k] = m.languages[best[k]]
                    scores[i + k] = min(1.0, max(0.0, (float(values[k, best[k]]) + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return wide(docs.select(F.col(text).alias("text_"), *keep)).mapInArrow(score, schema)
