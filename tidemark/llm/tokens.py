"""Token ids of whole text columns with a public tokenizer file of the tokenizers library.

The tokenizer treats each run of letters, each digit and each run of other signs alone.  Runs that are plain (ASCII,
or letters of U+00C0..U+00FF) are cut out by vectorised passes over the text bytes, and each distinct run is encoded
once per worker: its ids are kept in a direct-mapped table of fixed size.  A word with any other character, an
apostrophe or ``<|`` is encoded whole.  Runs are told apart by 64-bit hashes.  Texts of any length are taken whole;
null texts have no ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.common import buffers, held, pieces, span_hashes, word_spans

_SLOTS, _POOL = 1 << 21, 1 << 23
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(48, 58)]] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _SIGN


class Encoder:
    """Encodes byte buffers of documents; one per worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    @staticmethod
    def get(path: str) -> Encoder:
        return held("tokens", path, lambda: Encoder(path))

    def reset(self) -> None:
        self.key = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.size = np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0

    def _runs(self, b: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and plainness of the runs to encode."""
        ws, we = word_spans(b, doc_starts)
        kind = _CLASS[b]
        lead = np.flatnonzero(b[:-1] == 0xC3)
        lead = lead[(b[lead + 1] & 0xC0 == 0x80) & (b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        odd = kind == 0
        odd[np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))] = True
        from_word = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
        hard = from_word[we] > from_word[ws]
        new = np.zeros(len(b) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        level = np.zeros(len(b) + 1, np.int8)  # which bytes lie in words that are cut into runs
        level[ws[~hard]] += 1
        level[we[~hard]] -= 1
        inside = np.cumsum(level, dtype=np.int8)[:-1] > 0
        cuts = np.flatnonzero(new[:-1] & inside)
        starts = np.union1d(cuts, ws)
        word = np.searchsorted(ws, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(b)), we[word])
        return starts, ends, ~hard[word]

    def _encode_new(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and their number for each run."""
        counts = np.zeros(len(starts), np.int64)
        raw = b.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        easy, whole = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
        step = 512
        joined = [" ".join([texts[i] for i in easy[k:k + step]]) for k in range(0, len(easy), step)]
        for k, found in zip(range(0, len(easy), step), self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            last = np.flatnonzero(self.ends[ids]) + 1
            group = easy[k:k + step]
            if len(last) != len(group) or len(last) and last[-1] != len(ids):
                ones = self.tokenizer.encode_batch_fast([texts[i] for i in group], add_special_tokens=False)
                for i, one in zip(group, ones, strict=True):
                    parts[i] = np.array(one.ids, np.int64)
                continue
            for i, lo, hi in zip(group.tolist(), [0, *last[:-1].tolist()], last.tolist(), strict=True):
                parts[i] = ids[lo:hi]
        if len(whole):
            for i, one in zip(whole.tolist(), self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                parts[i] = np.array(one.ids, np.int64)
        counts[:] = [len(p) for p in parts]
        return np.concatenate([np.zeros(0, np.int64), *parts]), counts

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and the index at which each starts (with the total last)."""
        if not len(b):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        starts, ends, plain = self._runs(b, offsets[:-1])
        hashes = span_hashes(b, starts, ends)
        hashes[hashes == 0] = 1
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        at, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        hit = self.key[slot] == hashes
        missed = np.flatnonzero(~hit)
        if len(missed):
            _, first, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            new = missed[first]
            ids, counts = self._encode_new(b, starts[new], ends[new], plain[new])
            if self.used + len(ids) > _POOL and self.used:  # start afresh with this piece
                self.reset()
                return self.encode(b, offsets)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
            self.pool[self.used:self.used + len(ids)] = ids
            places = self.used + np.concatenate([[0], np.cumsum(counts)])[:-1]
            self.used += len(ids)
            at[missed], size[missed] = places[which], counts[which]
        at[hit], size[hit] = self.at[slot[hit]], self.size[slot[hit]]
        if len(missed):
            self.key[slot[new]], self.at[slot[new]], self.size[slot[new]] = hashes[new], places, counts
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return self.pool[source], total[np.searchsorted(starts, offsets)]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: first row, ids, and bounds of the piece's documents in them."""
    encoder = Encoder.get(path)
    b, offsets = buffers(column)
    for i, j in pieces(offsets):
        ids, bounds = encoder.encode(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        yield i, ids, bounds
