"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into pieces of the model's vocabulary whose scores add up to the most (the unigram reading of a model
file; ties: at every end the piece that starts first).  Spaces become U+2581, one is put in front, and a character
without a piece is written as its UTF-8 bytes.

Texts of up to ``GIANT`` characters are encoded whole; as no piece holds a space after its first characters, each
distinct stretch between spaces is solved once per worker.  Giant texts are split into chunks.  A boundary state is how
far the last piece of a chunk reaches into the next one; each chunk yields its matrix of best scores from state to
state, matrices are combined associatively (max-plus products, by doubling), which gives every chunk the scores of its
entry states, and then each chunk is traced back by itself for all states it may be left in; the chain of states picks
among these.  The result equals a single pass over the whole text.

Null and empty texts have no ids.  Decoding gives the text back, except that U+2581 becomes a space.  Rows are told
apart by a row number of their own, so null and repeated ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import PIECE, buffers, held, pieces, wide, written
from tidemark.llm.tokens import Encoder

GIANT, CHUNK = 1 << 16, 1 << 14
MARK = "▁"
NEVER = -1e300
#: Bytes of stretches that are solved together.
BLOCK, LONG = 1 << 16, 256
_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.text: list[bytes] = []
        self.bytes = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = (i, lib.get_score(i))
                self.text.append(piece.replace(MARK, " ").encode())
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for _, s in self.ids.values()) - 10.0
        self.heads = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # the same by hashes of code points, sorted: id of the piece, or -1 for a mere head
        hashed = {}
        for piece in self.heads:
            h = 0
            for c in piece:
                h = (h * _BASE + ord(c)) & _ALL
            hashed[h] = self.ids[piece][0] if piece in self.ids else -1
        self.head_hash = np.array(sorted(hashed), np.uint64)
        self.head_id = np.array([hashed[int(h)] for h in self.head_hash], np.int32)
        self.scores = np.full(len(self.text) + 1, self.unknown)
        for i, score in self.ids.values():
            self.scores[i] = score

    @staticmethod
    def get(path: str) -> Model:
        return held("pieces", path, lambda: Model(path))

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces of some rows, without the space in front of each row, and the offsets of the rows."""
        size = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.pool[np.repeat(self.places[ids] - total[:-1], size) + np.arange(total[-1])]
        ends = total[bounds]
        full = np.diff(ends) > 0
        keep = np.ones(len(data), bool)
        keep[ends[:-1][full]] = False
        return data[keep], ends - np.concatenate([[0], np.cumsum(full)])

    def starting(self, text: str, p: int) -> list[tuple[int, float]]:
        """Length and score of each piece that starts at ``p``, shortest first."""
        found = []
        for n in range(1, min(self.longest, len(text) - p) + 1):
            part = text[p:p + n]
            if part not in self.heads:
                break
            if part in self.ids:
                found.append((n, self.ids[part][1]))
        return found if found and found[0][0] == 1 else [(1, self.unknown), *found]

    def forward(self, text: str, entry: list[float], size: int) -> tuple[list[float], list[int]]:
        """Best score and last start at every end, from the entry scores at the first places; pieces start before ``size``."""
        best = [*entry, *[NEVER] * (len(text) + 1 - len(entry))]
        start = [-1] * len(best)
        for p in range(size):
            if best[p] == NEVER:
                continue
            for n, score in self.starting(text, p):
                if best[p] + score > best[p + n]:
                    best[p + n], start[p + n] = best[p] + score, p
        return best, start

    def named(self, text: str, start: int, end: int) -> list[int]:
        """Ids of one piece, or of the bytes of a character without one."""
        part = text[start:end]
        return [self.ids[part][0]] if part in self.ids else [self.bytes[b] for b in part.encode()]

    def solve(self, text: str) -> list[int]:
        """Ids of a marked text."""
        _, start = self.forward(text, [0.0], len(text))
        out, end = [], len(text)
        while end:
            out.append(self.named(text, start[end], end))
            end = start[end]
        return [i for part in reversed(out) for i in part]

    def solve_all(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``solve`` for many marked stretches at once: code points and the bounds of the stretches in them -> all ids, and their
        number for each.  Pieces that start at each place are looked up by hash, a length at a time; best scores are carried from place to
        place of all stretches together."""
        size = np.diff(bounds)
        total, count = int(bounds[-1]), len(size)
        limit = np.repeat(bounds[1:], size) - np.arange(total)  # characters from each place to its stretch's end
        ids = np.full((self.longest + 1, total), -1, np.int32)
        alive, h = np.arange(total), np.zeros(total, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                keep = limit[alive] >= n
                alive, h = alive[keep], h[keep] * np.uint64(_BASE) + points[alive[keep] + n - 1].astype(np.uint64)
                at = np.minimum(np.searchsorted(self.head_hash, h), len(self.head_hash) - 1)
                found = self.head_hash[at] == h
                ids[n, alive[found]] = self.head_id[at[found]]
                alive, h = alive[found], h[found]
                if not len(alive):
                    break
        order = np.argsort(-size, kind="stable")
        first, base = bounds[:-1][order], (bounds[:-1] + np.arange(count))[order]  # a place more per stretch, for its end
        best, start = np.full(total + count, NEVER), np.zeros(total + count, np.int64)
        best[base] = 0.0
        longest = int(size.max(initial=0))
        active = np.searchsorted(-size[order], -np.arange(longest + 1), side="right")  # stretches of at least so many characters
        for e in range(1, longest + 1):
            f, o = first[:active[e]], base[:active[e]]
            top, came = np.full(len(f), NEVER), np.zeros(len(f), np.int64)
            for n in range(min(e, self.longest), 0, -1):  # of equal scores the piece that starts first
                piece = ids[n, f + e - n]
                score = best[o + e - n] + self.scores[piece]
                better = (score > top) if n == 1 else (score > top) & (piece >= 0)
                top[better], came[better] = score[better], e - n
            best[o + e], start[o + e] = top, came
        ends = np.zeros(total + count, bool)
        o, at = base[size[order] > 0], size[order][size[order] > 0]
        while len(at):
            ends[o + at] = True
            at = start[o + at]
            o, at = o[at > 0], at[at > 0]
        ends = np.flatnonzero(ends)
        owner = np.searchsorted(bounds[:-1] + np.arange(count), ends, side="right") - 1
        end = ends - owner
        begin = np.where(np.append(True, owner[1:] != owner[:-1]), bounds[owner], np.append(0, end[:-1])) if len(ends) else end
        out = ids[end - begin, begin].astype(np.int64)
        lone = np.flatnonzero(out < 0)
        many = np.ones(len(out), np.int64)
        spelled = [[self.bytes[x] for x in chr(c).encode()] for c in points[begin[lone]].tolist()]
        many[lone] = [len(x) for x in spelled]
        flat = np.repeat(out, many)
        flat[flat < 0] = [i for x in spelled for i in x]
        return flat, np.bincount(owner, many, count).astype(np.int64)

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best scores from each entry state (row) to each exit state of a chunk: ``size`` characters and what follows."""
        states = self.longest
        best = np.full((len(text) + 1, states), NEVER)
        best[np.arange(min(states, len(text) + 1)), np.arange(min(states, len(text) + 1))] = 0.0
        for p in range(size):
            for n, score in self.starting(text, p):
                np.maximum(best[p + n], best[p] + score, out=best[p + n])
        out = np.full((states, states), NEVER)
        after = best[size:size + states]
        out[:, :len(after)] = after.T
        return out

    def traced(self, text: str, size: int, entry: list[float]) -> tuple[list[int], list[list[int]], list[int]]:
        """Ids that all exits share, and for each exit state the ids that follow them and the entry state it comes from."""
        entry = entry[:len(text) + 1]
        best, start = self.forward(text, entry, size)
        exits = range(min(self.longest, len(text) + 1 - size))
        paths = []
        for s in exits:
            ends, end = [], size + s
            while best[end] > NEVER and start[end] >= 0:
                ends.append(end)
                end = start[end]
            paths.append((ends[::-1], end if best[size + s] > NEVER else -1))
        real = [p for p in paths if p[1] >= 0]
        shared = 0
        while real and all(len(e) > shared and (e[shared], f) == (real[0][0][shared], real[0][1]) for e, f in real):
            shared += 1

        def ids(ends: list[int], first: int) -> list[int]:
            return [i for a, b in zip([first, *ends], ends, strict=False) for i in self.named(text, a, b)]

        trunk = ids(real[0][0][:shared], real[0][1]) if real else []
        tails = [ids(e[shared:], e[shared - 1] if shared else f) if f >= 0 else [] for e, f in paths]
        return trunk, tails, [f for _, f in paths]


class Units(Encoder):
    """Stretches that begin with a space, solved once each; the table of known ones is the token encoder's."""

    def __init__(self, path: str):
        self.model = Model.get(path)
        self.dtype = np.uint16 if len(self.model.text) < 1 << 16 else np.uint32
        self.lone = np.isin(np.arange(256), [c for c in range(32) if not any(chr(c) in p for p in self.model.ids)])
        self.reset()

    @staticmethod
    def get(path: str) -> Units:
        return held("pieces", f"units {path}", lambda: Units(path))

    def _runs(self, b: np.ndarray, doc_starts: np.ndarray):
        lone = self.lone[b]
        first = b == 32
        first[1:] &= b[:-1] != 32
        first |= lone
        first[1:] |= lone[:-1]
        first[doc_starts[doc_starts < len(b)]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], len(b)), np.ones(len(starts), bool)

    def _encode_new(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray):
        ids, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.cumsum(ends - starts)
        k = 0
        while k < len(starts):  # some at a time, which bounds the table of pieces
            j = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + BLOCK, side="right")))
            lengths = ends[k:j] - starts[k:j]
            short, long = k + np.flatnonzero(lengths <= LONG), k + np.flatnonzero(lengths > LONG)  # places of few long ones are better walked one by one
            cuts = np.concatenate([[0], np.cumsum(ends[short] - starts[short])])
            data = b[np.repeat(starts[short] - cuts[:-1], np.diff(cuts)) + np.arange(cuts[-1])]
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
            points[points == 32] = ord(MARK)
            places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            found, n = self.model.solve_all(points, places[cuts])
            rest = [np.array(self.model.solve(b[starts[i]:ends[i]].tobytes().decode().replace(" ", MARK)), np.int64) for i in long.tolist()]
            number = np.zeros(j - k, np.int64)
            number[short - k], number[long - k] = n, [len(x) for x in rest]
            at, flat = np.cumsum(number) - number, np.zeros(number.sum(), np.int64)
            flat[np.repeat(at[short - k] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = found
            for i, x in zip(long.tolist(), rest, strict=True):
                flat[at[i - k]:at[i - k] + len(x)] = x
            ids.append(flat)
            counts.append(number)
            k = j
        return np.concatenate(ids), np.concatenate(counts)


def products(m: np.ndarray) -> np.ndarray:
    """Max-plus products of the first 1, 2, ... matrices, by doubling."""
    out, step = m.copy(), 1
    while step < len(out):
        left, right = out[:-step].copy(), out[step:].copy()
        for k in range(len(left)):
            out[step + k] = np.maximum((left[k][:, :, None] + right[k][None]).max(axis=1), NEVER)
        step *= 2
    return out


def _giant(rows: DataFrame, path: str, states: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (" " + text).replace(" ", MARK)
                at = range(0, len(text), CHUNK)
                for k in range(0, len(at), 64):
                    some = at[k:k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([i // CHUNK for i in some], pa.int64()),
                                                      pa.array([min(CHUNK, len(text) - i) for i in some], pa.int32()), pa.array([text[i:i + CHUNK + states] for i in some], pa.string())],
                                                     ["row_", "chunk", "size", "text"])

    chunks = written(rows.select("row_", "text").mapInArrow(cut, "row_ long, chunk long, size int, text string"), "chunks")
    spread = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_", "chunk")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.get(path)
        for batch in batches:
            m = [model.transfer(t, n).ravel() for t, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            ends = np.arange(len(m) + 1, dtype=np.int32) * states**2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *m])))], ["row_", "chunk", "m"])

    def entries(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())
        m = table.column("m").combine_chunks().flatten().to_numpy().reshape(-1, states, states)[order]
        v = np.full((len(m), states), NEVER)
        v[0, 0] = 0.0
        v[1:] = products(m)[:-1, 0]
        return pa.table([table.column("row_").take(pa.array(order)), table.column("chunk").take(pa.array(order)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["row_", "chunk", "entry"])

    matrices = spread.mapInArrow(transfers, "row_ long, chunk long, m array<double>")
    scores = matrices.groupBy("row_").applyInArrow(entries, "row_ long, chunk long, entry array<double>")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.get(path)
        for batch in batches:
            out = [model.traced(t, n, e) for n, t, e in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.int32())),
                                              pa.array([o[1] for o in out], pa.list_(pa.list_(pa.int32()))), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                                             ["row_", "chunk", "trunk", "tails", "origin"])

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())[::-1]
        state, parts = 0, []
        for k in order.tolist():
            parts += [table.column("tails")[k][state].values.to_numpy(), table.column("trunk")[k].values.to_numpy()]
            state = table.column("origin")[k][state].as_py()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.concatenate(parts[::-1])], pa.list_(pa.int32()))], ["row_", "ids"])

    joined = chunks.join(scores, ["row_", "chunk"]).select("row_", "chunk", "size", "text", "entry")
    traced = joined.mapInArrow(trace, "row_ long, chunk long, trunk array<int>, tails array<array<int>>, origin array<int>")
    return traced.groupBy("row_").applyInArrow(chain, "row_ long, ids array<int>")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", giant: int = GIANT) -> DataFrame:
    """``docs`` with the column ``ids`` instead of ``text``; the other columns stay."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*rest, F.translate(F.coalesce(text, F.lit("")), MARK, " ").alias("text_"))
    small, large = rows.where(F.length("text_") < giant), rows.where(F.length("text_") >= giant)
    inner = small.select(F.struct(*rest).alias("rest_"), "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.get(path)
        for batch in batches:
            b, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets):
                own = offsets[i:j + 1] - offsets[i]
                full = np.flatnonzero(np.diff(own) > 0)
                marked = np.insert(b[offsets[i]:offsets[j]], own[full], 32)  # the space in front
                found, bounds = units.encode(marked, own + np.searchsorted(full, np.arange(j - i + 1)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["rest_", "ids_"])

    schema = T.StructType([inner.schema["rest_"], T.StructField("ids_", T.ArrayType(T.IntegerType()))])
    short = wide(inner).mapInArrow(run, schema).select(*[F.col("rest_")[c].alias(c) for c in rest], F.col("ids_").alias(ids))
    big = written(large.withColumn("row_", F.monotonically_increasing_id()), "giants")
    solved = _giant(big.select("row_", F.col("text_").alias("text")), path, Model.get(path).longest)
    long = big.drop("text_").join(solved, "row_").select(*rest, F.col("ids").alias(ids))
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the column ``text`` instead of ``ids``; null ids give an empty text."""
    rest = [c for c in encoded.columns if c not in (text, ids)]
    inner = encoded.select(F.struct(*rest).alias("rest_"), F.col(ids).cast("array<int>").alias("ids_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.get(path)
        for batch in batches:
            lists = batch.column(1)
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            found = lists.flatten().to_numpy(zero_copy_only=False)
            for i, j in pieces(edges, PIECE):
                data, ends = model.joined(found[edges[i]:edges[j]], edges[i:j + 1] - edges[i])
                texts = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                try:
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:  # byte pieces that are no UTF-8
                    texts = pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), texts], ["rest_", "text_"])

    schema = T.StructType([inner.schema["rest_"], T.StructField("text_", T.StringType())])
    return inner.mapInArrow(run, schema).select(*[F.col("rest_")[c].alias(c) for c in rest], F.col("text_").alias(text))
