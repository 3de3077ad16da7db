"""Numbers of ``stats.draw_number`` and ``stats.fast_draw`` for many rows at once, as arrays inside a task.

Both name a draw by texts or numbers that are equal for all rows of one replicate, followed by the row's index, so only the index varies along an array.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_CHUNK = 16384  # rows hashed together, so that the working arrays stay in the processor's cache
_MASK = 0xFFFFFFFF
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & _MASK for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


def _md5_head(words: list, rows: int) -> np.ndarray:
    """First 32 bits (as the leading eight hex digits) of the md5 of one 64-byte block a row; a word is a number or an array."""
    a, b, c, d = (np.full(rows, v, np.uint32) for v in _START)
    f, g = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
        elif part == 1:
            np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
        elif part == 2:
            np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
        else:
            np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
        word, turn = words[_WORD[part](i)], _TURNS[part][i % 4]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_SINES[i] + word) & _MASK)
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()


def md5_numbers(prefix: str, n: int) -> np.ndarray:
    """The leading eight hex digits of md5(prefix || i) as a number, for i = 0 .. n - 1."""
    head, out = prefix.encode(), np.empty(n, np.uint32)
    size = len(head)
    if size + len(str(n)) > 55:  # more than one block
        for i in range(n):
            out[i] = int.from_bytes(hashlib.md5(head + str(i).encode()).digest()[:4], "big")
        return out
    first, digits = 0, 1
    while first < n:
        last = min(n, 10**digits)
        for lo in range(first, last, _CHUNK):
            rest = np.arange(lo, min(lo + _CHUNK, last), dtype=np.uint32)
            rows, block = len(rest), bytearray(64)
            block[:size], block[size + digits] = head, 0x80
            block[56:64] = (8 * (size + digits)).to_bytes(8, "little")
            words = [int.from_bytes(block[4 * w:4 * w + 4], "little") for w in range(16)]
            for at in range(size + digits - 1, size - 1, -1):
                rest, digit = np.divmod(rest, np.uint32(10))
                digit += np.uint32(48)
                digit <<= np.uint32(8 * (at % 4))
                words[at // 4] = digit + (words[at // 4] if isinstance(words[at // 4], np.ndarray) else np.uint32(words[at // 4]))
            out[lo:lo + rows] = _md5_head(words, rows)
        first, digits = last, digits + 1
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_P5_4, _P5_8 = np.uint64(0x27D4EB2F165667C5 + 4), np.uint64(0x27D4EB2F165667C5 + 8)


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def xxhash_ints(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``xxhash64(..., value)`` of INT values after columns whose own ``xxhash64`` are ``seeds``."""
    h = (seeds + _P5_4) ^ (values.astype(np.uint64) & np.uint64(_MASK)) * _P1
    return _mixed(_turn(h, 23) * _P2 + _P3)


def xxhash_longs(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The same for BIGINT values."""
    h = (seeds + _P5_8) ^ _turn(values.astype(np.uint64) * _P2, 31) * _P1
    return _mixed(_turn(h, 27) * _P1 + _P4)


def xxhash_steps(values: np.ndarray) -> np.ndarray:
    """What ``xxhash_longs`` makes of the values alone."""
    return _turn(values.astype(np.uint64) * _P2, 31) * _P1


def xxhash_open(seeds: np.ndarray, steps: np.ndarray, h: np.ndarray, g: np.ndarray) -> None:
    """``xxhash_longs(seeds[:, None], values)`` into ``h`` without its last step ``h ^= h >> 32``; ``g`` is scratch."""
    np.bitwise_xor((seeds + _P5_8)[:, None], steps, out=h)
    np.right_shift(h, np.uint64(37), out=g)
    h <<= np.uint64(27)
    h |= g
    h *= _P1
    h += _P4
    for by, times in ((33, _P2), (29, _P3)):
        np.right_shift(h, np.uint64(by), out=g)
        h ^= g
        h *= times


def xxhash_seed(value: int) -> np.ndarray:
    return np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64)


_STEPS = np.arange(_CHUNK, dtype=np.uint64) * _P1


def xxhash_numbers(seed: int, rep: int, n: int) -> np.ndarray:
    """Lower 32 bits of ``xxhash64(..., rep, i)`` for i = 0 .. n - 1; ``seed`` is the hash of the columns before."""
    start, out = xxhash_ints(xxhash_seed(seed), np.array([rep])) + _P5_4, np.empty(n, np.uint32)
    hashes, spare = np.empty(min(n, _CHUNK), np.uint64), np.empty(min(n, _CHUNK), np.uint64)
    for lo in range(0, n, _CHUNK):
        rows = min(n - lo, _CHUNK)
        h, g = hashes[:rows], spare[:rows]
        np.add(_STEPS[:rows], np.uint64(lo * int(_P1) & 0xFFFFFFFFFFFFFFFF), out=h)
        h ^= start
        np.right_shift(h, np.uint64(41), out=g)
        h <<= np.uint64(23)
        h |= g
        h *= _P2
        h += _P3
        for by, times in ((33, _P2), (29, _P3)):
            np.right_shift(h, np.uint64(by), out=g)
            h ^= g
            h *= times
        np.right_shift(h, np.uint64(32), out=g)
        h ^= g
        np.copyto(out[lo:lo + rows], h, casting="unsafe")
    return out


def below(numbers: np.ndarray, n: int) -> np.ndarray:
    """``numbers % n`` in place; a division by one number runs in vector registers, a remainder does not."""
    numbers -= numbers // np.uint32(n) * np.uint32(n)
    return numbers
