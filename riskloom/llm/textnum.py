"""Vectorised text helpers for use inside tasks (numpy on UTF-8 bytes)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WORD = 2**64


def byte_rows(column: pa.Array):
    """The texts of an Arrow string column as uint8 arrays (views, no copies)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield flat[a:b]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SpanHash:
    """Hash of any byte span in O(1) after one prefix sum over the text.

    Each byte is replaced by a random 64-bit number; a span's value is the
    polynomial of its bytes modulo 2**64, made independent of the position with
    the inverse base, and mixed with the span's length.
    """

    def __init__(self, salt: int):
        self.table = mix(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt * 2 + 1))
        self.base = (0xD6E8FEB86659FD93 + 8 * salt) % _WORD | 1
        self.inverse = pow(self.base, -1, _WORD)
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            powers = []
            for base in (self.base, self.inverse):
                steps = np.full(n, base, U64)
                steps[0] = 1
                powers.append(np.multiply.accumulate(steps))
            self.up, self.down = powers

    def prefix(self, text: np.ndarray) -> np.ndarray:
        self._grow(len(text) + 1)
        sums = np.zeros(len(text) + 1, U64)
        np.cumsum(self.table[text] * self.up[: len(text)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


@functools.cache
def span_hash(salt: int) -> SpanHash:
    return SpanHash(salt)


def byte_class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SPACE = byte_class(b" \t\n\x0b\x0c\r")
_WORDS = 1 << 18  # words hashed at a time
_SHORT = 256  # bytes; longer words, at most one in so many bytes, are hashed one by one
_KEEP = np.array([2 ** (8 * n) - 1 for n in range(9)], U64)  # the first n bytes of eight


def word_bounds(text: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not separators."""
    inside = np.empty(len(text) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separator[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each word; eight bytes at a time are mixed in, so that no polynomial identity makes words collide."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
    out = np.empty(len(starts), U64)
    for i in range(0, len(starts), _WORDS):
        at = starts[i : i + _WORDS]
        size = ends[i : i + _WORDS] - at
        h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt))
        for k in np.flatnonzero(size > _SHORT):
            digest = hashlib.blake2b(text[at[k] : at[k] + size[k]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little"))
            h[k] = int.from_bytes(digest.digest(), "little")
        open_, done = np.flatnonzero(size <= _SHORT), 0
        while len(open_):
            left = size[open_] - done
            h[open_] = mix(h[open_] ^ (eights[at[open_] + done] & _KEEP[np.minimum(left, 8)]))
            open_, done = open_[left > 8], done + 8
        out[i : i + _WORDS] = h
    return out


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` consecutive values (none if there are fewer)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + values[i : i + n]
    return mix(out)
