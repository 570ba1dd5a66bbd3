"""Words and their hashes for batches of texts, on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on each number."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """The first n numbers of a fixed pseudo-random sequence of 64-bit numbers."""
    return mix(np.arange(n, dtype=U64) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))


BYTES = draws(256, 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and the offsets of its texts. Null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold about `most` bytes."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of some texts in order. first[d] : first[d + 1] are those of text d."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes other than space and \\t to \\r, with a 64-bit hash of each."""
    if lower:
        data = lower_ascii(data)
    n = len(data)
    if not n:
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = (data != 32) & ((data < 9) | (data > 13))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    if not len(start):
        return Words(np.zeros(0, U64), start, end, first)
    length = end - start
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    rolls = draws(int(length.max()), 2) | U64(1)
    hashes = mix(np.add.reduceat(BYTES[data[inside]] * rolls[place], at) + length.astype(U64))
    return Words(hashes, start, end, first)


def windows(w: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its first word) of each window of `size` words within one text.

    short: a text of fewer words, but not none, is one window by itself.
    """
    counts = np.diff(w.first)
    n = np.maximum(counts - size + 1, 0)
    at = np.repeat(w.first[:-1], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    turns = draws(size, 3) | U64(1)
    out = np.zeros(len(at), U64)
    for j in range(size):
        out += w.hashes[at + j] * turns[j]
    out = mix(out)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        more = np.array([int(mix(np.array([(w.hashes[w.first[d] : w.first[d + 1]] * turns[: counts[d]]).sum() + U64(counts[d])], U64))[0]) for d in few], U64)
        out, at = np.concatenate((out, more)), np.concatenate((at, w.first[few]))
    return out, at


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
