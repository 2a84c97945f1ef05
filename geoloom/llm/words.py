"""Vectorised word tables over Arrow text columns.

Words are runs of bytes other than ASCII white space (space, \\t to \\r), as in
``[^\\x20\\x09-\\x0D]+``.  Word hashes are 64-bit polynomial hashes read off one
running sum over the batch, finalised with the word's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B = 0x9DDFEA08EB382D69
_B_INVERSE = pow(_B, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _B, np.uint64), np.full(size, _B_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, one text after the other, and the n + 1 places where texts begin; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts: ``start``, ``end`` (bytes), ``doc`` (row) and ``first`` (n + 1 places of each row's words)."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_buffer(column)
        data, n = self.data, len(column)
        if len(data):
            solid = np.concatenate([[False], ~_IS_SPACE[data], [False]])
            edge = np.zeros(len(data) + 1, bool)
            edge[self.at] = True
            self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
            self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def keyed_hashes(self, seed: int) -> np.ndarray:
        """A second, multilinear hash of each word: its bytes times keys drawn from the seed by their place in the word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        keys = mix(np.arange(1, int(size.max()) + 2, dtype=np.uint64) * np.uint64(_B) + np.uint64(seed)) | np.uint64(1)
        owner = np.repeat(self.start, size)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(owner)) - np.repeat(first, size)
        sums = np.add.reduceat((self.data[owner + place].astype(np.uint64) + np.uint64(1)) * keys[place], first)
        return mix(sums + size.astype(np.uint64) * keys[size])

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        running = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=running[1:])
        h = (running[self.end] - running[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sequence_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, seed, np.uint64)
    for j in range(n):
        out *= np.uint64(_B)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def keyed_sequences(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Multilinear hash of the n words from each word on; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    keys = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_B_INVERSE) + np.uint64(seed)) | np.uint64(1)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * keys[j]
    return mix(out)


def slices(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 2048):
    """(first row, one past the last row) of pieces of about ``most_bytes`` of text; a longer text is a piece of its own."""
    _, at = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        to = int(np.searchsorted(at, at[row] + most_bytes, "right")) - 1
        to = min(max(to, row + 1), row + most_rows, n)
        yield row, to
        row = to


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for later tasks and should not keep a past one's peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another libc
        pass


def giving_back(batches):
    """The batches; frees memory when they end."""
    yield from batches
    give_back()
