"""Vectorised tokenisation and rolling hashes over Arrow string columns.

One Arrow batch is cut into pieces of about ``PIECE`` bytes (a longer text is a
piece of its own, never a prefix), and every step works on the UTF-8 bytes of a
whole piece with numpy, so that no Python code runs per word.

A text's words are maximal runs of bytes that are not separators.  Separators
are ASCII in every definition used here, and bytes >= 0x80 are always word
bytes, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
PIECE = 1 << 20

_U = np.uint64
_R_BYTE, _R_WORD = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def _mask(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
BLANKS = _mask(bytes([0x20, *range(0x09, 0x0E)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of texts whose A-Z are lower-cased already.
NOT_ALNUM = _mask(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

KEEP = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else unchanged.
LOWER = np.where((KEEP >= 65) & (KEEP <= 90), KEEP + 32, KEEP).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F) + _U(seed))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_R_BYTE), _Powers(_R_WORD)
_VALUES = {seed: _byte_values(seed) for seed in (1, 2)}


@dataclass
class Piece:
    """Words of consecutive texts: ``starts``/``ends`` are byte places in ``data``; text ``i`` has the words ``offsets[i]:offsets[i + 1]`` and bytes ``bounds[i]:bounds[i + 1]``."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    fold: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit hash of each word (after folding)."""
        if not len(self.starts):
            return np.zeros(0, _U)
        up, down = _BYTE_POWERS.to(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_VALUES[seed][self.fold[self.data]] * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every ``k`` consecutive entries of ``words``; entry ``i`` covers ``i .. i + k - 1``."""
    n = len(words)
    if n < k:
        return np.zeros(0, _U)
    up, down = _WORD_POWERS.to(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((words | _U(1)) * up[:-1] if k == 1 else words * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + _U(k))


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of ``k`` words that stay within one text, and their texts."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first - offsets[:-1], counts), text


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = BLANKS, fold: np.ndarray = KEEP) -> Iterator[Piece]:
    """The words of a string column, piece by piece, in order."""
    data, offsets = string_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        at = offsets[i : j + 1] - offsets[i]
        yield _piece(i, data[offsets[i] : offsets[j]], at, separators, fold)
        i = j


def _piece(first: int, data: np.ndarray, at: np.ndarray, separators: np.ndarray, fold: np.ndarray) -> Piece:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Piece(first, data, none, none, np.zeros(len(at), np.int64), fold, at)
    blank = separators[fold[data]]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    edges = at[(at > 0) & (at < n)]
    before[edges] = True
    after[edges - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return Piece(first, data, starts, ends, np.searchsorted(starts, at), fold, at)
