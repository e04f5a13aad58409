"""Flat, vectorised views of a batch of texts, used inside Arrow tasks.

A batch of strings is one UTF-8 byte buffer with offsets. Words are runs of
bytes of one class, so finding and hashing them takes a handful of numpy
passes over the buffer instead of a Python loop over words. Work proceeds in
slices of a few megabytes so that the temporaries stay small whatever the
length of a text; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(1, 2**63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.randint(1, 2**63, size=64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = _ALPHA[0x80:] = True

#: 1 for the bytes of words that white space ends.
BLANK_WORDS = (~_SPACE).astype(np.uint8)
#: 1 for letters, digits and bytes of non-ASCII characters, 2 for other visible bytes.
WORDS_AND_SIGNS = np.where(_SPACE, 0, np.where(_DIGIT | _ALPHA, 1, 2)).astype(np.uint8)
WORDS_AND_SIGNS[:0x09] = WORDS_AND_SIGNS[0x0E:0x20] = 0
#: 1 for letters and bytes of non-ASCII characters.
LETTER_WORDS = _ALPHA.astype(np.uint8)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `most` bytes; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of one slice: start, end and class by word; first word and count by text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
        self.raw = _LOWER[raw]
        kind = classes[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[offsets] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        real = kind[start] > 0 if len(raw) else np.zeros(0, bool)
        self.start, self.end = start[real], end[real]
        self.kind = kind[self.start]
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first `most` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start if most is None else np.minimum(self.end - self.start, most)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        inside = np.arange(int(length.sum())) - np.repeat(first, length)
        power = np.ones(int(length.max()), np.uint64)
        np.multiply.accumulate(np.full(len(power) - 1, _P, np.uint64), out=power[1:])
        terms = _BYTE[self.raw[inside + np.repeat(self.start, length)]] * power[inside]
        return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of `size` words; a text with fewer words, but not none, is one run."""
    n = len(h)
    full = max(0, n - size + 1)
    total = np.zeros(full, np.uint64)
    for k in range(size):
        total += h[k : k + full] * _STEP[k]
    text = np.repeat(np.arange(len(count)), count)
    whole = text[:full] == text[size - 1 : size - 1 + full]
    out, of = mix(total[whole]), text[:full][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([int((h[first[t] : first[t] + count[t]] * _STEP[: count[t]]).sum(dtype=np.uint64)) ^ int(count[t]) for t in short], np.uint64)
        out, of = np.concatenate([out, mix(extra)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different values, sorted, with the text of each; `of` is ascending."""
    order = np.lexsort((values, of))
    v, t = values[order], of[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[keep], t[keep]


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of each text's different word shingles, and their count by text."""
    w = Words(raw, offsets, BLANK_WORDS)
    v, t = distinct(*windows(w.hashes(), w.first, w.count, size))
    return v, t, np.bincount(t, minlength=len(offsets) - 1)
