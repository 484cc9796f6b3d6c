"""Whole texts as flat numpy arrays: word bounds, word hashes and rolling hashes over words.

An Arrow string column is one run of UTF-8 bytes. Words of many texts are found at once with byte tables, and a word's
hash is a difference of prefix sums of a polynomial modulo 2**64, so no Python object is made for a word.
"""
from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20  # texts are handled in runs of about this size; a longer text is a run of its own
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK + 4096), _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 4096)


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system; an idle worker then holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Alphabet(NamedTuple):
    """`fold`: what each byte counts as; `word`: whether the folded byte belongs to a word."""
    fold: np.ndarray
    word: np.ndarray


def alphabet(separators: bytes, lower: bool) -> Alphabet:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    return Alphabet(fold, word[fold])


#: words `[^\x20\x09-\x0D]+`, as they stand and with A-Z lowered
SPACED = alphabet(b" \t\n\v\f\r", lower=False)
SPACED_LOWER = alphabet(b" \t\n\v\f\r", lower=True)
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered
ALNUM_LOWER = alphabet(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def runs(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes; every text belongs to one run."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the run
    end: np.ndarray
    text: np.ndarray  # index of the text in the run, ascending
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each text; one entry more than texts


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, at: np.ndarray, letters: Alphabet) -> Words:
    """Words of the texts data[at[k]:at[k + 1]]. `at` starts anywhere; positions are relative to at[0]."""
    data, at = data[at[0]:at[-1]], at - at[0]
    inside = letters.word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    before[-1:] = False
    before[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~before | edge[1:])) + 1
    first = np.searchsorted(start, at)
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first))
    return Words(start, end, text, _hashes(letters.fold[data], start, end), first)


def _hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    k = 0
    while k < len(start):
        s0 = start[k]
        m = max(k + 1, int(np.searchsorted(end, s0 + _BLOCK, "right")))
        span = int(end[m - 1] - s0)
        power, inverse = (_POW, _INV) if span < len(_POW) else \
            (_powers(_BASE, span + 1), _powers(pow(_BASE, -1, 1 << 64), span + 1))
        total = np.zeros(span + 1, dtype=np.uint64)
        np.cumsum(_BYTE[folded[s0:s0 + span]] * power[:span], out=total[1:])
        s, e = start[k:m] - s0, end[k:m] - s0
        out[k:m] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _M2
        k = m
    return mix(out)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of n words from each word on, and whether those n words lie in one text."""
    h = np.zeros(max(0, len(w.hash) - n + 1), dtype=np.uint64)
    for k in range(n):
        h *= np.uint64(_BASE)
        h += w.hash[k:k + len(h)]
    return mix(h), w.text[:len(h)] == w.text[n - 1:n - 1 + len(h)] if len(h) else np.zeros(0, dtype=bool)
