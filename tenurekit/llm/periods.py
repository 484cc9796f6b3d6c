"""Runs of repeated word sequences by internal pattern matching: range successor in a wavelet tree over the suffix array.

A run is a stretch of words with smallest period q and length >= max(least, times * q) that can't be extended. Every run with
2**k <= q < 2**(k + 1) holds a block of 2**k words that begins at a multiple of 2**k, and the same block again q words later. So
each block asks for its occurrences in the neighbouring windows of starts: [2**k, 2**(k + 1)) words on and, for the shortest
blocks (SHORT words, as least >= 3 * SHORT), also [1, SHORT). Occurrences are the suffixes of one interval of the suffix array;
the wavelet tree over it counts those below a position and gives the next one. In such a window they form one arithmetic
progression: up to two give their distances as candidate periods; of more, with difference r, the candidates are r itself and the
distances between the ends of the stretches with period r around the block and around the progression. A candidate is extended to
both sides as far as the words agree; of equal stretches the one with the smallest period is the run.

Words are compared by 64-bit hashes within a text; ranks of word sequences of 1, 2, 4, .. words (prefix doubling) are exact on
these. Sequences that occur once leave the sorting, so ordinary prose ends after a few rounds.

Null and empty texts have no words and no runs. Texts are read whole, each by itself: no run goes from one row to another, and
repeated rows or equal ids don't matter.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenurekit.llm import text as tx

LEAST, TIMES = 24, 3
CHUNK_BYTES = 2 << 20  # texts handled at once; a longer text is handled by itself
SHORT = 3  # blocks have 2**SHORT words at least


# --- ranks, suffix array ----------------------------------------------------------------------------------------------

class Ranks(NamedTuple):
    """`level[k][i]`: where the suffixes that share 2**k words with the suffix at i begin in the suffix array. Words behind the
    end of a text equal nothing."""
    level: list[np.ndarray]
    suffix: np.ndarray


def _groups(key: np.ndarray) -> np.ndarray:
    """For sorted keys: index of the first equal one."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def ranks(word: np.ndarray, text: np.ndarray) -> Ranks:
    """Prefix doubling over words of many texts (`text` ascending); only ranks that several suffixes share are sorted again."""
    n = len(word)
    order = np.lexsort((word, text))
    first = np.ones(n, bool)
    first[1:] = (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    end = np.searchsorted(text, text, "right") if n else np.zeros(0, int)  # of the text of each word
    level, suffix = [rank], order.astype(np.int32)
    shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else np.zeros(0, int)
    step = 1
    while len(shared):
        there = shared + step
        second = np.where(there < end[shared], rank[np.minimum(there, n - 1)] + 1, 0)
        key = rank[shared].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, here = key[by], shared[by]
        old = rank[here]
        place = np.arange(len(here)) - _groups(old) + old  # places in the suffix array; a group's members stay together
        fresh = _groups(key)
        suffix[place] = here
        rank = rank.copy()
        rank[here] = place[fresh]
        level.append(rank)
        size = np.bincount(fresh, minlength=len(here))[fresh]
        shared = np.sort(here[size > 1])
        step *= 2
    return Ranks(level, suffix)


def agree(r: Ranks, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from a and b on, and before them."""
    n = len(r.suffix)
    ahead, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(r.level) - 1, -1, -1):
        rank, size = r.level[k], 1 << k
        x, y = a + ahead, b + ahead
        same = (x < n) & (y < n)
        same &= rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        ahead += size * same
        x, y = a - back - size, b - back - size
        same = (x >= 0) & (y >= 0)
        same &= rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]
        back += size * same
    return ahead, back


# --- wavelet tree -----------------------------------------------------------------------------------------------------

class Wavelet:
    """Wavelet tree (as a matrix of bits, highest first) over distinct positions; answers are found for many queries at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.split.append(before[-1])
            values = np.concatenate([values[~one], values[one]])

    def count_below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values at places [lo, hi) are less than x."""
        count, total = np.zeros(len(lo), np.int64), hi - lo
        for d, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (x >> (self.bits - 1 - d) & 1).astype(bool)
            z0, z1 = zeros[lo], zeros[hi]
            count += np.where(one, z1 - z0, 0)
            lo, hi = np.where(one, split + lo - z0, z0), np.where(one, split + hi - z1, z1)
        return np.where(x >> self.bits > 0, total, count)

    def ranked(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value at places [lo, hi) that k of these are less than."""
        k, out = k.copy(), np.zeros(len(lo), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            z0, z1 = zeros[lo], zeros[hi]
            one = k >= z1 - z0
            k -= np.where(one, z1 - z0, 0)
            out = out * 2 + one
            lo, hi = np.where(one, split + lo - z0, z0), np.where(one, split + hi - z1, z1)
        return out


def _progressions(tree: Wavelet, lo, hi, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the positions at places [lo, hi): how many lie in [a, b), the successor of a, and the one after it (-1: none)."""
    less, upto = tree.count_below(lo, hi, a), tree.count_below(lo, hi, b)
    count = upto - less
    first = np.full(len(lo), -1, np.int64)
    next_ = first.copy()
    for least, out in ((1, first), (2, next_)):
        m = count >= least
        out[m] = tree.ranked(lo[m], hi[m], less[m] + least - 1)
    return count, first, next_


# --- runs -------------------------------------------------------------------------------------------------------------

def _candidates(r: Ranks, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods at which a run may be: every run is among them with its smallest period."""
    n = len(r.suffix)
    none = np.zeros(0, np.int64)
    if len(r.level) <= SHORT:
        return none, none
    size = np.bincount(r.level[SHORT], minlength=n)  # by first place
    inside = size[r.level[SHORT][r.suffix]] > 1
    place = np.cumsum(inside) - inside  # of the suffix array in the tree, which holds shared sequences only
    tree = Wavelet(r.suffix[inside].astype(np.int64))
    begin = np.searchsorted(text, text, "left")
    at, period = [], []
    for k in range(SHORT, len(r.level)):
        rank, wide = r.level[k], 1 << k
        many = np.bincount(rank, minlength=n)
        s = np.flatnonzero((many[rank] > 1) & ((np.arange(n) - begin) % wide == 0))
        if not len(s):
            continue
        lo = place[rank[s]].astype(np.int64)
        hi = lo + many[rank[s]]
        for a, b in ([(1, wide)] if k == SHORT else []) + [(wide, 2 * wide)]:
            count, first, next_ = _progressions(tree, lo, hi, s + a, s + b)
            for found in (first, next_):
                m = found >= 0
                at.append(s[m])
                period.append(found[m] - s[m])
            m = count > 2
            x, y, step = s[m], first[m], next_[m] - first[m]
            (right, left), (right2, left2) = agree(r, x, x + step), agree(r, y, y + step)
            for d in (step, (y - left2) - (x - left), (y + right2) - (x + right)):
                good = d > 0
                at.append(x[good])
                period.append(d[good])
    at, period = (np.concatenate(x) if x else none for x in (at, period))
    real = at + period < n  # distances of ends may lead beyond
    at, period = at[real], period[real]
    pair = np.unique(at * (n + 1) + period)
    return pair // (n + 1), pair % (n + 1)


def find_runs(word: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period) in words of many texts, by start and period; `text` ascends, starts are indices of words."""
    if least < 3 << SHORT or times < 3:
        raise ValueError("runs have 24 words or more, and three periods or more")
    r = ranks(word, text)
    at, q = _candidates(r, text)
    ahead, back = agree(r, at, at + q)
    start, length = at - back, q + ahead + back
    good = length >= np.maximum(least, times * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _row(runs: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the one of greatest length / period (then smallest start, period), and a digest of all."""
    line = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    s, n, q = best or (None, None, None)
    return len(runs), s, n, q, best and 1000 * n // q, hashlib.sha256(line.encode()).hexdigest()


def _of_texts(data: np.ndarray, at: np.ndarray, least: int, times: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text, and its words without the repeats, joined by one space."""
    w = tx.words(data, at, tx.SPACED)
    raw = data[at[0]:at[-1]]
    text = w.text.astype(np.int64)
    start, length, q = find_runs(w.hash, text, least, times)
    drop = np.zeros(len(text) + 1, np.int64)
    np.add.at(drop, start + q, 1)
    np.add.at(drop, start + length, -1)
    kept = np.cumsum(drop)[:-1] == 0
    # kept words and one space after each, copied in one go
    a, b = w.start[kept], w.end[kept]
    wide = b - a + 1
    to = np.cumsum(wide) - wide
    first = np.concatenate([[0], np.cumsum(kept)])[w.first]
    new = np.full(int(wide.sum()), 32, np.uint8)
    index = np.arange(len(new))
    word_of = np.repeat(np.arange(len(a)), wide)
    offset = index - to[word_of]
    inner = offset < wide[word_of] - 1
    new[inner] = raw[(a[word_of] + offset)[inner]]
    edge = np.append(to, len(new))
    of = np.searchsorted(start, w.first)
    for k in range(len(at) - 1):
        runs = list(zip((start[of[k]:of[k + 1]] - w.first[k]).tolist(), length[of[k]:of[k + 1]].tolist(), q[of[k]:of[k + 1]].tolist()))
        yield runs, new[edge[first[k]]:max(edge[first[k]], edge[first[k + 1]] - 1)].tobytes()


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, digests: bool = False) -> DataFrame:
    """Per row: its id, `runs` (array of start, length, period; words numbered from 0) and `collapsed`: its words without those that
    a run repeats, that is, all words of a run but its first `period`. With `digests`: counts, the strongest run and digests."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    fields = [T.StructField("n_runs", T.LongType()), *_RUN.fields, T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()),
              T.StructField("collapsed_sha256", T.StringType())] if digests else [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), *fields])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 if digests else [pa.list_(pa.struct([(f.name, pa.int64()) for f in _RUN])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tx.utf8(b.column("text"))
            found = [x for i, j in tx.runs(at, CHUNK_BYTES) for x in _of_texts(data, at[i:j + 1], least, times)]
            if digests:
                out = [(*_row(runs), hashlib.sha256(left).hexdigest()) for runs, left in found]
            else:
                out = [([dict(zip(_RUN.names, x)) for x in runs], left.decode()) for runs, left in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], schema.names)
        tx.trim()

    return rows.mapInArrow(run, schema)
