"""Benchmark decontamination by suffix arrays of the training texts.

The training words of a run of whole texts form a shard; its suffix array orders all positions by the words that follow
them (doubling: ranks of 1, 2, 4, ... words). Every suffix of the test items is then looked up by binary search, one word
deeper at a time, for all suffixes of a block at once; suffixes that begin with the same window are looked up once. What is
left at the window's depth is a range of the suffix array: its places are marked in the texts, never paired with the
items' places. Longest verbatim matches are common runs of windows, read from one more suffix array over the places hit.

Test items are split and hashed in tasks, dealt to blocks of about `block_words` words and written to the shared folder. The
driver sends one written block after the other; PASS_BLOCKS of them are searched in one pass, in which each shard is built once.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lowered, compared by 64-bit hashes. A window is `window` words of an
item, or the whole item if it has fewer. Null and empty texts have no words: such documents have no hits, such items no
window. Repeated documents are judged each by itself. Rows of one item id are one item; an item without id is named ''. A match
longer than half a block may be told in parts.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tenurekit.llm import text as tx
from tenurekit.llm.store import remove, written

WINDOW = 10
BLOCK_WORDS = 1 << 20  # with its windows at most some 50 MB
PASS_BLOCKS = 4
_END = np.uint64(0)  # stands after each text; words have hashes from 1 on
HITS = "array<struct<start:bigint,length:bigint>>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _hash(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the index of each text's first word."""
    w = tx.words(data, at, tx.ALNUM_LOWER)
    return np.maximum(w.hash, np.uint64(1)), w.first


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
    """Class of the pair of ranks at each place and `step` places further on."""
    after = np.zeros(len(rank), dtype=np.int64)
    after[:-step] = rank[step:] + 1
    return np.unique(rank << 32 | after, return_inverse=True)[1]


def _classes(rank: np.ndarray, k: int) -> np.ndarray:
    """Class of the k values from each place on; places nearer to the end than k are compared by what is left."""
    have = 1
    while have < k:
        step = min(have, k - have)
        rank = _pairs(rank, step)
        have += step
    return rank


class Block(NamedTuple):
    """Different windows of some test items, each with the set of items that hold it."""
    items: list[str]
    flat: np.ndarray  # word hashes of the items, each item followed by _END
    start: np.ndarray  # of each window: a place in flat, its words, its set
    depth: np.ndarray
    group: np.ndarray
    held: np.ndarray  # items of all sets; set g is held[first[g]:first[g + 1]]
    first: np.ndarray
    chain: np.ndarray  # per place of flat: the full window that begins there, or -1


def pack(names: list[str], parts: list[np.ndarray], window: int) -> Block:
    n = np.array([len(x) for x in parts], dtype=np.int64)
    flat = np.concatenate([y for x in parts for y in (x, [_END])]).astype(np.uint64)
    begin = np.cumsum(n + 1) - n - 1
    labels, label = np.unique(np.array(names, dtype=object), return_inverse=True)
    depth = np.minimum(n, window)
    count = np.where(n > 0, n - depth + 1, 0)
    start, depth, item = _spread(begin, count), np.repeat(depth, count), np.repeat(label, count)
    rank, of, known = np.unique(flat, return_inverse=True)[1], np.zeros(len(start), dtype=np.int64), 0
    for d in np.unique(depth):
        here = depth == d
        which = np.unique(_classes(rank, int(d))[start[here]], return_inverse=True)[1]
        of[here] = known + which
        known += int(which.max()) + 1
    seen = np.unique(of, return_index=True)[1]
    pairs = np.unique(of * len(labels) + item)
    window_of, items = pairs // len(labels), pairs % len(labels)
    bounds = np.searchsorted(window_of, np.arange(known + 1))
    sets: dict[bytes, int] = {}
    group = np.array([sets.setdefault(items[a:b].tobytes(), len(sets)) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.int64)
    chain = np.full(len(flat), -1, dtype=np.int64)
    chain[start[depth == window]] = of[depth == window]
    held = [np.frombuffer(x, dtype=items.dtype) for x in sets]
    return Block(list(labels), flat, start[seen], depth[seen], group, np.concatenate([np.zeros(0, np.int64), *held]),
                 np.cumsum([0, *map(len, held)]), chain)


class Shard:
    """Suffix array of the words of some texts, ordered by the first `depth` words of each suffix."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int) -> None:
        n = np.diff(first)
        self.text = np.repeat(np.arange(len(n)), n + 1)  # of each place, the end mark of a text included
        self.first = first[:-1] + np.arange(len(n))
        words = np.full(len(hashes) + len(n), _END, dtype=np.uint64)
        inside = np.ones(len(words), dtype=bool)
        inside[first[1:] + np.arange(len(n))] = False
        words[inside] = hashes
        self.known, rank = np.unique(words, return_inverse=True)
        self.word = rank.astype(np.int64)
        rank, k = self.word, 1
        self.order = np.argsort(rank, kind="stable") if depth == 1 else None
        while k < depth:
            after = np.zeros(len(rank), dtype=np.int64)
            after[:-k] = rank[k:] + 1
            key = rank << 32 | after
            self.order = np.argsort(key)
            key = key[self.order]
            rank = np.empty(len(key), dtype=np.int64)
            rank[self.order] = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else 0
            k *= 2

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray, right: bool) -> np.ndarray:
        lo, hi, last = lo.copy(), hi.copy(), len(self.word) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            here = self.word[np.minimum(self.order[np.minimum(mid, last)] + depth, last)]
            below = (here <= wanted if right else here < wanted) & open_
            lo = np.where(below, mid + 1, lo)
            hi = np.where(below | ~open_, hi, mid)
        return lo

    def find(self, flat: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the windows flat[start:start + depth]: (index of the window, place in the shard) of every occurrence."""
        rank = np.searchsorted(self.known, flat)
        rank = np.where(self.known[np.minimum(rank, len(self.known) - 1)] == flat, rank, -1)
        live = np.arange(len(start))
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.word), dtype=np.int64)
        out = [(live[:0], lo[:0], hi[:0])]
        for d in range(int(depth.max(initial=0))):
            wanted = rank[start[live] + d]
            live, lo, hi, wanted = (x[wanted >= 0] for x in (live, lo, hi, wanted))
            lo, hi = self._bound(lo, hi, d, wanted, False), self._bound(lo, hi, d, wanted, True)
            some = lo < hi
            done = some & (depth[live] == d + 1)
            out.append((live[done], lo[done], hi[done]))
            live, lo, hi = (x[some & ~done] for x in (live, lo, hi))
            if not len(live):
                break
        which, lo, hi = (np.concatenate(x) for x in zip(*out))
        return np.repeat(which, hi - lo), self.order[_spread(lo, hi - lo)]


def _runs(at: np.ndarray, value: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Values at neighbouring places side by side, `end` behind each run; the values' new places; the longest run."""
    fresh = np.append(True, np.diff(at) != 1)
    new = np.arange(len(at)) + np.cumsum(fresh) - 1
    out = np.full(len(at) + fresh.sum(), end, dtype=np.int64)
    out[new] = value
    return out, new, int(np.diff(np.append(np.flatnonzero(fresh), len(at))).max())


def common_runs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For every left place the longest run of values from it on that is a run on the right too. Sides are (ascending places,
    values from 0); a run goes over neighbouring places. Work follows the number of places, however often values repeat."""
    (a, new, m), (b, _, k) = _runs(*left, -2), _runs(*right, -1)
    both, longest = np.concatenate([a, b]), min(m, k)
    levels = [np.unique(both, return_inverse=True)[1]]  # classes of 1, 2, 4, ... values
    while 1 << (len(levels) - 1) <= longest:
        levels.append(_pairs(levels[-1], 1 << (len(levels) - 1)))
    order = np.argsort(levels[-1], kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    from_right = order >= len(a)
    before = np.maximum.accumulate(np.where(from_right, np.arange(len(order)), -1))
    after = np.minimum.accumulate(np.where(from_right, np.arange(len(order)), len(order))[::-1])[::-1]
    best = np.zeros(len(new), dtype=np.int64)
    for near in (before[place[new]], after[place[new]]):
        there = (near >= 0) & (near < len(order))
        x, y = new[there], order[near[there]]
        size, last = np.zeros(len(x), dtype=np.int64), len(both) - 1
        for j in range(len(levels) - 2, -1, -1):
            same = levels[j][np.minimum(x + size, last)] == levels[j][np.minimum(y + size, last)]
            size += same.astype(np.int64) << j
        best[there] = np.maximum(best[there], size)
    return best


class Hits(NamedTuple):
    """What a document shares with the items: their names, intervals of words (start, length), the longest match and its place."""
    items: set[str]
    parts: list[tuple[int, int]]
    longest: int
    at: int | None

    def joined(self, other: Hits) -> Hits:
        longest, at = max((self.longest, self.at), (other.longest, other.at), key=lambda x: (x[0], -(x[1] or 0)))
        parts: list[tuple[int, int]] = []
        for a, n in sorted(self.parts + other.parts):
            if parts and a <= sum(parts[-1]):
                parts[-1] = (parts[-1][0], max(sum(parts[-1]), a + n) - parts[-1][0])
            else:
                parts.append((a, n))
        return Hits(self.items | other.items, parts, longest, at)


def matches(shard: Shard, block: Block, window: int) -> dict[int, Hits]:
    """Per text of the shard that holds a window of the block: its hits."""
    which, place = shard.find(block.flat, block.start, block.depth)
    if not len(which):
        return {}
    n, depth = len(shard.word), block.depth[which]
    marks = np.bincount(place, minlength=n + 1) - np.bincount(place + depth, minlength=n + 1)
    edge = np.diff(np.append(0, np.cumsum(marks) > 0).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found: dict[int, Hits] = {}
    length = np.zeros(n, dtype=np.int64)
    np.maximum.at(length, place, depth)
    full = depth == window
    if full.any():
        at, value = place[full], which[full]
        order = np.argsort(at)
        wanted = np.zeros(len(block.start), dtype=bool)
        wanted[value] = True
        right = np.flatnonzero((block.chain >= 0) & wanted[block.chain])
        length[at[order]] = common_runs((at[order], value[order]), (right, block.chain[right])) + window - 1
    hit = np.flatnonzero(length)
    hit = hit[np.lexsort((hit, -length[hit], shard.text[hit]))]
    text, best = np.unique(shard.text[hit], return_index=True)
    for t, p in zip(text.tolist(), hit[best].tolist()):
        found[t] = Hits(set(), [], int(length[p]), p - int(shard.first[t]))
    for t, a, e in zip(shard.text[begin].tolist(), begin.tolist(), end.tolist()):
        found[t].parts.append((a - int(shard.first[t]), e - a))
    sets = len(block.first) - 1
    pairs = np.unique(shard.text[place] * sets + block.group[which])
    size = np.diff(block.first)[pairs % sets]
    named = np.unique(np.repeat(pairs // sets, size) * len(block.items) + block.held[_spread(block.first[pairs % sets], size)])
    for t, i in zip((named // len(block.items)).tolist(), (named % len(block.items)).tolist()):
        found[t].items.add(block.items[i])
    return found


def test_blocks(items: DataFrame, id: str, text: str, window: int, limit: int) -> Iterator[Block]:
    """The items' windows in blocks of about `limit` words, made by tasks and read one at a time. An item longer than half a block
    is cut into pieces that share `window` - 1 words."""
    piece = max(1, limit // 2 - window + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tx.utf8(b.column("text"))
            for i, j in tx.runs(at):
                h, first = _hash(data, at[i:j + 1])
                names, parts = [], []
                for name, x, y in zip(b.column("item").slice(i, j - i).to_pylist(), first[:-1], first[1:]):
                    for k in range(x, max(x + (y > x), y - window + 1), piece):
                        names.append(name)
                        parts.append(h[k:min(y, k + piece + window - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["item", "words"])

    def packed(table: pa.Table) -> pa.Table:
        b = pack(table["item"].to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table["words"].to_pylist()], window)
        return pa.table({"block": table["block"][:1], "items": pa.array([b.items], pa.list_(pa.string())),
                         **{c: pa.array([getattr(b, c).tobytes()], pa.binary()) for c in Block._fields[1:]}})

    rows = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(split, "item string, words binary").distinct(), "test-words")
    words = pieces.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    count = int(-(-2 * words // limit))
    if count:
        schema = "block int, items array<string>, " + ", ".join(f"{c} binary" for c in Block._fields[1:])
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)).cast("int"))
        blocks = written(dealt.groupBy("block").applyInArrow(packed, schema), "test-blocks")
        for k in range(count):
            for r in blocks.where(F.col("block") == k).collect():
                yield Block(r["items"], np.frombuffer(r["flat"], np.uint64), *(np.frombuffer(r[c], np.int64) for c in Block._fields[2:]))
        remove(blocks)
    remove(pieces)


def _passes(items: DataFrame, id: str, text: str, window: int, limit: int) -> list[list[Broadcast]]:
    """Blocks as sent to the workers, by pass. The driver holds one of them at a time."""
    context = items.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in test_blocks(items, id, text, window, limit)]
    return [sent[k:k + PASS_BLOCKS] for k in range(0, len(sent), PASS_BLOCKS)]


def _shards(column: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray, Shard | None]]:
    """Runs of texts: index of the first text, words per text, suffix array (none without words)."""
    data, at = tx.utf8(column)
    for i, j in tx.runs(at):
        h, first = _hash(data, at[i:j + 1])
        yield i, np.diff(first), Shard(h, first, window) if len(h) else None


def find_matches(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, n_words, `items` (sorted names of those with a window in it), `hits` (intervals of words inside windows, apart
    from each other), `longest` (words of the longest verbatim match, 0 if none) and `longest_at` (its first word, the first if several)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<string>").alias("items"), F.array().cast(HITS).alias("hits"),
                       F.lit(0).cast("long").alias("longest"), F.lit(None).cast("long").alias("longest_at"))
    for sent in _passes(items, item_id, item_text, window, block_words) or [[]]:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield _searched(b, [s.value for s in sent], window)
            tx.trim()

        rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("text").withColumnRenamed("id", id)


def _searched(b: pa.RecordBatch, blocks: list[Block], window: int) -> pa.RecordBatch:
    """The batch with what its texts share with the blocks added to what is known."""
    before = zip(b.column("items").to_pylist(), b.column("hits").to_pylist(), b.column("longest").to_pylist(), b.column("longest_at").to_pylist())
    rows = [Hits(set(names), [(h["start"], h["length"]) for h in hits], *best) for names, hits, *best in before]
    words = np.zeros(b.num_rows, dtype=np.int64)
    for i, count, shard in _shards(b.column("text"), window):
        words[i:i + len(count)] = count
        for block in blocks if shard else ():
            for t, hits in matches(shard, block, window).items():
                rows[i + t] = rows[i + t].joined(hits)
    cols = [b.column("id"), b.column("text"), pa.array(words), pa.array([sorted(r.items) for r in rows], pa.list_(pa.string())),
            pa.array([[{"start": a, "length": n} for a, n in r.parts] for r in rows], _HITS),
            pa.array([r.longest for r in rows], pa.int64()), pa.array([r.at for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, b.schema.names)


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", **names) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside matches), n_items, items_sha256, longest, longest_at, contaminated."""
    found = find_matches(docs, items, id, **names)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["length"])
    return found.select(
        id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "longest", "longest_at", (F.size("hits") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                        window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any window of a test item, with all their columns as they were."""
    rows = docs
    for sent in _passes(items, item_id, item_text, window, block_words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    clean = np.ones(b.num_rows, dtype=bool)
                    for i, _, shard in _shards(b.column(text), window):
                        for block in (s.value for s in sent if shard):
                            clean[i + shard.text[shard.find(block.flat, block.start, block.depth)[1]]] = False
                    yield b.filter(pa.array(clean))
            tx.trim()

        rows = rows.mapInArrow(run, docs.schema)
    return rows
