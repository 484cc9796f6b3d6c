import hashlib
import random
import re

import numpy as np

from tenurekit.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def plain(text, items, window):
    ws, hit, found, longest = words(text), set(), set(), 0
    for i, t in items:
        q = words(t)
        n = min(window, len(q))
        for a in range(max(0, len(q) - n + 1) if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p:p + n] == q[a:a + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
                    k = n
                    while a + k < len(q) and p + k < len(ws) and q[a + k] == ws[p + k]:
                        k += 1
                    longest = max(longest, k)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), longest, bool(hit)


def test_against_every_place(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice(["a", "B", "the", "é1", "x9"]) + rng.choice(["", ".", "!"]) for _ in range(n))
    items = [(k, draw(rng.choice([1, 3, 4, 7, 12]))) for k in range(12)] + [(12, None), (13, "..."), (2, "THE the, b"), (None, "x9 x9 x9 x9 x9")]
    docs = [(k, draw(rng.randrange(60))) for k in range(40)] + [(40, None), (40, ""), (None, items[3][1]), (5, "B a! the é1 " * 30)]
    left = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, hits string")
    right = spark.createDataFrame(items, "item_id int, text string")
    named = [("" if i is None else i, t) for i, t in items]
    for block in (1 << 20, 25):  # one block; several
        got = dc.contamination(left, right, window=4, block_words=block).collect()
        want = sorted((str(i), *plain(t, named, 4)) for i, t in docs)
        rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.longest, r.contaminated) for r in got)
        if block == 25:  # a match that goes on in another block is told in parts
            rows, want = ([(*r[:5], r[6]) for r in x] for x in (rows, want))
        assert rows == want
        clean = dc.remove_contaminated(left, right, window=4, block_words=block)
        assert clean.columns == left.columns
        assert sorted(str(r.text) for r in clean.collect()) == sorted(str(t) for _, t in docs if not plain(t, named, 4)[-1])


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [(r.n_words, r.n_hit) for r in dc.contamination(docs, none).collect()] == [(2, 0)]
    assert dc.remove_contaminated(docs, none).count() == 1
    assert dc.contamination(docs.limit(0), docs.select("text", docs.doc_id.alias("item_id"))).count() == 0


def test_order_of_suffixes():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 4, 300).astype(np.uint64)
    shard = dc.Shard(h, np.array([0, 120, 120, 300]), 8)
    flat = np.concatenate([h[:120], [0], [0], h[120:], [0]]).tolist()
    keys = [tuple(flat[i:i + 8]) for i in shard.order]
    assert keys == sorted(keys) and sorted(shard.order.tolist()) == list(range(303))


def test_longest_common_runs():
    rng = random.Random(9)
    for _ in range(60):
        sides = []
        for n in (30, 25):
            at = sorted(rng.sample(range(40), rng.randrange(1, n)))
            sides.append((np.array(at), np.array([rng.randrange(2) for _ in at])))
        left, right = (dict(zip(at.tolist(), value.tolist())) for at, value in sides)

        def reach(p, q):
            k = 0
            while p + k in left and left[p + k] == right.get(q + k):
                k += 1
            return k

        assert dc.common_runs(*sides).tolist() == [max(reach(p, q) for q in right) for p in left]


def test_windows_of_a_block():
    """Every window of every item once, with the names of all items that hold it; equal items and names given twice."""
    parts = [[5, 6, 7, 5, 6, 7], [5, 6], [6, 7, 5, 9], [], [5, 6], [7], [5, 6, 7]]
    names = ["a", "b", "c", "d", "e", "a", "b"]
    block = dc.pack(names, [np.array(x, dtype=np.uint64) for x in parts], 3)
    want = {}
    for name, x in zip(names, parts):
        for k in range(max(1, len(x) - 2) if x else 0):
            want.setdefault(tuple(x[k:k + 3]), set()).add(name)
    got = {tuple(block.flat[a:a + n].tolist()): {block.items[i] for i in block.held[block.first[g]:block.first[g + 1]]}
           for a, n, g in zip(block.start, block.depth, block.group)}
    assert got == want and len(block.start) == len(want)


def test_equal_words_over_and_over(spark):
    """A text and an item of 100,000 equal words: marked by ranges, not pair by pair."""
    import time
    docs = spark.createDataFrame([(1, "z " * 100_000), (2, "q z " * 9), (3, "z " * 9 + "y")], "doc_id int, text string")
    items = spark.createDataFrame([(k, "z " * n + "w") for k, n in enumerate((100_000, 12, 9))], "item_id int, text string")
    begin = time.time()
    rows = {r.doc_id: r for r in dc.contamination(docs, items).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[1].longest, rows[1].longest_at) == (100_000, 2, 100_000, 0)
    assert [(rows[k].n_hit, rows[k].n_items, rows[k].longest, rows[k].longest_at) for k in (2, 3)] == [(0, 0, 0, None)] * 2
    assert time.time() - begin < 30  # a few seconds; pairs would need 80 GB


def test_many_blocks_in_several_passes(spark):
    """More blocks than one pass takes give what one block gives; items of one text in a third of all rows."""
    rng = random.Random(1)
    draw = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [draw(40) for _ in range(60)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(k, texts[0]) for k in (None, 7, 7, *range(100, 130))], "item_id int, text string")
    docs = spark.createDataFrame([(k, f"{draw(5)} {' '.join(texts[k % 60].split()[:30])} {draw(5)} {texts[0] if k % 3 else ''}") for k in range(90)], "doc_id int, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "longest", "longest_at", "contaminated"]
    one, many = (sorted(map(tuple, dc.contamination(docs, items, block_words=n).select(*cols).collect())) for n in (1 << 20, 300))
    assert len(dc._passes(items, "item_id", "text", dc.WINDOW, 300)) > 1
    assert one == many and all(r[2] >= 30 for r in one)
