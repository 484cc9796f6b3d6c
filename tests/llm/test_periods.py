import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tenurekit.llm import periods


def plain_runs(words, least=24, times=3):
    """Every period, every stretch; the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(*texts, **more):
    """Runs of texts of one-letter words that are handled together."""
    word = np.array([ord(c) for t in texts for c in t], np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = [[] for _ in texts]
    for s, n, q in zip(*(x.tolist() for x in periods.find_runs(word, text, **more))):
        k = int(text[s])
        out[k].append((s - int(first[k]), n, q))
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_with_many_repeats():
    assert runs_of("a" * 100 + "b" + "a" * 20) == [[(0, 100, 1)]]  # a candidate leads behind the last word
    a = [fibonacci(700), thue_morse(700), "a" * 300, ("a" * 100 + "b") * 5, "ab" * 40 + "a" + "ba" * 40, ("aab" * 9 + "c") * 4, "x" + "abcdefg" * 4 + "abz",
         ("a" * 64 + "b" + "a" * 30 + "c") * 4, ("abc" * 20 + "d") * 6 + "abc" * 30, "a" * 23, "a" * 24, "abcdefgh" * 3, "abcdefghi" * 3, "abcdefghi" * 2 + "abcdefgh", "", "q"]
    assert runs_of(*a) == [plain_runs(t) for t in a]
    assert runs_of("abcdefgh" * 3)[0] == [(0, 24, 8)] and runs_of("abcdefghi" * 2 + "abcdefgh")[0] == []


PIECE = st.tuples(st.text("abc", min_size=1, max_size=12), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=6).map("".join), min_size=1, max_size=3), st.integers(1, 4))
def test_against_brute_force(texts, repeat):
    texts = [t * repeat for t in texts]
    assert runs_of(*texts) == [plain_runs(t) for t in texts]
    assert runs_of(*texts, least=30, times=4) == [plain_runs(t, 30, 4) for t in texts]


def test_planted_periods():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(24, 900))
        words = [chr(200 + int(x)) for x in rng.integers(0, rng.choice([2, 5, 300]), n)]
        a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 3 + 1))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert runs_of(words)[0] == plain_runs(words)


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    values = rng.permutation(500)[:300]
    tree = periods.Wavelet(values.copy())
    lo = rng.integers(0, 300, 400)
    hi = np.minimum(300, lo + rng.integers(1, 300, 400))
    x = rng.integers(0, 700, 400)
    less = tree.count_below(lo, hi, x)
    assert less.tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
    k = rng.integers(0, hi - lo)
    assert tree.ranked(lo, hi, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(lo, hi, k.tolist())]


def test_limits_of_the_method():
    with pytest.raises(ValueError):
        runs_of("abc", least=20)
    with pytest.raises(ValueError):
        runs_of("abc", times=2)


def test_operator(spark):
    long = "to be or not " * 9 + "be\nthat"
    rows = [(1, None, "x"), (1, "", "x"), (2, " \n", "x"), (3, long, "x"), (3, long, "y"), (None, "é " * 30, "x"), (5, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "period")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect())
    assert got == sorted([("1", [], ""), ("1", [], ""), ("2", [], ""), ("5", [], "one two"), ("None", [(0, 30, 1)], "é")] + [("3", [(0, 36, 4)], "to be or not be that")] * 2)
    r = next(r for r in periods.periodic_runs(docs, digests=True).collect() if r.doc_id == 3)
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 36, 4, 9000)
    assert r.runs_sha256 == hashlib.sha256(b"0,36,4\n").hexdigest() and r.collapsed_sha256 == hashlib.sha256(b"to be or not be that").hexdigest()
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    assert periods._row([(5, 30, 3), (1, 40, 4), (1, 30, 3)])[1:5] == (1, 30, 3, 10_000)


def test_very_long_text():
    rng = np.random.default_rng(6)
    one = "w " * 300_000
    prose = " ".join(f"x{i}" for i in rng.integers(0, 50_000, 300_000))
    planted = " ".join([f"y{i}" for i in range(70_000)] * 4)
    t = time.time()
    import pyarrow as pa
    from tenurekit.llm import text as tx

    data, at = tx.utf8(pa.array([one, prose, planted]))
    found = [x for i, j in tx.runs(at, periods.CHUNK_BYTES) for x in periods._of_texts(data, at[i:j + 1], 24, 3)]
    assert [r for r, _ in found] == [[(0, 300_000, 1)], [], [(0, 280_000, 70_000)]]
    assert time.time() - t < 60 and found[0][1] == b"w" and len(found[2][1].split()) == 70_000


def test_query_against_brute_force(spark, tmp_path):
    import zlib

    from tenurekit.llm.queries import periodic_documents

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 120)))) for i in range(300)]
    rows += [(300, None), (None, "a " * 50), (13, "  lead and\ttrail \n"), (42, "x y " * 30), (42, "x y " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((str(i), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    got = [(str(r.doc_id), *r[1:]) for r in periodic_documents(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[1] for w in want) > 10
