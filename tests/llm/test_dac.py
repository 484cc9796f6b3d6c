import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenurekit.llm import dac
from tenurekit.llm.queries import vocabulary_path

TEXTS = [(5, "The cat, the CAT"), (None, "no id"), (3, None), (4, ""), (5, "The cat, the CAT"), (1, "a\x1cb\x1d c\u0085d <|endoftext|>x"),
         (2, "long " * 30_000), (9, "naïve Ångström 12345 日本")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.data())
def test_any_token_and_any_span(ids, data):
    a = np.array(ids, dtype=np.uint32)
    codes = dac.Codes.from_bytes(dac.Codes.of(a).to_bytes())
    assert codes.span(0, len(a)).tolist() == ids
    for i in range(0, len(a), 97):
        assert codes.token(i) == ids[i]
    x = data.draw(st.integers(0, len(a)))
    y = data.draw(st.integers(x, len(a)))
    assert codes.span(x, y).tolist() == ids[x:y]


def test_files_hold_what_the_library_gives(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, part string")
    library = Tokenizer.from_file(vocabulary_path())
    segments = dac.write_tokens(docs, vocabulary_path(), segment_tokens=50)
    rows = {}
    for r in dac.read_tokens(segments).collect():
        rows.setdefault(r.doc_id, []).append(r)
    start = 0
    for i, t in sorted(TEXTS, key=lambda x: -1 if x[0] is None else x[0]):
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        r = min(rows[i], key=lambda r: r.start)
        rows[i].remove(r)
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        start += len(want)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in dac.checksums(segments).collect()}
    assert sums[None, 0] == zlib.crc32(np.array(library.encode("no id", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dac.checksums(dac.write_tokens(docs, vocabulary_path())).count() == 0


def test_bad_magic():
    with pytest.raises(ValueError):
        dac.Codes.from_bytes(b"nope" + bytes(40))


def test_table_of_words_is_bounded_and_exact():
    from tenurekit.llm import text as tx
    import pyarrow as pa

    library = Tokenizer.from_file(vocabulary_path())
    e = dac.WordEncoder(vocabulary_path(), kept=50)
    rng = np.random.default_rng(1)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    odd = ["a\u00a0b\u2003c", "x\x1cy\x1f z", "\u0085", "", "  lead and trail\n", thue + " " + thue.translate({97: 98, 98: 97}), "<|endoftext|>", "e\u0301 \u0301", "\x00 \x00\x00"]
    for _ in range(4):
        texts = odd + [" ".join(f"w{x}" for x in rng.integers(0, 200, 30)) for _ in range(20)]
        data, at = tx.utf8(pa.array(texts))
        ids, ends = e.encode(data, at, 7)
        want = [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert len(e.word) <= 400
