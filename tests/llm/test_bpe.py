import hashlib

from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tenurekit.llm import bpe
from tenurekit.llm.queries import vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
ODD = ["", "  ", "A\x1cb \x1d c", "x<|endoftext|>Y <|startoftext|>z", "ΑΣ ΣΑΣ. ΟΔΥΣΣΕΥΣ", "İstanbul ǅ ẞ", "é a\ńb", "don't I'LL 's 'S 12345 ½ Ⅷ",
       "日本語 한국어", "a\u0085b c d​e﻿", "😀👍🏽!!!??", "\x00\x01\x7f", ":\U0003d000", "\u1c89x\U000113c5!<|endoftext|>\U000113c5", "a" * 500, "'" * 50 + "s't", "word " * 20_000]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="thean ng'st.,!é<|>0", max_size=80)))
def test_ids_are_the_librarys(text):
    assert bpe.encoder(vocabulary_path()).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tables_that_overflow_change_nothing():
    e = bpe.Encoder(bpe.Vocabulary(vocabulary_path()), kept=4)
    for t in ODD:
        assert e.encode(t).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_operators(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*ODD, None])] + [(0, None, "x")], "doc_id int, text string, ids string")
    path = vocabulary_path()
    encoded = bpe.encode(docs, path)
    assert sorted(map(str, bpe.decode(encoded, path).collect()))
    for r in encoded.where("doc_id > 0").collect():
        want = LIBRARY.encode([*ODD, ""][r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()}
    for r in bpe.round_trip(docs, path).where("doc_id > 0").collect():
        want = LIBRARY.encode([*ODD, ""][r.doc_id], add_special_tokens=False).ids
        text = LIBRARY.decode(want, skip_special_tokens=False)
        assert decoded[r.doc_id] == text
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode(docs.limit(0), path).count() == 0
