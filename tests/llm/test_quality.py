import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tenurekit.llm import quality, text as tx

RULES = quality.Rules(min_words=5, base_window=3, coverage=((2, 60), (4, 30)))


def plain(text, rules):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        return {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}

    seen, n_dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                n_dup += 1
                dup_chars += len(re.sub(r"[\x20\x09-\x0D]", "", line))
            seen.add(line)
    x = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": n_dup,
         "n_repeat_words": len(inside(rules.base_window)), "dup_line_chars": dup_chars}
    for m, _ in rules.coverage:
        x[f"dup_{m}gram_chars"] = sum(len(words[i]) for i in inside(m))
    failed = x["n_words"] < rules.min_words or 100 * x["n_repeat_words"] > rules.base_share * x["n_words"]
    kept = not failed and 100 * dup_chars <= rules.line_share * x["word_chars"] and all(
        100 * x[f"dup_{m}gram_chars"] <= most * x["word_chars"] for m, most in rules.coverage)
    return x, failed, kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé b\n\t#\x0b|\x1c"), max_size=60), max_size=6))
def test_counts(texts):
    data, at = tx.utf8(pa.array(texts, pa.string()))
    for i, j in tx.runs(at, 40):
        got = quality.measure(data, at[i:j + 1], RULES)
        for k in range(i, j):
            assert {c: int(v[k - i]) for c, v in got.items()} == plain(texts[k], RULES)[0]


def test_rows(spark):
    texts = ["one two three four five six", "a b c a b c a b c", None, "", "same line here\n" * 9, "x " * 200_000, "one two three four five six"]
    docs = spark.createDataFrame([(k if k else None, t, "c") for k, t in enumerate(texts)], "doc_id int, text string, kept string")
    got = quality.repetition(docs, rules=RULES).collect()
    assert len(got) == len(texts)
    for r in got:
        x, failed, kept = plain((texts[r.doc_id or 0] or "")[:2000], RULES)
        assert (r.base_failed, r.kept) == (failed, kept)
    clean = quality.keep_clean(docs, rules=RULES)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["6", "None"]
    assert quality.repetition(docs.limit(0)).count() == 0


def test_only_windows_that_may_repeat_are_looked_up(monkeypatch):
    import numpy as np

    from tenurekit.llm import quality, text as tx

    ws = [f"w{k}" for k in range(6000)]
    ws[100:106] = ws[4000:4006] = ws[4003:4009] = list("abcabc")  # windows that overlap their own copy
    data, at = np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))])
    w = tx.words(data, at, tx.SPACED)
    sizes, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: (sizes.append(np.size(v)), search(a, v, *x, **y))[1])
    for n in (3, 4, 6):
        windows = [tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)]
        places = {}
        for k, x in enumerate(windows):
            places.setdefault(x, []).append(k)
        want = {k + i for x, at in places.items() if len(at) > 1 for k in at for i in range(n)}
        assert set(np.flatnonzero(quality.covered(w, n)).tolist()) == want
    assert max(sizes) < 100
