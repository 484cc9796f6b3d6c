import hashlib
import re
import time

from hypothesis import given, settings, strategies as st

from tenurekit.llm import personal as pd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_NO = "4111 1111 1111 1111"


def plain(text):
    """The fixed patterns as they are stated."""
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pd.KINDS.index(s[2])))


def extra(text):
    return [(f.kind, text[f.start:f.end], f.value) for f in pd.scan(text) if not f.plain]


PART = st.sampled_from(["a.b", "@", "x-1", ".", "com", "1", "25", "255", "256", "0", "4111", "1111", "+1", "(555)", "-", " ", "\n", "é", "at", "dot", " at ", "one", "[at]",
                        CARD_NO, "192.168.0.1", "​", "о", "１", "..", "@@", "+", "plus "])


@settings(max_examples=500, deadline=None)
@given(st.lists(PART, max_size=20).map("".join))
def test_fixed_patterns_stay(text):
    found = pd.scan(text)
    assert [(f.start, f.end, f.kind) for f in found if f.plain] == plain(text)
    for f in found:
        assert 0 <= f.start < f.end <= len(text)
    assert [(f.start, pd.KINDS.index(f.kind)) for f in found] == sorted((f.start, pd.KINDS.index(f.kind)) for f in found)


def test_disguises():
    cases = [
        ("email", "jane.doe (at) example (dot) com", "jane.doe@example.com"),
        ("email", "jane.doe[at]mail.example.org", "jane.doe@mail.example.org"),
        ("email", "jane at example dot com", "jane@example.com"),
        ("email", "Jane dot Doe AT Mail2 DOT example DOT co DOT uk", "Jane.Doe@Mail2.example.co.uk"),
        ("email", "jane@example[.]com", "jane@example.com"),
        ("email", "jane{at}example{dot}info", "jane@example.info"),
        ("email", "jane&#64;example&#46;com", "jane@example.com"),
        ("email", "jane-at-example-dot-com", "jane@example.com"),
        ("email", "jane arobase exemple point fr", "jane@exemple.fr"),
        ("email", "jane arroba ejemplo punto es", "jane@ejemplo.es"),
        ("email", "jane ät beispiel punkt de", "jane@beispiel.de"),
        ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "jane@example.com"),
        ("email", "jаne@exаmple.com", "jane@example.com"),
        ("email", "ja​ne@exam­ple.com", "jane@example.com"),
        ("ip", "192[.]168[.]0[.]1", "192.168.0.1"),
        ("ip", "192 dot 168 dot 0 dot 1", "192.168.0.1"),
        ("ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("ip", "١٩٢.168.0.1", "192.168.0.1"),
        ("ip", "l92.168.O.1", "192.168.0.1"),
        ("card", "４１１１ １１１１ １１１１ １１１１", CARD_NO),
        ("card", "4111 1111‑1111 1111", "4111 1111-1111 1111"),
        ("card", "four one one one one one one one one one one one one one one one", CARD_NO.replace(" ", "")),
        ("card", "4lll 11l1 1111 IIII".replace("lll", "111").replace("IIII", "1III"), CARD_NO),
        ("phone", "plus one five five five two zero one eight three four four", "+15552018344"),
        ("phone", "plus un cinq cinq cinq deux zéro un huit trois quatre quatre", "+15552018344"),
        ("phone", "plus eins fünf fünf fünf zwei null eins acht drei vier vier", "+15552018344"),
        ("phone", "más uno cinco cinco cinco dos cero uno ocho tres cuatro cuatro", "+15552018344"),
        ("phone", "+1 (555) two zero one 8344", "+1 (5552018344"),
        ("phone", "＋1 555 201 8344", "+1 555 201 8344"),
    ]
    for kind, written, value in cases:
        for before, after in (("é write to: ", "; or not."), ("", ""), ("x\n", "\ny")):
            text = before + written + after
            got = extra(text)
            assert [(k, v) for k, _, v in got] == [(kind, value)], (text, got)
            assert got[0][1] == written, (text, got)


def test_ordinary_prose_is_left_alone():
    prose = ["We met at the dot in the map and look at the point of it.", "Look at that. Dot com firms at large.", "He was at home (at last). One two three, four five!", "They arrived at 10 and left at 11.30.",
             "Version 1.2.3 of 12.10.2020 at 10:30", "un deux trois un six sept", "Sieben acht neun, eins zwei", "contact us at example dot com", "I was at school. dot. com", "10 lol 1o 20", "x² + y³ = 5½ №7",
             "Он был дома в 2020 году.", "1 2 3 4 5 6 7 8 9", "​​", "１２３", "see @ home dot", "me [at] the [dot] 5"]
    for text in prose:
        assert pd.scan(text) == [], (text, pd.scan(text))


def test_wider_and_inner_findings():
    text = "write jоhn@example.com now"  # the pattern sees only what stands behind the lookalike
    assert [(f.plain, text[f.start:f.end]) for f in pd.scan(text)] == [(False, "jоhn@example.com"), (True, "hn@example.com")]
    text = "a@b.com (at) c (dot) org"
    assert [f.plain for f in pd.scan(text)] == [True]


def test_maps():
    w = pd.rewrite("abcdef", [(1, 2, ""), (3, 5, "XYZ")])
    assert w.text == "acXYZf" and [w.back(i, i + 1) for i in range(6)] == [(0, 1), (2, 3), (3, 5), (3, 5), (3, 5), (5, 6)]
    assert w.back(0, 6) == (0, 6) and w.back(1, 2) == (2, 3)
    assert pd.rewrite("ab", []).text == "ab" and pd.rewrite("", []).text == ""


def test_long_texts_take_linear_time():
    t = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 400_000, "a@" * 400_000, "one " * 200_000, " at " * 200_000, "+1" * 400_000, "- " * 300_000, "a dot " * 100_000 + "at b dot com", "1 dot " * 100_000,
                 "а" * 300_000, "(" * 300_000, " " * 300_000, "lO" * 300_000):
        pd.scan(text)
    assert time.time() - t < 60


def test_operators(spark):
    rows = [(1, "é jane (at) example (dot) com, 10.0.0.1", 0, "x"), (1, None, None, "x"), (2, "", 7, "x"), (None, "+1 (743) 555-3824 +1 (743) 555-3824", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, spans string").withColumnRenamed("spans", "kind")
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end, s.value, s.plain) for s in r.spans]) for r in pd.find_personal(docs).collect())
    assert got == [("1", []), ("1", [("email", 2, 29, "jane@example.com", False), ("ip", 31, 39, "10.0.0.1", True)]), ("2", []),
                   ("None", [("phone", 0, 17, "+1 (743) 555-3824", True), ("phone", 18, 35, "+1 (743) 555-3824", True)])]
    masked = pd.mask_personal(docs)
    assert masked.columns == docs.columns
    assert sorted((str(r.text), r.n_chars) for r in masked.collect()) == [("", 7), ("None", None), ("[PHONE] [PHONE]", 15), ("é [EMAIL], [IP]", 15)]
    assert pd.find_personal(docs.limit(0)).count() == 0 and pd.mask_personal(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    from tenurekit.llm.queries import personal_data

    rows = [(k, f"a{k}@b.com 1.2.3.{k * 20} {CARD_NO}" + " x" * k + (" joe (at) c (dot) de" if k % 2 else "")) for k in range(20)] + [(None, None), (3, ""), (3, "a@b.co")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, more = [], 0
    for i, t in rows:
        found = plain(t or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in found)
        want.append((str(i), *(sum(k == kind for _, _, k in found) for kind in pd.KINDS), hashlib.sha256(line.encode()).hexdigest()))
    got = personal_data(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert sum(r.spans.count("email") > r.n_email for r in got) == 10
