"""Personal data, also where it is disguised: texts are normalised by transducers that remember where each character came from.

Fixed patterns (`email`, `ip`, `card`, `phone`) are read in the text as it stands and always reported. Then three transducers
run one after the other, each writing a new text and a map of its pieces:

* glyphs: compatibility forms (full width, mathematical, circled), decimal digits, spaces and dashes of any script and the
  lookalikes of LOOKALIKES become ASCII; invisible format characters go; O, o, l and I become 0 and 1 where rows of
  figures hold a few of them;
* digits: rows of digits that are spelled out (English, German, French, Spanish), also mixed with figures, become figures, "plus"
  before them "+" and "dot" between them ".";
* signs: "at" and "dot" in brackets, between hyphens, as character references or as words become "@" and ".", where a name, a host
  and a top level stand around them. Bare words need their partner in the same language and a top level of TOP.

The fixed patterns read the result. What depends on a rewritten place is mapped back to the characters that it was written from and
reported too, unless it lies in a finding of the text as it stands.

Null and empty texts have no findings. Texts are read whole; positions are code points. Repeated rows are read each by itself.
"""
from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenurekit.llm import text as tx

KINDS = ("email", "ip", "card", "phone")


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    value: str  # as it reads without disguise
    plain: bool  # found in the text as it stands


# --- fixed patterns ---------------------------------------------------------------------------------------------------

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never begins inside a row of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Name, @ and host; from each @ the name is read backwards, so a long word without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- transducers ------------------------------------------------------------------------------------------------------

class Written(NamedTuple):
    """A rewritten text and its pieces: where each begins here, where it came from, and whether it was copied."""
    text: str
    begin: list[int]
    source: list[tuple[int, int]]
    copied: list[bool]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source from which [start, end) was written."""
        i, j = bisect_right(self.begin, start) - 1, bisect_right(self.begin, end - 1) - 1
        a, b = self.source[i][0], self.source[j][1]
        if self.copied[i]:
            a += start - self.begin[i]
        if self.copied[j]:
            b = self.source[j][0] + end - self.begin[j]
        return a, b


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> Written:
    """`text` with [start, end) replaced, for each edit; edits ascend and don't overlap."""
    out, begin, source, copied, at, size = [], [], [], [], 0, 0
    for s, e, new in [*edits, (len(text), len(text), "")]:
        for a, b, part, same in ((at, s, text[at:s], True), (s, e, new, False)):
            if b > a:
                out.append(part)
                begin.append(size)
                source.append((a, b))
                copied.append(same)
                size += len(part)
        at = e
    return Written("".join(out), begin, source, copied)


#: fixed values: letters that look like ASCII letters
LOOKALIKES = {
    **dict(zip("АВЕКМНОРСТУХЅІЈԚԜ", "ABEKMHOPCTYXSIJQW")), **dict(zip("авекмнорстухѕіјԛԝһԁӏ", "abekmhopctyxsijqwhdl")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")), **dict(zip("αικνορτυχ", "aiknoptux")), "ı": "i", "ɡ": "g", "ⅼ": "l",
}
_LOOKED_AT = re.compile("[\xa0\xaa\xad\xb2\xb3\xb9\xbaĀ-\U0010ffff]")
_FIGURES = re.compile(r"(?<![^\W_])[0-9OolI]+(?:[.\x20-][0-9OolI]+)*(?![^\W_])")
_AS_DIGIT = str.maketrans("OolI", "0011")


@functools.lru_cache(maxsize=1 << 16)
def glyph(c: str) -> str:
    """What a character counts as: ASCII, nothing, or itself."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Pd":
        return "-"
    if kind == "Zs":
        return " "
    plain = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


def _glyphs(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _LOOKED_AT.finditer(text):
        new = glyph(m[0])
        if new != m[0]:
            out.append((m.start(), m.end(), new))
    return out


def _digitlike(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _FIGURES.finditer(text):
        letters = [(k, c) for k, c in enumerate(m[0], m.start()) if c in "OolI"]
        if letters and 2 * len(letters) <= sum(c.isdigit() for c in m[0]) + 1:
            out += [(k, k + 1, c.translate(_AS_DIGIT)) for k, c in letters]
    return out


#: fixed values: digits in words
SPELLED = {
    **{w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())}, "oh": "0",
    **{w: str(k) for k, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())}, "zwo": "2",
    **{w: str(k) for k, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(k) for k, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DOT_NAMES = ("dot", "punkt", "point", "punto")
_DOT_WORDS = "|".join(_DOT_NAMES)
_GAP = r"[\x20,()/-]{1,4}"
_DOT_GAP = rf"\x20{{0,3}}(?:[\[({{<]\x20{{0,3}}(?:{_DOT_WORDS}|\.)\x20{{0,3}}[\])}}>]|\b(?:{_DOT_WORDS})\b|\.)\x20{{0,3}}"
_LETTERS = re.compile(r"[^\W\d_]+")
_DOTTED = re.compile(rf"[0-9]\x20{{0,3}}[\[({{<]\x20{{0,3}}(?:{_DOT_WORDS}|\.)|[0-9]\x20{{1,3}}(?:{_DOT_WORDS})\b", re.I)
_ROW = re.compile(rf"(?:\b(?:plus|más)\b[\x20]{{0,3}})?\(?(?<![^\W_])(?:{_WORD}|[0-9]+)(?![^\W_])(?:(?:{_DOT_GAP}|{_GAP})(?:{_WORD}|[0-9]+)(?![^\W_]))+", re.I)
_PART = re.compile(rf"(?P<plus>\b(?:plus|más)\b[\x20]{{0,3}})|(?P<word>\b{_WORD}\b)|(?P<figure>[0-9]+)|(?P<dot>{_DOT_GAP})|(?P<gap>[\x20,()/-]+)", re.I)


def _may_be_spelled(text: str) -> bool:
    """Whether two spelled digits are neighbours among the words, or only a "dot" stands between them."""
    words = _LETTERS.findall(text.lower())
    hits = [k for k, w in enumerate(words) if w in SPELLED]
    return any(b == a + 1 or (b == a + 2 and words[a + 1] in _DOT_NAMES) for a, b in zip(hits, hits[1:]))


def _spelled(text: str) -> list[tuple[int, int, str]]:
    if not (_may_be_spelled(text) or _DOTTED.search(text)):
        return []
    out = []
    for row in _ROW.finditer(text):
        parts = [(m.lastgroup, m.start(), m.end()) for m in _PART.finditer(text, row.start(), row.end())]
        if sum(kind == "word" for kind, _, _ in parts) == 1:  # "un" and "one" are mostly no digits
            continue
        for k, (kind, s, e) in enumerate(parts):
            near = {parts[j][0] for j in (k - 1, k + 1) if 0 <= j < len(parts)}
            new = {"plus": "+", "word": SPELLED.get(text[s:e].lower()), "dot": ".", "gap": "" if "word" in near else None}.get(kind)
            if new is not None and new != text[s:e]:
                out.append((s, e, new))
    return out


#: fixed values: top levels after a bare "dot", and words that are no names beside a bare "at"
TOP = frozenset("com org net edu gov mil info biz io ai app dev co eu uk us de fr es it nl be ch at ca au jp cn ru br mx in pl se no dk fi".split())
NO_NAMES = frozenset("a an and are be been go he her him i is it look me not of or page she site that the them they this to us was we website were you".split())
_AT = re.compile(r"""(?P<sign>\x20{0,3}(?:[\[({<]\x20{0,3}(?:at|@|ät|arobase|arroba)\x20{0,3}[\])}>]|&\#0*64;|&commat;)\x20{0,3})|(?P<hyphen>(?:-at-|_at_))
    |\x20{1,3}(?P<bare>at|ät|arobase|arroba)\x20{1,3}|(?P<own>\x20{0,3}@\x20{0,3})""", re.I | re.X)
_PARTNERS = {"at": "dot|punkt", "ät": "punkt", "arobase": "point", "arroba": "punto"}
_CLEAR_DOT = rf"\x20{{0,3}}(?:[\[({{<]\x20{{0,3}}(?:{_DOT_WORDS}|\.)\x20{{0,3}}[\])}}>]|&\#0*46;|&period;)\x20{{0,3}}|[-_](?:dot)[-_]"
_LABEL = "[A-Za-z0-9]+(?:-(?!dot-)[A-Za-z0-9]+)*"
_NAME_END = 24  # characters in which a disguised dot of a name ends; the longest has fewer


@functools.lru_cache(maxsize=None)
def _dots(words: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A host, one of its dots, and a dot of a name at the end of a text, where these words may stand bare for a dot."""
    bare = rf"\x20{{1,3}}(?:{words})\x20{{1,3}}"
    dot = rf"(?:(?P<clear>{_CLEAR_DOT})|(?P<bare>{bare})|\.)"
    unnamed = rf"(?:{_CLEAR_DOT}|{bare}|\.)"
    return re.compile(rf"{_LABEL}(?:{unnamed}{_LABEL})+", re.I), re.compile(dot, re.I), re.compile(rf"(?:{_CLEAR_DOT}|{bare})\Z", re.I)


_PLAIN_NAME = _NAME - {"."}


_DISGUISED = re.compile(rf"[\[({{<]\x20{{0,3}}(?:at|@|ät|arobase|arroba|\.|{_DOT_WORDS})|&(?:\#0*(?:64|46);|commat;|period;)|[-_]at[-_]", re.I)


def _signs(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not (any(w in low for w in _DOT_NAMES) or _DISGUISED.search(text)):
        return []
    out, done = [], 0
    for at in _AT.finditer(text):
        if at.start() < done:
            continue
        word = (at["bare"] or "").lower()
        host, dot, name_dot = _dots(_PARTNERS.get(word, _DOT_WORDS))
        h = host.match(text, at.end())
        if not h:
            continue
        edits = [(m.start(), m.end(), ".") for m in dot.finditer(text, h.start(), h.end()) if m.lastgroup]
        bare = any(m["bare"] for m in dot.finditer(text, h.start(), h.end()))
        if (word or at["own"]) and not edits:
            continue
        last = re.search("[A-Za-z0-9]+$", h[0])[0].lower()
        if (last not in TOP or re.match("[A-Za-z0-9]+", h[0])[0].lower() in NO_NAMES) if bare else not last.isalpha() or len(last) < 2:
            continue
        # the name, backwards
        start, dots = at.start(), []
        while start > done:
            if text[start - 1] in _PLAIN_NAME or (text[start - 1] == "." and start < at.start()):
                start -= 1
                continue
            m = name_dot.search(text, max(done, start - _NAME_END), start)
            if not m or start == at.start() or m.start() == done or text[m.start() - 1] not in _PLAIN_NAME:
                break
            dots.append((m.start(), m.end(), "."))
            start = m.start()
        name = text[start:at.start()]
        if not name or (word and name.lower() in NO_NAMES):
            continue
        out += [*reversed(dots), *([(at.start(), at.end(), "@")] if text[at.start():at.end()] != "@" else []), *edits]
        done = h.end()
    return out


TRANSDUCERS = (_glyphs, _digitlike, _spelled, _signs)


def normalised(text: str) -> list[Written]:
    """What the transducers write, in order; only those that change something. The last one's text is the normalised text."""
    out = []
    for step in TRANSDUCERS:
        edits = step(text)
        if edits:
            out.append(rewrite(text, edits))
            text = out[-1].text
    return out


# --- the scan ---------------------------------------------------------------------------------------------------------

def scan(text: str | None) -> list[Finding]:
    """Findings in a text, by start and kind."""
    if not text:
        return []
    plain = patterns(text)
    out = [Finding(s, e, kind, text[s:e], True) for s, e, kind in plain]
    steps = normalised(text)
    if steps:
        reach = _reach(plain)
        for s, e, kind in patterns(steps[-1].text):
            value = steps[-1].text[s:e]
            if kind == "email" and not 2 <= len(value) - value.rfind(".") - 1 <= 24:
                continue
            for w in reversed(steps):
                s, e = w.back(s, e)
            k = bisect_right(plain, (s, len(text) + 1, "")) - 1
            if text[s:e] != value and not (k >= 0 and reach[k] >= e):
                out.append(Finding(s, e, kind, value, False))
        out.sort(key=lambda f: (f.start, KINDS.index(f.kind), f.end))
    return out


def _reach(spans: list[tuple[int, int, str]]) -> list[int]:
    """The furthest end of the spans up to each one."""
    out, most = [], 0
    for _, e, _ in spans:
        most = max(most, e)
        out.append(most)
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("value", T.StringType()), T.StructField("plain", T.BooleanType())])


def find_personal(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id and `spans`, an array of (kind, start, end, value without disguise, whether found as it stands)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(_SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("plain", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[f._asdict() for f in scan(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], schema.names)
        tx.trim()

    return rows.mapInArrow(run, schema)


def masked(text: str, found: list[Finding]) -> str:
    """The text with every finding replaced by its kind in brackets; findings that overlap are one, of the first one's kind."""
    out, at = [], 0
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if f.start >= at:
            out += [text[at:f.start], f"[{f.kind.upper()}]"]
        at = max(at, f.end)
    return "".join([*out, text[at:]])


def mask_personal(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every finding masked; `length`, if there is such a column, follows a text that was changed."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            found = [scan(t) for t in texts]
            if any(found):
                fresh = [masked(t, f) if f else t for t, f in zip(texts, found)]
                columns = {n: b.column(n) for n in names}
                columns[text] = pa.array(fresh, b.column(text).type)
                if length in columns:
                    n = [len(t) if f else x for t, f, x in zip(fresh, found, columns[length].to_pylist())]
                    columns[length] = pa.array(n, columns[length].type)
                b = pa.RecordBatch.from_arrays(list(columns.values()), names)
            yield b
        tx.trim()

    return docs.mapInArrow(run, schema)
