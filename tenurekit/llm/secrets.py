"""Secret scans: fixed patterns, and a character network over every other candidate with its surroundings.

Fixed patterns (`assign`, `access`, `hex`) are always reported. Candidates are maximal runs of 16 or more of the letters
A-Z a-z 0-9 + / _ = - that hold a letter; of a run that touches fixed findings, every piece outside them. The
network sees regions of HEAD characters that slide over the whole candidate, each with CONTEXT characters before and after it:
embedding, one convolution, maxima over the three parts, one logit; a candidate has the highest probability of its regions.
It is trained in numpy on the candidates that the scan finds in labelled texts, which `labelled_texts` makes from a fixed seed
(SAMPLES of them); a held-out part calibrates the logit, and the threshold is the highest that still finds RECALL of the
held-out secrets, where a secret counts as found if fixed findings and reported candidates cover all of it.

Null and empty texts have no findings. Texts are read whole; positions are code points. Repeated rows are read each by itself.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenurekit.llm import text as tx

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CONTEXT, HEAD = 24, 40
STEP = 16  # any 24 characters of a candidate stand in one region
SAMPLES, RECALL = 4000, 0.98  # labelled findings used for training and calibration; least share found
_CANDIDATE = 16


def _table(letters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(letters.encode())] = True
    return out


_RUN, _HEXA = _table(string.ascii_letters + string.digits + "+/_=-"), _table("0123456789abcdef")
_LETTER = _table(string.ascii_letters)
_CODE = np.array([b - 31 if 32 <= b < 127 else 96 if b >= 127 else 97 for b in range(256)], dtype=np.uint8)  # 0 is padding
_CODES = 98


# --- the network ------------------------------------------------------------------------------------------------------

def windows(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    """Character codes of the regions of one candidate (bytes a to b) and their surroundings, one row each. `codes`: of the
    whole text, with CONTEXT of padding before it and CONTEXT + HEAD after it. Regions of HEAD characters begin STEP apart, the
    last one ends with the candidate."""
    if b - a < HEAD:
        out = np.zeros((1, 2 * CONTEXT + HEAD), dtype=np.uint8)
        out[0, :CONTEXT + b - a] = codes[a:CONTEXT + b]
        out[0, CONTEXT + HEAD:] = codes[CONTEXT + b:2 * CONTEXT + b]
        return out
    return np.lib.stride_tricks.sliding_window_view(codes, 2 * CONTEXT + HEAD)[region_starts(a, b)]


def padded(raw: bytes) -> np.ndarray:
    return np.pad(_CODE[np.frombuffer(raw, np.uint8)], (CONTEXT, CONTEXT + HEAD))


def region_starts(a: int, b: int) -> np.ndarray:
    return np.append(np.arange(a, max(a, b - HEAD), STEP), max(a, b - HEAD))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Embedding (8), convolution of 5 characters (24 filters), maxima over three regions, logit; trained by Adam."""

    WIDTH, EMBED, FILTERS = 5, 8, 24
    REGIONS = ((0, CONTEXT), (CONTEXT, CONTEXT + HEAD), (CONTEXT + HEAD, 2 * CONTEXT + HEAD))

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = {"embed": rng.normal(0, 0.5, (_CODES, self.EMBED)), "conv": rng.normal(0, 0.2, (self.WIDTH * self.EMBED, self.FILTERS)),
                  "bias": np.zeros(self.FILTERS), "out": rng.normal(0, 0.1, 3 * self.FILTERS), "free": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        pad = np.pad(x, ((0, 0), (self.WIDTH // 2, self.WIDTH // 2)))
        seen = np.lib.stride_tricks.sliding_window_view(pad, self.WIDTH, axis=1)
        flat = self.w["embed"][seen].reshape(*x.shape, -1)
        active = flat @ self.w["conv"] + self.w["bias"]
        best = [active[:, a:b].argmax(axis=1) + a for a, b in self.REGIONS]
        pooled = np.concatenate([np.take_along_axis(active, p[:, None, :], 1)[:, 0] for p in best], axis=1)
        return seen, flat, best, pooled, np.maximum(pooled, 0) @ self.w["out"] + self.w["free"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k:k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.logit(x) + self.shift)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        seen, flat, best, pooled, z = self._forward(x)
        d = (_sigmoid(z) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["free"][0] = np.maximum(pooled, 0).T @ d, d.sum()
        up = d[:, None] * self.w["out"] * (pooled > 0)
        rows, n = np.arange(len(x))[:, None], self.FILTERS
        for r, place in enumerate(best):  # only the places of the maxima have a gradient
            part = up[:, r * n:(r + 1) * n]
            at = flat[rows, place]  # sample, filter, inputs
            g["conv"] += np.einsum("sfi,sf->if", at, part)
            g["bias"] += part.sum(axis=0)
            back = (part[:, :, None] * self.w["conv"].T[None]).reshape(len(x), n, self.WIDTH, self.EMBED)
            np.add.at(g["embed"], seen[rows, place], back)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // size)):
                t += 1
                for k, g in self._gradient(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Scale and shift of the logit by Newton steps on held-out findings, held near (1, 0) by a penalty where these are
        told apart fully."""
        z = np.stack([self.logit(x), np.ones(len(x))], axis=1)
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # keeps the scale finite
        start = w = np.array([1.0, 0.0])
        loss = lambda w: np.logaddexp(0, z @ w).sum() - soft @ (z @ w) + 2.5 * ((w - start) ** 2).sum()
        for _ in range(30):
            p = _sigmoid(z @ w)
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 5 * np.eye(2), z.T @ (p - soft) + 5 * (w - start))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:  # a full step may go too far
                step = step / 2
            w = w - step
        self.scale, self.shift = w

    def choose(self, texts: list[tuple[str, int, int]], recall: float = RECALL) -> None:
        """The highest threshold that still finds that share of the secrets of these texts; raises if there is none."""
        found = np.sort([weakest for weakest, (_, s, e) in zip(weakest_parts(texts, self), texts) if e > s])
        self.threshold = float(found[int((1 - recall) * len(found))])
        if self.threshold <= 0:
            raise ValueError("too many secrets are not candidates")


_LETTERS = np.array(list(string.ascii_letters + string.digits))


def labelled_texts(n: int = SAMPLES, seed: int = 3) -> list[tuple[str, int, int]]:
    """Texts with the place of their secret (an empty one in every other text), from a fixed seed."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    rand = lambda k: "".join(rng.choice(_LETTERS, k))
    word = lambda: "".join(pick("an", "the", "ti", "on", "re", "sh", "er", "ing", "ou", "ment", "de", "lo", "ra", "ver") for _ in range(rng.integers(1, 5)))
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    onset = "b c ch d f fl g gr h j k l m n p pf ph pr qu r s sch sh st str t th tr v w z zw".split() + [""] * 8
    coda = "b ch ck f g gs l ld m n nd ng ns nt ps r rs s sch ss st t th tz x".split() + [""] * 16
    part = lambda: pick(*onset) + pick(*"a e e i o u ai au aux ea ee ei eu eux ia ie io ou oi ui y".split()) + pick(*coda)
    term = lambda a, b: "".join(pick(part, word)() for _ in range(rng.integers(a, b)))
    path = lambda: "".join(pick(word, lambda: term(1, 4))() + "/" for _ in range(rng.integers(1, 9)))
    near = lambda: " ".join(word() for _ in range(6))
    secret = [
        lambda: (pick("key ", "Bearer ", "credential ", "auth=", "pwd: ", "access ", "export KEY=", "key: ", ""), rand(rng.integers(20, 60))),
        lambda: (pick("", "git ", "use "), pick("ghp_", "gho_", "glpat-", "npm_", "hf_") + rand(36)),
        lambda: (pick("", "slack ", "hook "), pick("xoxb-", "xoxp-") + digits(11) + "-" + rand(24)),
        lambda: (pick("sk ", "", "stripe "), pick("sk_live_", "rk_live_", "sk-") + rand(rng.integers(24, 48))),
        lambda: (pick("", "jwt ", "Authorization: Bearer "), "eyJ" + rand(rng.integers(30, 60))),
        lambda: (pick("", "AWS_KEY=", "aws "), base64.b64encode(rng.bytes(30)).decode()),
        lambda: (pick("", "google "), "AIza" + rand(35)),
        lambda: (pick("key ", "Bearer ", "auth=", "pwd: ", ""), "".join(rng.choice(_LETTERS[:52], rng.integers(20, 60)))),
        lambda: (pick("", "/", "https:/") + path(), rand(rng.integers(20, 44)) + pick("", "/" + path())),
        lambda: ("", "AKIA" + rand(16).upper() + pick("/", "=") + rand(40)),
        lambda: (pick("", "git ", "use "), pick("ghp_", "gho_", "glpat-") + hashlib.md5(rng.bytes(4)).hexdigest() + rand(rng.integers(4, 9))),
    ]
    other = [
        lambda: ("", "-".join(word() for _ in range(rng.integers(3, 7))) + "-" + digits(rng.integers(1, 5))),
        lambda: (pick("img ", "file ", "/"), pick("IMG", "DSC", "scan") + "_" + digits(8) + "_" + digits(6)),
        lambda: (pick("on ", "at ", ""), f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}Z"),
        lambda: (pick("id ", "uuid ", "/"), "-".join(hashlib.md5(rng.bytes(4)).hexdigest()[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))),
        lambda: (pick("see ", "in ", "https:"), "/" + "/".join([word(), word(), digits(rng.integers(1, 6)), word()])),
        lambda: (pick("", "the "), word() + word() + word() + word() + digits(rng.integers(1, 5)) + word()),
        lambda: (pick("", "call "), "tel-" + "-".join(digits(3) for _ in range(4))),
        lambda: (pick("", "class="), "_".join(word() for _ in range(4)) + "_v" + digits(2)),
        lambda: (pick("", "isbn "), "ISBN-" + digits(3) + "-" + digits(10)),
        lambda: (pick("", "= "), "=" * rng.integers(10, 20) + word() + digits(2) + "=" * rng.integers(4, 10)),
        lambda: (pick("", "a "), pick(str, str, str.capitalize, str.upper)(term(5, 14))),
        lambda: (pick("", "the "), pick("-", "_", "/").join(term(1, 4) for _ in range(rng.integers(3, 12)))),
        lambda: (pick("", "call "), "".join(term(1, 3).capitalize() for _ in range(rng.integers(3, 8)))),
        lambda: (pick("see ", "/", "https:/"), "".join(path() for _ in range(rng.integers(1, 5))) + pick("", digits(3), "v" + digits(1))),
        lambda: (pick("", "sum ", "/" + path()), pick("sha256=", "commit/", "id-", "") + hashlib.sha256(rng.bytes(4)).hexdigest()[:int(pick(32, 40, 64))] + pick("", "/", "-" + digits(1))),
    ]
    out = []
    for k in range(n):
        before, found = pick(*(secret if k % 2 else other))()
        head = near() + " " + before
        out.append((head + found + pick("", ".", "\"", " ", "\n", ",") + " " + near(), len(head), len(head) + len(found) * (k % 2)))
    return out


def _scanned(texts: list[tuple[str, int, int]]) -> tuple:
    return candidates(*tx.utf8(pa.array([t for t, _, _ in texts], pa.string())))


def findings(texts: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the candidates in labelled texts with label 1 (the region holds 24 characters of the secret, or all that the
    candidate has of it) or 0 (none); the others are left out."""
    _, where, held = _scanned(texts)
    rows, labels = [], []
    for (k, a, b), x in zip(where, held):
        _, s, e = texts[k]
        starts, mine = region_starts(a, b), min(e, b) - max(s, a)
        # a short piece is judged by regions of its run
        shared = np.minimum(e, np.minimum(starts + HEAD, b)) - np.maximum(s, starts) if len(starts) == len(x) else np.full(len(x), mine)
        clear = (shared <= 0) | (shared >= min(24, mine))
        rows.append(x[clear])
        labels.append(shared[clear] > 0)
    return np.concatenate(rows), np.concatenate(labels).astype(float)


def labelled_findings(n: int = SAMPLES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    return findings(labelled_texts(n, seed))


def weakest_parts(texts: list[tuple[str, int, int]], net: Network) -> list[float]:
    """Of the secret of each labelled text: the lowest threshold at which it is missed. 1 if fixed findings cover all of it, 0
    if a part of it is neither in them nor in a candidate."""
    fixed, where, held = _scanned(texts)
    out, open_ = [1.0] * len(texts), [set(range(s, e)) for _, s, e in texts]
    for k, found in enumerate(fixed):
        for a, b, _ in found:
            open_[k] -= set(range(a, b))
    for (k, a, b), p in zip(where, best(held, net)):
        if open_[k] and max(a, texts[k][1]) < min(b, texts[k][2]):
            out[k] = min(out[k], float(p))
            open_[k] -= set(range(a, b))
    return [0.0 if left else p for p, left in zip(out, open_)]


@functools.lru_cache(maxsize=1)
def trained() -> Network:
    """The network on labelled texts: 70 % train, 30 % calibrate it."""
    texts = labelled_texts()
    cut = int(0.7 * len(texts))
    net = Network()
    net.train(*findings(texts[:cut]))
    net.calibrate(*findings(texts[cut:]))
    net.choose(texts[cut:])
    return net


# --- the scan ---------------------------------------------------------------------------------------------------------

def fixed_findings(text: str, hexa: bool = True) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and kind. `hexa`: whether the text can hold 32 hexadecimal characters."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexa:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _runs(data: np.ndarray, at: np.ndarray, letters: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the letters inside one text, of at least `least` bytes."""
    inside = letters[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    a = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])[:len(data)]))
    b = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)[:len(data)])) + 1
    long = b - a >= least
    return a[long], b[long]


def rest(run: tuple[int, int], found: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """Pieces of a run outside the fixed findings (by start), and whether the run is what the network judges them by.

    A piece shorter than a candidate has the verdict of its run: it may be the end of a key that a fixed finding covers for
    the most part. Such a piece before `assign` is left out, as its pattern takes the value to the end of the run.
    """
    at, out = run[0], []
    for s, e, kind in found:
        if s > at:
            out.append((at, s, s - at < _CANDIDATE, kind == "assign"))
        at = max(at, e)
    if at < run[1]:
        out.append((at, run[1], bool(found) and run[1] - at < _CANDIDATE, False))
    return [(s, e, short) for s, e, short, name in out if not (short and name)]


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[list[list[tuple[int, int, str]]], list[tuple[int, int, int]], list[np.ndarray]]:
    """Fixed findings of each text data[at[k]:at[k + 1]]; candidates (text, start, end) and the windows that each is judged by."""
    data, at = data[at[0]:at[-1]], at - at[0]
    n = len(at) - 1
    hexa = np.zeros(n, bool)
    hexa[np.searchsorted(at, _runs(data, at, _HEXA, 32)[0], "right") - 1] = True
    a, b = _runs(data, at, _RUN, _CANDIDATE)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    named = letters[b] > letters[a]
    a, b = a[named], b[named]
    first = np.searchsorted(a, at)
    out, where, held = [], [], []
    for k in range(n):
        raw = data[at[k]:at[k + 1]].tobytes()
        text = raw.decode()
        found = fixed_findings(text, bool(hexa[k]))
        out.append(found)
        next_, reach = 0, []  # findings that may touch the run
        start = byte = 0
        codes = padded(raw) if first[k] < first[k + 1] else None
        for x, y in zip((a[first[k]:first[k + 1]] - at[k]).tolist(), (b[first[k]:first[k + 1]] - at[k]).tolist()):
            start, byte = start + len(raw[byte:x].decode()), x
            end = start + y - x  # ASCII
            while next_ < len(found) and found[next_][0] < end:
                reach.append(found[next_])
                next_ += 1
            reach = [f for f in reach if f[1] > start]
            for s, e, whole in rest((start, end), reach):
                where.append((k, s, e))
                held.append(windows(codes, *((x, y) if whole else (x + s - start, x + e - start))))
    return out, where, held


def best(held: list[np.ndarray], net: Network) -> np.ndarray:
    """The highest probability of the windows of each candidate."""
    if not held:
        return np.zeros(0)
    return np.maximum.reduceat(net.probability(np.concatenate(held)), np.cumsum([0, *(len(h) for h in held[:-1])]))


def scan(data: np.ndarray, at: np.ndarray, net: Network) -> list[list[tuple[int, int, str]]]:
    """Findings of each text data[at[k]:at[k + 1]]."""
    out, where, held = candidates(data, at)
    for (k, s, e), p in zip(where, best(held, net)):
        if p >= net.threshold:
            out[k].append((s, e, "model"))
    for k in {k for k, _, _ in where}:
        out[k].sort(key=lambda f: (f[0], KINDS.index(f[2])))
    return out


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id and `spans`, an array of (kind, start, end)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))])
    net = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tx.utf8(b.column("text"))
            found = [f for i, j in tx.runs(at) for f in scan(data, at[i:j + 1], net)]
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], schema.names)
        tx.trim()

    return rows.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int]], sign: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], sign]
            at = e
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", sign: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every finding replaced by `sign`; `length`, if there is such a column, follows the text."""
    net = trained()
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tx.utf8(b.column(text))
            found = [f for i, j in tx.runs(at) for f in scan(data, at[i:j + 1], net)]
            if any(found):
                texts = b.column(text).to_pylist()
                fresh = [mask(t, [(s, e) for s, e, _ in f], sign) if f else t for t, f in zip(texts, found)]
                columns = {n: b.column(n) for n in names}
                columns[text] = pa.array(fresh, b.column(text).type)
                if length in columns:
                    n = [len(t) if f else x for t, f, x in zip(fresh, found, columns[length].to_pylist())]
                    columns[length] = pa.array(n, columns[length].type)
                b = pa.RecordBatch.from_arrays(list(columns.values()), names)
            yield b
        tx.trim()

    return docs.mapInArrow(run, schema)
