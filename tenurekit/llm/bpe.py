"""BPE encoding and decoding from a published vocabulary file.

Each word is a doubly linked list of symbols; a heap holds (merge rank, position) of neighbouring pairs, and entries whose
pair is gone are skipped when they come up. Words repeat, so results are kept in tables of bounded size; this changes
time only. Decoding joins vocabulary strings by one space, as the file names no decoder.

Null texts count as empty and give no ids. Rows are handled one by one, so ties and repeated rows need no rule.
"""
from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tenurekit.llm import text as tx

KEPT_WORDS = 400_000  # entries of a table of words; a Python worker keeps two
_BITS, _MASK = 24, (1 << 24) - 1  # of an id in a packed integer
_SPACE = regex.compile(r"\s+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")  # space for str.split, but not for the vocabulary's pattern


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Vocabulary:
    """What the file states: normaliser, word pattern, word end, merges and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError(f"{path}: only lower-casing byte-level BPE with word ends is supported")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.kind = np.dtype("<u2") if len(self.strings) <= 1 << 16 else np.dtype("<u4")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.library = Tokenizer.from_file(path)  # for its character tables only
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + end] for s in symbols]
        #: pair of ids -> rank of its merge and the new id, both packed into one integer
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a] << _BITS | self.ids[b]] = rank << _BITS | self.ids[a + b]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one word of the pattern, given as UTF-8."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, find = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [m >> _BITS << 32 | i for i in range(n - 1) if (m := find(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or (m := find(ids[i] << _BITS | ids[j])) is None or m >> _BITS != entry >> 32:
                continue  # stale: one of the pair has been merged since
            new, k, h = m & _MASK, after[j], before[i]
            ids[i], ids[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                if (m := find(new << _BITS | ids[k])) is not None:
                    heapq.heappush(heap, m >> _BITS << 32 | i)
            if h >= 0 and (m := find(ids[h] << _BITS | new)) is not None:
                heapq.heappush(heap, m >> _BITS << 32 | h)
        return [x for x in ids if x >= 0]


def normal(s: str) -> str:
    if s.isascii():
        return s.lower()
    s = _SPACE.sub(" ", unicodedata.normalize("NFC", s))
    return "".join(map(str.lower, s)) if "Σ" in s else s.lower()  # no final sigma: characters are lowered one by one


class _Table(dict):
    """A dict that makes missing values. When it holds `limit` entries a new one begins; what is still in use comes over."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Texts to ids. No word of the pattern goes over white space, so texts are encoded by words between spaces."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT_WORDS) -> None:
        self.vocabulary = vocabulary
        code = "H" if vocabulary.kind.itemsize == 2 else "I"
        self._pieces = _Table(lambda p: array.array(code, vocabulary.merge(p.encode())).tobytes(), kept // 2)
        self._words = _Table(self._word, kept)

    def _word(self, text: str) -> bytes:
        v, out = self.vocabulary, []
        if not text.isascii() and "Cn" in map(unicodedata.category, text):
            return b"".join(map(self._parts, v.cut.split(text)))
        if not any(x in text for x in v.special):
            text = normal(text)
            return self._pieces[text] if text.isalpha() else b"".join(map(self._pieces.__getitem__, v.word.findall(text)))
        for part in v.cut.split(text):
            if part in v.special:
                out.append(np.array([v.special[part]], dtype=v.kind).tobytes())
            else:
                out.extend(map(self._pieces.__getitem__, v.word.findall(normal(part))))
        return b"".join(out)

    def _parts(self, part: str) -> bytes:
        """For characters newer than Python's Unicode tables: the library's own tables say what they are."""
        v = self.vocabulary
        if part in v.special:
            return np.array([v.special[part]], dtype=v.kind).tobytes()
        words = v.library.pre_tokenizer.pre_tokenize_str(v.library.normalizer.normalize_str(part))
        return b"".join(np.array(v.merge(bytes(map(v.byte.__getitem__, w))), dtype=v.kind).tobytes() for w, _ in words)

    def forget(self) -> None:
        """Empties the tables at the end of a task, so that an idle worker holds little."""
        for table in (self._pieces, self._words):
            table.older = {}
            table.clear()
        tx.trim()

    def encode(self, text: str) -> np.ndarray:
        words = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        return np.frombuffer(b"".join(map(self._words.__getitem__, words)), dtype=self.vocabulary.kind)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    return " ".join(map(vocabulary.strings.__getitem__, ids))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py() or "" for x in batch.column("text"))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, ids)]), type=pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id and `ids`, an array of int."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists([e.encode(t) for t in _texts(part)])], schema.names)
        e.forget()

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: its id and `text`, the vocabulary strings of its ids. Null ids count as none."""
    rows = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for b in batches:
            text = [decode_ids(v, x.as_py() or []) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(text, type=pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: its id, `n_tokens`, SHA-256 of the ids as text and of the decoded text, and the ids if asked for."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        numbers = [str(i) for i in range(len(e.vocabulary.strings))]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out, codes = [], []
                for t in _texts(part):
                    codes.append(e.encode(t))
                    ids = codes[-1].tolist()
                    out.append((len(ids), digest(" ".join(map(numbers.__getitem__, ids))), digest(decode_ids(e.vocabulary, ids))))
                columns = [part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays([*columns, *([_lists(codes)] if with_ids else [])], schema.names)
        e.forget()

    return rows.mapInArrow(run, schema)
