"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap of
which of them go on in level k + 1; a rank directory over the bitmap gives their place there. So any token is reached by
one lookup per level, without decoding those before it, and small ids take fewer bytes.

File format: a Parquet table of segments in ascending id order (`part`, `segment`, `ids` of its documents, `ends` of their
tokens, `codes`). `codes` is little endian: magic b"DAC1", uint32 levels, uint64 tokens, then per level uint64 chunks,
the chunks, uint32 length of the bitmap in 64-bit words, the bitmap, and uint32 set bits before every 512-bit block.

Null texts count as empty and hold only the end id. Null ids come first, equal ids in the order of a hash of their text.
An empty table gives no segments.
"""
from __future__ import annotations

import functools
import hashlib
import operator
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from tenurekit.llm import text as tx
from tenurekit.llm.store import written

SEGMENT_TOKENS = 1 << 20  # a segment ends with the document that reaches so many
KEPT_WORDS = 800_000  # stretches in the table of ids that a Python worker keeps
LONG_WORD = 256  # bytes
JOINED = 100  # stretches that the library reads in one call
_LETTERS_SIGNS = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)\Z")  # ASCII signs but the apostrophe
_MAGIC = b"DAC1"
_BLOCK = 512


class Codes:
    """One array of ids, addressable token by token."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: int) -> None:
        self.levels, self.tokens = levels, tokens

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        while True:
            more = rest > 0xFF
            words = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK // 8, dtype=np.uint8)
            packed = np.packbits(more, bitorder="little")
            words[:len(packed)] = packed
            words = words.view("<u8")
            per_block = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(axis=1)
            levels.append((rest.astype(np.uint8), words, (np.cumsum(per_block) - per_block).astype("<u4")))
            if not more.any():
                return cls(levels, len(ids))
            rest = rest[more] >> 8

    def to_bytes(self) -> bytes:
        out = [_MAGIC, np.uint32(len(self.levels)).tobytes(), np.uint64(self.tokens).tobytes()]
        for chunks, words, ranks in self.levels:
            out += [np.uint64(len(chunks)).tobytes(), chunks.tobytes(), np.uint32(len(words)).tobytes(), words.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        if raw[:4] != _MAGIC:
            raise ValueError("not a DAC segment")
        n, tokens, at, levels = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0]), 16, []
        for _ in range(n):
            size = int(np.frombuffer(raw, "<u8", 1, at)[0])
            chunks = np.frombuffer(raw, np.uint8, size, at + 8)
            at += 8 + size
            count = int(np.frombuffer(raw, "<u4", 1, at)[0])
            words = np.frombuffer(raw, "<u8", count, at + 4)
            at += 4 + 8 * count
            blocks = count * 64 // _BLOCK
            levels.append((chunks, words, np.frombuffer(raw, "<u4", blocks, at)))
            at += 4 * blocks
        return cls(levels, tokens)

    def _rank(self, level: int, i: int) -> int:
        """Ids before place i of a level that go on."""
        _, words, ranks = self.levels[level]
        block, word = i // _BLOCK, i // 64
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(words[-(_BLOCK // 64):]).sum()) if block else 0
        out = int(ranks[block]) + int(np.bitwise_count(words[block * _BLOCK // 64:word]).sum())
        return out + (int(words[word]) & ((1 << i % 64) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place i, by one lookup per level."""
        out = 0
        for k, (chunks, words, _) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not int(words[i // 64]) >> i % 64 & 1:
                break
            i = self._rank(k, i)
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to b: they are neighbours on every level, so a level takes two ranks."""
        out, places = np.zeros(b - a, dtype=np.uint32), None
        for k, (chunks, words, _) in enumerate(self.levels):
            if a >= b:
                break
            part = chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if places is None:
                out = part
            else:
                out[places] |= part
            bits = np.unpackbits(words.view(np.uint8)[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a]
            on = np.flatnonzero(bits)
            places = on if places is None else places[on]
            a = self._rank(k, a)
            b = a + len(on)
        return out


class WordEncoder:
    """The library's ids of whole texts. Its pattern has no word over ASCII white space, so the library is asked for each distinct
    stretch between such spaces once; ids of many texts are then gathered at once from a table of the stretches known so far."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.kept = Tokenizer.from_file(path), kept
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.library.no_truncation()
        self.library.no_padding()
        self._know(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64))
        self._forget()
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        # whether letters end before other signs, and case folds, so that "Word," is "word" and ","
        self.splits = all(ids(a + b) == ids(a.lower()) + ids(b) for a in ("Word", "EXAMPLES", "iPhone", "s", "Ll") for b in (",", ".", "!!", "***", '")', "-", "$%&", ""))

    def _know(self, word: np.ndarray, size: np.ndarray, ids: np.ndarray, hits: np.ndarray) -> None:
        """The table: hash of a stretch, its number of ids, where these begin, and how often it was seen."""
        self.word, self.size, self.ids, self.hits = word, size, ids, hits
        self.begin = np.cumsum(size) - size

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of stretches, and the ids; a line of JOINED stretches is one call, and offsets tell whose ids they are."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)]
        for k in range(0, len(words), JOINED):
            part = words[k:k + JOINED]
            x = self.library.encode(" ".join(part), add_special_tokens=False)
            start = np.fromiter(map(operator.itemgetter(0), x.offsets), np.int64, len(x))
            end = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            sizes.append(np.bincount(np.searchsorted(end, start, "right"), minlength=len(part)))
            ids.append(np.array(x.ids, self.kind))
        return np.concatenate(sizes), np.concatenate(ids)

    def _forget(self) -> None:
        """Empties the table of pieces: letters and signs that stretches are made of."""
        self.pieces: dict[str, int] = {}
        self.piece_size, self.piece_ids = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of stretches, and the ids. Of letters followed by signs, the library is asked for the letters in lower case
        and for the signs, each once."""
        if not self.splits:
            return self._ask(words)
        found = [_LETTERS_SIGNS.match(w) for w in words]
        parts = [p for w, m in zip(words, found) for p in ((m[1].lower(), m[2]) if m else (w, ""))]
        if len(self.pieces) > self.kept // 2:
            self._forget()
        ask = [p for p in dict.fromkeys(parts) if p not in self.pieces]
        size, ids = self._ask(ask)
        self.pieces.update(zip(ask, range(len(self.pieces), len(self.pieces) + len(ask))))
        self.piece_size, self.piece_ids = np.concatenate([self.piece_size, size]), np.concatenate([self.piece_ids, ids])
        place = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        size = self.piece_size[place]
        begin = np.cumsum(self.piece_size) - self.piece_size
        return size[::2] + size[1::2], self.piece_ids[_spread(begin[place], size)]

    def _places(self, w: tx.Words, raw: np.ndarray) -> np.ndarray:
        """Place in the table of every stretch; those that are missing are asked for."""
        key = w.hash
        for k in np.flatnonzero(w.end - w.start > LONG_WORD):  # a rolling hash of long words can be fooled
            key[k] = int.from_bytes(hashlib.blake2b(raw[w.start[k]:w.end[k]].tobytes(), digest_size=8).digest(), "little")
        found = pc.index_in(pa.array(key), value_set=pa.array(self.word))
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first, which = np.unique(key[missing], return_index=True, return_inverse=True)
            here = missing[first]
            size, ids = self._new([raw[s:e].tobytes().decode() for s, e in zip(w.start[here].tolist(), w.end[here].tolist())])
            place[missing] = len(self.word) + which
            self._know(np.concatenate([self.word, new]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids]),
                       np.concatenate([self.hits, np.zeros(len(new), np.int64)]))
        now = np.bincount(place, minlength=len(self.word))
        self.hits += now
        if len(self.word) > self.kept:  # those of these texts stay, and those seen more than once, the most frequent ones if these are many
            least = max(2, int(np.partition(self.hits, -self.kept // 2)[-self.kept // 2]))
            stays = np.flatnonzero((now > 0) | (self.hits >= least))
            moved = np.zeros(len(self.word), np.int64)
            moved[stays] = np.arange(len(stays))
            place = moved[place]
            self._know(self.word[stays], self.size[stays], self.ids[_spread(self.begin[stays], self.size[stays])], self.hits[stays] // 2)
        return place

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[at[k]:at[k + 1]], `end_id` after each text, and where each text's ids end."""
        w = tx.words(data, at, tx.SPACED)
        place = self._places(w, data[at[0]:at[-1]])
        size = self.size[place]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[w.first[1:]] + np.arange(1, len(at))
        out = np.empty(int(before[-1]) + len(at) - 1, self.kind)
        is_id = np.ones(len(out), bool)
        is_id[ends - 1] = False
        out[is_id] = self.ids[_spread(self.begin[place], size)]
        out[ends - 1] = end_id
        return out, ends


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. for `size` numbers, for each entry in turn."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id: str = "doc_id", text: str = "text",
                 segment_tokens: int = SEGMENT_TOKENS, folder: str | None = None) -> DataFrame:
    """Writes the table of segments and returns it as read back."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(id).alias("id"), body.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, names, parts, ends = TaskContext.get().partitionId(), 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal segment, names, parts, ends
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), one(pa.concat_arrays(names)), one(pa.array(np.concatenate(ends))),
                   pa.array([Codes.of(np.concatenate(parts)).to_bytes()], pa.binary())]
            segment, names, parts, ends = segment + 1, [], [], []
            return pa.RecordBatch.from_arrays(row, schema.names)

        e, size = _encoder(path), 0
        for b in batches:
            data, at = tx.utf8(b.column("text"))
            for i, j in tx.runs(at):
                tokens, last = e.encode(data, at[i:j + 1], end_id)
                k = base = 0
                while k < j - i:  # up to the document that fills the segment
                    m = min(int(np.searchsorted(last, base + segment_tokens - size)) + 1, j - i)
                    names.append(b.column("id").slice(i + k, m - k))
                    parts.append(tokens[base:last[m - 1]])
                    ends.append(size + last[k:m] - base)
                    size, k, base = int(ends[-1][-1]), m, int(last[m - 1])
                    if size >= segment_tokens:
                        yield flush()
                        size = 0
        if names:
            yield flush()
        tx.trim()

    return written(rows.mapInArrow(run, schema), "dac", folder, compression="uncompressed")


def _per_document(segments: DataFrame, id: str, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """A row per document: part, segment, id, `at` (its first token in the segment), n_tokens and what `make` returns."""
    kind = segments.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField(id, kind),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes, ends = Codes.from_bytes(b.column("codes")[i].as_buffer()), np.array(b.column("ends")[i].as_py(), dtype=np.int64)
                at = np.concatenate([[0], ends[:-1]])
                n = len(ends)
                made = [make(codes.span(int(x), int(y))) for x, y in zip(at, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("part")[i].as_py()] * n, pa.int32()), pa.array([b.column("segment")[i].as_py()] * n, pa.int32()),
                     b.column("ids")[i].values, pa.array(at), pa.array(ends - at),
                     *(pa.array([m[k] for m in made], t) for k, (_, _, t) in enumerate(fields))], schema.names)

    return segments.mapInArrow(run, schema)


def segment_starts(segments: DataFrame) -> DataFrame:
    """Tokens before each segment: a sum over the parts (as many as files) and one inside each part."""
    n = segments.select("part", "segment", F.element_at("ends", -1).alias("n"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = n.groupBy("part").agg(F.sum("n").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    return (n.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
            .select("part", "segment", (F.col("before") + F.col("inside")).alias("first")))


def _placed(documents: DataFrame, segments: DataFrame) -> DataFrame:
    return (documents.join(segment_starts(segments), ["part", "segment"])
            .withColumn("start", F.col("first") + F.col("at")).drop("part", "segment", "first", "at"))


def read_tokens(segments: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: id, start (tokens of all documents before it), n_tokens and its ids, end id included."""
    return _placed(_per_document(segments, id, [("ids", T.ArrayType(T.LongType()), pa.list_(pa.int64()))],
                                 lambda ids: (ids.astype(np.int64),)), segments)


def checksums(segments: DataFrame, id: str = "doc_id") -> DataFrame:
    """As `read_tokens`, with the CRC-32 of the ids as unsigned 32-bit integers in place of the ids."""
    return _placed(_per_document(segments, id, [("ids_crc32", T.LongType(), pa.int64())],
                                 lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),)), segments)
