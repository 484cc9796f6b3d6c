"""Quality rules by repetition coverage.

For several n, rolling hashes of all n-word windows of a text are compared; a word is covered if it lies in a window
found twice or more in its text (the first one included). The share of covered characters per n, and the share of
characters in repeated lines, decide. Everything is numpy over runs of whole texts; a text is never cut.

Null and empty texts have no words and fail the base rule. Repeated rows and equal ids are judged each by itself.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenurekit.llm import text as tx


class Rules(NamedTuple):
    """Shares are percent of the characters in words."""
    min_words: int = 20
    base_window: int = 8
    base_share: int = 30  # of words
    coverage: tuple[tuple[int, int], ...] = ((4, 50), (6, 40), (10, 30))  # (words of a window, most covered)
    line_share: int = 30  # in lines equal to an earlier line


RULES = Rules()
_SYMBOLS = list(b"#*$%&|<>")
_SPACE = list(b" \t\n\v\f\r")
_LEAD = np.arange(256) & 0xC0 != 0x80  # bytes that begin a code point


def covered(w: tx.Words, n: int) -> np.ndarray:
    """Words inside an n-word window that its text holds twice or more."""
    out = np.zeros(len(w.hash), dtype=bool)
    gram, inside = tx.grams(w, n)
    if not inside.any():
        return out
    gram = tx.mix(gram + w.text[:len(gram)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # compared within a text
    gram = gram[inside]
    ordered = np.sort(gram)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    low = np.uint64(0xFFFF)
    listed = np.zeros(1 << 16, dtype=bool)
    listed[twice & low] = True
    may = np.flatnonzero(listed[gram & low])  # only these are looked up
    gram = gram[may]
    place = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
    begin = np.flatnonzero(inside)[may[twice[place] == gram]]
    step = np.zeros(len(out) + 1, dtype=np.int8)
    step[begin] = 1  # a window begins at a word once
    step[begin + n] -= 1
    return np.cumsum(step, dtype=np.int32)[:-1] > 0


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of words in them."""
    seen: set[bytes] = set()
    n = chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
            chars += len(b"".join(line.split()).decode())
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return n, chars


def measure(data: np.ndarray, at: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts per text for the texts data[at[k]:at[k + 1]]."""
    w = tx.words(data, at, tx.SPACED)
    raw = data[at[0]:at[-1]]
    n = len(at) - 1
    per_text = lambda x: np.add.reduceat(np.append(x, 0).astype(np.int64), w.first[:-1]) * (np.diff(w.first) > 0) \
        if n else np.zeros(0, np.int64)
    lead = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_LEAD[raw], out=lead[1:])
    chars = lead[w.end] - lead[w.start]
    symbol = np.zeros(256, dtype=bool)
    symbol[_SYMBOLS] = True
    marks = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(symbol[raw], out=marks[1:])
    lines = [_lines(raw[a:b].tobytes()) for a, b in zip((at - at[0])[:-1], (at - at[0])[1:])]
    out = {
        "n_words": np.diff(w.first).astype(np.int64), "word_chars": per_text(chars),
        "n_symbols": marks[(at - at[0])[1:]] - marks[(at - at[0])[:-1]],
        "n_dup_lines": np.array([x for x, _ in lines], dtype=np.int64),
        "n_repeat_words": per_text(covered(w, rules.base_window)),
        "dup_line_chars": np.array([x for _, x in lines], dtype=np.int64),
    }
    for m, _ in rules.coverage:
        out[f"dup_{m}gram_chars"] = per_text(np.where(covered(w, m), chars, 0))
    return out


def _verdict(x: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    failed = (x["n_words"] < rules.min_words) | (100 * x["n_repeat_words"] > rules.base_share * x["n_words"])
    kept = ~failed & (100 * x["dup_line_chars"] <= rules.line_share * x["word_chars"])
    for m, most in rules.coverage:
        kept &= 100 * x[f"dup_{m}gram_chars"] <= most * x["word_chars"]
    return failed, kept


def _measured(batch: pa.RecordBatch, text: str, rules: Rules) -> dict[str, np.ndarray]:
    data, at = tx.utf8(batch.column(text))
    parts = [measure(data, at[i:j + 1], rules) for i, j in tx.runs(at)]
    x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    x["base_failed"], x["kept"] = _verdict(x, rules)
    return x


def repetition(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = RULES) -> DataFrame:
    """Per row: its id, the counts, `base_failed` and `kept`."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
             *(f"dup_{m}gram_chars" for m, _ in rules.coverage)]
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in names),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _measured(b, "text", rules)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x[f.name]) for f in schema[1:])], schema.names)
        tx.trim()

    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """The rows that pass, with all their columns as they were."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_measured(b, text, rules)["kept"]))
        tx.trim()

    return docs.mapInArrow(run, docs.schema)
