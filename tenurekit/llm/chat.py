"""Chat formatting from an event log.

A log holds, per message, what happened to it in order: `open` (role), `delta` (text streamed on), `edit` (the text is
replaced), `regenerate` (what was streamed so far is dropped). Logs are partitioned by conversation and message, sorted
by sequence and folded into final messages; messages of a conversation are then sorted and rendered.

Template: <|im_start|>role, line end, text, <|im_end|>, line end. In a text, `<`, any backslashes and `|` get one more backslash,
so no control string can arise and the step can be undone; in a role, backslashes, line ends and bars are escaped.
The loss mask is the character spans of assistants' texts.

The output has a row per conversation and chunk (`conv`, `chunk`, `text`, `spans`); a chunk ends with the message that reaches
CHUNK_CHARS, so a conversation of any length is written and read as a stream.

Null texts and roles count as empty. A null conversation is one of its own. Messages are ordered by position (null first),
role, text; repeated rows are messages each by itself. Empty tables give no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenurekit.llm.store import written

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
CHUNK_CHARS = 1 << 20
_BAR = re.compile(r"<(\\*)\|")
_UNBAR = re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _BAR.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNBAR.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            yield from b.slice(k, 1000).to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def fold_log(log: DataFrame) -> DataFrame:
    """Final messages (conv, message, position, role, text) of a log (conv, message, position, seq, op, role, text)."""
    key = ["conv", "message"]
    log = log.select("conv", "message", "position", "seq", "op", "role", "text")
    ordered = log.repartition(*key).sortWithinPartitions(*key, "seq")
    schema = T.StructType([log.schema[c] for c in ("conv", "message", "position", "role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, message, pieces, out, chars = _arrow(schema), None, None, [], [], 0
        for e in _rows(batches):
            if now != (e["conv"], e["message"]):
                if message is not None:
                    out.append(message | {"text": "".join(pieces)})
                    chars += len(out[-1]["text"])
                now, pieces = (e["conv"], e["message"]), []
                message = {"conv": e["conv"], "message": e["message"], "position": None, "role": None}
                if chars >= CHUNK_CHARS or len(out) >= 1000:
                    yield _batch(out, shape)
                    out, chars = [], 0
            if e["op"] == "open":
                message |= {"position": e["position"], "role": e["role"]}
            elif e["op"] == "delta":
                pieces.append(e["text"] or "")
            elif e["op"] == "edit":
                pieces = [e["text"] or ""]
            elif e["op"] == "regenerate":
                pieces = []
            else:
                raise ValueError(f"unknown event {e['op']!r}")
        if message is not None:
            out.append(message | {"text": "".join(pieces)})
        if out:
            yield _batch(out, shape)

    return ordered.mapInArrow(run, schema)


def render(messages: DataFrame) -> DataFrame:
    """Formatted chunks (conv, chunk, text, spans) of messages (conv, message, position, role, text)."""
    order = ["conv", F.col("position").asc_nulls_first(), "role", "text", "message"]
    ordered = messages.repartition("conv").sortWithinPartitions(*order)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([messages.schema["conv"], T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, row, parts, at, out, held = _arrow(schema), (), None, [], 0, [], 0

        def close() -> None:
            nonlocal held
            out.append(row | {"text": "".join(parts)})
            held += at

        for m in _rows(batches):
            if now != (m["conv"],) or at >= CHUNK_CHARS:
                if row is not None:
                    close()
                row = {"conv": m["conv"], "chunk": row["chunk"] + 1 if now == (m["conv"],) else 0, "spans": []}
                now, parts, at = (m["conv"],), [], 0
                if held >= CHUNK_CHARS or len(out) >= 1000:
                    yield _batch(out, shape)
                    out, held = [], 0
            head, text = f"{START}{escape_role(m['role'] or '')}\n", escape(m["text"] or "")
            if m["role"] == LEARNED:
                row["spans"].append({"start": at + len(head), "end": at + len(head) + len(text)})
            parts += [head, text, END, "\n"]
            at += len(head) + len(text) + len(END) + 1
        if row is not None:
            close()
        if out:
            yield _batch(out, shape)

    return ordered.mapInArrow(run, schema)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted chunk."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not in the template")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def digests(chunks: DataFrame, id: str = "conv_id") -> DataFrame:
    """Per conversation, from its formatted chunks: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", "chunk")
    schema = T.StructType([T.StructField(id, chunks.schema["conv"].dataType), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, now, n, out = _arrow(schema), (), [0, 0, 0], []
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            if now:
                out.append({id: now[0], "n_turns": n[0], "turns_sha256": turns.hexdigest(), "loss_chars": n[1],
                            "loss_sha256": loss.hexdigest(), "formatted_chars": n[2]})

        for c in _rows(batches):
            if now != (c["conv"],):
                close()
                now, n, turns, loss = (c["conv"],), [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                if len(out) >= 5000:
                    yield _batch(out, shape)
                    out = []
            for role, text in parse(c["text"]):
                n[0] += 1
                turns.update(f"{role}\n{text}\n".encode())
            for s in c["spans"]:
                text = unescape(c["text"][s["start"]:s["end"]])
                n[1] += len(text)
                loss.update(text.encode())
            n[2] += len(c["text"])
        close()
        if out:
            yield _batch(out, shape)

    return ordered.mapInArrow(run, schema)


def log_of(rows: DataFrame, id: str = "conv_id", position: str = "turn", role: str = "role", text: str = "text",
           piece: int = 200) -> DataFrame:
    """A log whose fold gives the rows back. Assistants' texts were streamed, broken off, and generated anew in pieces;
    other texts were streamed in part and then edited."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = rows.select(F.col(id).alias("conv"), F.col(position).alias("position"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       body.alias("whole"), F.monotonically_increasing_id().alias("message"))
    step = F.greatest(F.lit(piece), F.ceil(F.length("whole") / 64).cast("int"))  # 64 pieces at most keep cutting linear
    event = lambda op, t: F.struct(F.lit(op).alias("op"), t.cast("string").alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("whole") / step).cast("int")),
                         lambda k: event("delta", F.substring(F.col("whole"), k * step + 1, step)))
    begun = F.array(event("open", F.lit(None)), event("delta", F.substring("whole", F.lit(1), step)))
    events = F.when(F.col("role") == LEARNED, F.concat(begun, F.array(event("regenerate", F.lit(None))), pieces)) \
        .otherwise(F.concat(begun, F.array(event("edit", F.col("whole")))))
    return (base.select("conv", "message", "position", "role", F.posexplode(events).alias("seq", "event"))
            .select("conv", "message", "position", "seq", "event.op", "role", "event.text"))


def format_log(log: DataFrame, folder: str | None = None) -> DataFrame:
    """Folds a log, renders it, writes the chunks and returns them as read back."""
    return written(render(fold_log(log)), "chat", folder)
