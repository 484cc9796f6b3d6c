"""Hard negatives of anchor vectors by Four-Russians scoring: table lookups instead of products.

Vectors become integers, floor(scale * x). Candidates are kept as bit planes: bit b of eight neighbouring dimensions is one
byte. For an anchor, a table per group of eight dimensions holds the sum of every subset of its eight numbers, so the byte of
a candidate's plane is the index of that plane's share of the inner product; plane sums, shifted and added from the sign plane
down, are the full exact score. Every anchor meets every candidate: packed candidates are dealt once into groups of bounded
size, and the anchors (a small share of the rows) are sent to each group in blocks and read there as a stream.

A first pass scores rows of the anchor's label and finds its positives, a second pass scores the others and keeps, for each
positive, the best within [low, high] percent of the positive's score. Higher scores come first, ties by smaller id (null last).

Rows with a null label or vector, or with a null or non-finite component, take no part. Every other row does, each by itself:
repeated rows are told apart, and an anchor is not its own positive, but an equal row is. A shorter vector counts as
followed by zeros. Anchors without a positive, or without a row in the range, have no result rows. Scores have 64 bits; numbers
so large that a score might exceed them stop the job.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenurekit.llm import text as tx
from tenurekit.llm.store import remove, written

BODY_BYTES = 128 << 10  # packed rows of one body
GROUP_LEAST, GROUP_MOST = 1 << 13, 1 << 18  # candidates of one group
LANES, TILE, SORTED = 256, 1024, 1 << 14  # anchors side by side, candidates of a scoring tile, candidates sorted at once
_BITS = np.arange(8, dtype=np.int64)


class Ask(NamedTuple):
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of the positive's score
    high: int = 90


ASK = Ask()


# --- scoring ----------------------------------------------------------------------------------------------------------

def planes(v: np.ndarray) -> np.ndarray:
    """Bit planes (bits, groups, rows) of integer rows, two's complement; the last plane is the sign."""
    n, d = v.shape
    bits = int(np.where(v < 0, ~v, v).max(initial=0)).bit_length() + 1
    v = np.pad(v, ((0, 0), (0, -d % 8)))
    out = np.empty((bits, v.shape[1] // 8, n), np.uint8)
    for b in range(bits):
        out[b] = np.packbits((v >> b & 1).astype(bool), axis=1, bitorder="little").T
    return out


def subset_sums(v: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors): the sum of every subset of the numbers of a group."""
    m, d = v.shape
    v = np.pad(v, ((0, 0), (0, -d % 8))).reshape(m, -1, 8)
    most = int(np.abs(v.astype(np.float64)).sum(axis=(1, 2)).max(initial=0))
    out = np.zeros((v.shape[1], 256, m), np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    for k in _BITS:  # sets with dimension k as their last one
        out[:, 1 << k:2 << k] = out[:, :1 << k] + v[:, :, k].T[:, None, :].astype(out.dtype)
    return out


def scores(tables: np.ndarray, packed: np.ndarray, wide: type) -> np.ndarray:
    """Inner products (candidates, anchors) from the tables and the planes."""
    bits, groups, n = packed.shape
    total = np.zeros((n, tables.shape[2]), wide)
    share, part = np.empty_like(total, tables.dtype), np.empty_like(total, tables.dtype)
    for b in range(bits - 1, -1, -1):
        share[:] = 0
        for g in range(groups):
            share += np.take(tables[g], packed[b, g], axis=0, out=part, mode="clip")
        total <<= 1
        total += -share.astype(wide) if b == bits - 1 else share
    return total


def _scored(tables: np.ndarray, packed: np.ndarray, reach: float) -> np.ndarray:
    """scores() in tiles, one row per anchor. `reach`: largest sum of absolute numbers of an anchor."""
    bits, _, n = packed.shape
    bound = reach * 2.0 ** (bits - 1)
    if bound >= 2.0**63:
        raise OverflowError("scores of these vectors may exceed 64 bits; use a smaller scale")
    out = np.empty((tables.shape[2], n), np.int32 if bound < 2.0**30 else np.int64)
    for k in range(0, n, TILE):
        out[:, k:k + TILE] = scores(tables, packed[:, :, k:k + TILE], out.dtype.type).T
    return out


# --- packing ----------------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """Integer lists as rows, filled up with zeros to the longest."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _body(arrays: list[pa.Array], names: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(arrays, names)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


def _packed(groups: int | None):
    """Rows as bodies of about BODY_BYTES. Candidates (`groups` given) become planes and are dealt to groups in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal turn, held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, turn = [], 0, turn + 1
            if groups is None:
                body = _body(rows.columns, rows.schema.names)
                return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])
            v = planes(_matrix(rows.column("v")))
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            ids = rows.column("id")
            body = _body([one(ids.fill_null(0).to_numpy()), one(ids.is_null().to_numpy(zero_copy_only=False)),
                          one(rows.column("label").to_numpy()), one(v), pa.array([v.shape[0]]), pa.array([v.shape[1]])],
                         ["id", "null", "label", "planes", "bits", "groups"])
            return pa.RecordBatch.from_arrays([pa.array([turn % groups], pa.int32()), pa.array([body], pa.binary())], ["p", "body"])

        for b in batches:
            wide = max(1, len(b.column("v").flatten()) // max(1, b.num_rows)) * (2 if groups is not None else 8) + 24
            step = max(1, BODY_BYTES // wide)
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                if held and size + part.num_rows * wide > BODY_BYTES:
                    yield flush()
                held.append(part)
                size += part.num_rows * wide
        if held:
            yield flush()

    return run


class _Group(NamedTuple):
    """Candidates of one group, by ascending id (null last)."""
    id: np.ndarray
    null: np.ndarray
    label: np.ndarray
    planes: np.ndarray


def _group(bodies: list[bytes]) -> _Group:
    parts = [_read(b) for b in bodies]
    get = lambda name, kind: np.concatenate([np.frombuffer(p.column(name)[0].as_py(), kind) for p in parts])
    id, null, label = get("id", np.int64), get("null", bool), get("label", np.int64)
    shape = [(p.column("bits")[0].as_py(), p.column("groups")[0].as_py()) for p in parts]
    bits, groups = max(b for b, _ in shape), max(g for _, g in shape)
    packed = np.empty((bits, groups, len(id)), np.uint8)
    at = 0
    for p, (b, g) in zip(parts, shape):
        x = np.frombuffer(p.column("planes")[0].as_py(), np.uint8).reshape(b, g, -1)
        here = packed[:, :, at:at + x.shape[2]]
        here[:, g:] = 0
        here[:b, :g], here[b:, :g] = x, x[-1]  # more bits repeat the sign
        at += x.shape[2]
    order = np.lexsort((id, null))
    return _Group(id[order], null[order], label[order], np.take(packed, order, axis=2))


# --- the two passes ---------------------------------------------------------------------------------------------------

def _tables(v: np.ndarray, group: _Group) -> tuple[np.ndarray, float]:
    """Tables of the anchors and their reach, over the dimensions that the group has (beyond them its numbers are zero)."""
    d = group.planes.shape[1] * 8
    v = np.pad(v[:, :d], ((0, 0), (0, max(0, d - v.shape[1]))))
    return subset_sums(v), float(np.abs(v.astype(np.float64)).sum(axis=1).max(initial=0))


def _positives(group: _Group, block: pa.Table, ask: Ask) -> Iterator[tuple]:
    """Best rows of each anchor's label: (anchors, ids, whether null, scores), one more than asked for, as the anchor is among them."""
    keys, labels, v = block["key"].to_numpy(), block["label"].to_numpy(), _matrix(block["v"].combine_chunks())
    by_label = np.argsort(group.label, kind="stable")
    held = group.label[by_label]
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        rows = by_label[np.searchsorted(held, label, "left"):np.searchsorted(held, label, "right")]
        for a in range(0, len(mine) if len(rows) else 0, LANES):
            lanes = mine[a:a + LANES]
            tables, reach = _tables(v[lanes], group)
            for k in range(0, len(rows), SORTED):
                part = rows[k:k + SORTED]
                found = _scored(tables, np.take(group.planes, part, axis=2), reach)
                best = np.argsort(~found, axis=1, kind="stable")[:, :ask.positives + 1]
                r = part[best].ravel()
                yield np.repeat(keys[lanes], best.shape[1]), group.id[r], group.null[r], np.take_along_axis(found, best, 1).ravel()


def limits(score: np.ndarray, ask: Ask) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score for positive scores, without leaving 64 bits."""
    q, r = score // 100, score % 100
    return q * ask.low - (-(r * ask.low) // 100), q * ask.high + r * ask.high // 100


def _negatives(group: _Group, block: pa.Table, ask: Ask) -> Iterator[tuple]:
    """Best rows of other labels within the limits of each positive: (rows of the block, positives' places, ids, whether null, scores)."""
    labels, v = block["label"].to_numpy(), _matrix(block["v"].combine_chunks())
    wanted = block["positives"].combine_chunks()
    first, score = wanted.offsets.to_numpy(), wanted.flatten().field("score").to_numpy()
    first = first - first[0]
    low, high = limits(score, ask)
    for a in range(0, len(labels), LANES):
        tables, reach = _tables(v[a:a + LANES], group)
        for k in range(0, len(group.id), SORTED):
            found = _scored(tables, group.planes[:, :, k:k + SORTED], reach)
            for i, row in enumerate(found, start=a):
                others = np.flatnonzero(group.label[k:k + SORTED] != labels[i])
                down = ~row[others]  # ascending where scores descend
                order = np.argsort(down, kind="stable")
                down = down[order].astype(np.int64)
                for slot in range(first[i], first[i + 1]):
                    x, y = np.searchsorted(down, ~high[slot], "left"), np.searchsorted(down, ~low[slot], "right")
                    y = min(y, x + ask.negatives)
                    if x < y:
                        r = k + others[order[x:y]]
                        yield np.full(y - x, i), np.full(y - x, slot - first[i]), group.id[r], group.null[r], ~down[x:y]


def _streamed(passed, names: list[str]):
    """Applies a pass to each group: its candidates come first, then the anchors, body after body."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies, group, block, size = None, [], None, [], 0

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal group, block, size
            if group is None and bodies:
                group = _group(bodies)
                bodies.clear()
            if group is not None and block:
                yield from passed(group, pa.Table.from_batches(block), names)
            block, size = [], 0

        for b in batches:
            for p, anchor, body in zip(b.column("p").to_pylist(), b.column("anchor").to_pylist(), b.column("body")):
                if p != now:
                    yield from work()
                    now, group = p, None
                    bodies.clear()
                if not anchor:
                    bodies.append(body.as_py())
                    continue
                block.append(_read(body.as_buffer()))
                size += block[-1].num_rows
                if size >= 2 * LANES:
                    yield from work()
        yield from work()
        tx.trim()

    return run


def _ids(id: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(id, pa.int64(), mask=null)


def _first_pass(ask: Ask):
    def passed(group: _Group, block: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
        for key, id, null, score in _positives(group, block, ask):
            yield pa.RecordBatch.from_arrays([pa.array(key), _ids(id, null), pa.array(score.astype(np.int64))], names)

    return passed


def _second_pass(ask: Ask):
    def passed(group: _Group, block: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
        found = list(_negatives(group, block, ask))
        if not found:
            return
        row, slot, id, null, score = (np.concatenate(x) for x in zip(*found))
        wanted = block["positives"].combine_chunks()
        first = wanted.offsets.to_numpy()
        place = pa.array(first[row] - first[0] + slot)
        held = wanted.flatten()
        yield pa.RecordBatch.from_arrays(
            [block["key"].combine_chunks().take(pa.array(row)), pa.array(slot.astype(np.int32)), block["id"].combine_chunks().take(pa.array(row)),
             held.field("id").take(place), held.field("score").take(place), _ids(id, null), pa.array(score.astype(np.int64))], names)

    return passed


def _meet(candidates: DataFrame, anchors: DataFrame, groups: int, passed, schema: str) -> DataFrame:
    """Every anchor with every candidate: one task per group of candidates, to which all bodies of anchors are sent."""
    bodies = anchors.mapInArrow(_packed(None), "body binary").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("p"), F.lit(True).alias("anchor"), "body")
    both = candidates.select("p", F.lit(False).alias("anchor"), "body").unionByName(bodies)
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return both.repartitionByRange(groups, "p").sortWithinPartitions("p", "anchor").mapInArrow(_streamed(passed, names), schema)


def _best(df: DataFrame, keys: list[str], id: str, score: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(id))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: int = 256, ask: Ask = ASK) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors`: condition on `vectors` (default: id divisible by 100).
    """
    anchors = F.col(id) % 100 == 0 if anchors is None else anchors
    number = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    spark = vectors.sparkSession
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x"), anchors.alias("anchor"), fit.alias("fit"), number.alias("v"))
            .where("label IS NOT NULL AND x IS NOT NULL AND fit"))
    chosen = written(rows.where("anchor").select(F.monotonically_increasing_id().alias("key"), "id", "label", "v"), "anchors")
    n = rows.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // GROUP_MOST), min(parallel, -(-n // GROUP_LEAST)))
    packed = written(rows.select("id", "label", "v").mapInArrow(_packed(groups), "p int, body binary"), "planes")
    near = _meet(packed, chosen, groups, _first_pass(ask), "key long, id long, score long")
    near = _best(near, ["key"], "id", "score", ask.positives + 1)
    # of the rows equal to the anchor in id and score one is the anchor itself
    own = chosen.select("key", F.col("id").alias("own_id"), "label", "v", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("own_score"))
    held = (near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near")).join(own, "key"))
    same = F.filter("near", lambda x: x["id"].eqNullSafe(F.col("own_id")) & (x["score"] == F.col("own_score")))
    skip = F.coalesce(F.get(same, 0)["rank"], F.lit(ask.positives + 1))
    asked = held.select("key", F.col("own_id").alias("id"), "label", "v", F.transform(
        F.filter("near", lambda x: x["rank"] != skip), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    asked = written(asked, "asked")
    found = _meet(packed, asked, groups, _second_pass(ask),
                  "key long, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = written(_best(found, ["key", "slot"], "negative_id", "negative_score", ask.negatives), "negatives")
    for done in (chosen, packed, asked):
        remove(done)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
