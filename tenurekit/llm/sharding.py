"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand side by side. Keys are sampled in
proportion to bytes, quantiles of the sample split the order into ranges, ranges that turn out overfull are split again
by ever denser samples of their own keys until none is left but such of one key, and the exact bytes before each row (bytes of earlier ranges plus a window inside
its range) give its shard. Sizes of shards are equal to within one document; a group of equal texts is split only
where the border of a shard falls into it. Rows equal in id and text are counted before any shuffle by range.

Null texts have no bytes. Null ids are allowed. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenurekit.llm.store import remove, written

ROW_BYTES = 8  # what a row takes besides its text
ROWS_A_RANGE = 100_000
SAMPLES_A_RANGE = 16
OVERFULL = 2.0  # times the mean bytes of a range


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def _share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone, so a task run again draws the same sample."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below the key: binary search as a fold over step sizes."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    borders = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(borders, at + step - 1) <= key), at + step).otherwise(at))


def _drawn(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    weight = F.col("bytes") * F.lit(rate)
    return rows.where(_share(F.col("key"), seed) < weight).select("range", "key", F.greatest(F.lit(1.0), weight).alias("w"))


def _quantiles(drawn: DataFrame, wanted: DataFrame | int) -> list[str]:
    """Keys that cut each range's sample into `pieces` of equal weight; `wanted` has a row per range to cut, or is one number.

    A key that fills a piece is cut off behind as well: its successor is the key with one more character."""
    order = Window.partitionBy("range").orderBy("key")
    place = lambda upto: F.floor(upto * F.col("pieces") / F.sum("w").over(Window.partitionBy("range")))
    cuts = (drawn.join(F.broadcast(wanted), "range") if isinstance(wanted, DataFrame) else drawn.withColumn("pieces", F.lit(wanted)))
    upto = F.sum("w").over(order)
    cuts = cuts.withColumns({"piece": place(upto - F.col("w") / 2), "alone": place(upto) - place(upto - F.col("w")) > 1})
    cuts = (cuts.groupBy("range", "piece").agg(F.min("key").alias("key"), F.max(F.when(F.col("alone"), F.col("key"))).alias("full"))
            .select(F.explode(F.array(F.when(F.col("piece") > 0, F.col("key")), F.col("full"), F.concat("full", F.lit("0")))).alias("cut")))
    return [r.cut for r in cuts.where("cut is not null").collect()]  # at most three of each piece


def _splitters(keyed: DataFrame, total: int, n: int) -> list[str]:
    whole, rate = keyed.withColumn("range", F.lit(0)), n * SAMPLES_A_RANGE / total
    bounds, k = sorted(set(_quantiles(_drawn(whole, rate, 1), n))), 1
    while True:  # once all keys of a range are drawn, each round cuts it
        ranged = keyed.withColumn("range", _range_of(F.col("key"), bounds))
        full = [r for r in ranged.groupBy("range").agg(F.sum("bytes").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
                .where((F.col("b") > OVERFULL * total / n) & (F.col("lo") < F.col("hi"))).collect()]
        if not full:
            return bounds
        k, rate = k + 1, 4 * rate
        pieces = keyed.sparkSession.createDataFrame([(r["range"], 1 + int(2 * r.b * n / total)) for r in full], "range int, pieces int")
        again = ranged.where(F.col("range").isin([r["range"] for r in full]))
        bounds = sorted({*bounds, *_quantiles(_drawn(again, rate, k), pieces)})


def assign_shards(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, key, shard, slot (from 0 in each shard, without gaps)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id).alias("id"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("crc"),
        F.concat(_hex(F.xxhash64(body)), _hex(F.xxhash64(F.col(id), F.lit("id")))).alias("key"))
    keyed = keyed.groupBy("key", "id", "size", "crc").agg(F.count("*").alias("copies"))
    keyed = written(keyed.withColumn("bytes", F.col("size") * F.col("copies")), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bounds = _splitters(keyed, total, max(4 * shards, -(-rows // ROWS_A_RANGE))) if rows else []

    ranged = keyed.withColumn("range", _range_of(F.col("key"), bounds))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = (ranged.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("copies").alias("c"))
              .select("range", before("b", order).alias("bytes_0"), before("c", order).alias("rows_0")))
    inside = Window.partitionBy("range").orderBy("key", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranged.withColumn("bytes_1", before("bytes", inside)).withColumn("rows_1", before("copies", inside))
              .join(ranges, "range")
              .select("id", "size", "crc", "key", (F.col("bytes_0") + F.col("bytes_1")).alias("from"),
                      (F.col("rows_0") + F.col("rows_1")).alias("row"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
              .select("id", "size", "crc", "key", (F.col("row") + F.col("copy")).alias("row"),
                      F.expr(f"cast(least({shards - 1}, ((2 * (from + copy * size) + size) * {shards}) div (2 * {max(total, 1)})) as int)").alias("shard")))
    placed = written(placed, "shard-places")
    remove(keyed)
    first = placed.groupBy("shard").agg(F.min("row").alias("row_0"))  # a row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "key", "shard",
                    (F.col("row") - F.col("row_0")).alias("slot")))


def write_shards(docs: DataFrame, folder: str, shards: int = 24, id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents to folder/shard=K; a column named shard is replaced. Rows equal in id and text that straddle
    a border are dealt to its shards in turn."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = (assign_shards(docs, shards, id, text).groupBy(F.col("key").alias("_at"))
             .agg(F.min("shard").alias("_first"), F.max("shard").alias("_last")))
    key = F.concat(_hex(F.xxhash64(body)), _hex(F.xxhash64(F.col(id), F.lit("id"))))
    out = docs.withColumn("_key", key).join(place, F.col("_key") == F.col("_at"), "left")
    share = F.pmod(F.monotonically_increasing_id(), F.col("_last") - F.col("_first") + 1)
    out = out.withColumn("shard", (F.col("_first") + share).cast("int")).drop("_key", "_at", "_first", "_last")
    out.repartition("shard", F.pmod(F.xxhash64(F.col(id)), F.lit(8))).write.partitionBy("shard").parquet(folder)
