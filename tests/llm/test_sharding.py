import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tenurekit.llm import sharding


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for s in range(shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / shards) <= largest


def test_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 20)
    rows = [(k, f"text {k} " * (k % 17)) for k in range(900)] + [(k, "copy of one text") for k in range(1000, 1500)]
    rows += [(7, "text 7 " * 7)] * 300 + [(None, "é"), (None, None), (None, None), (3, ""), (9999, "long " * 2000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, shard int")
    got = sharding.assign_shards(docs).collect()
    check(rows, got, 24)
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # the order of the rows doesn't matter
    check(rows, sharding.assign_shards(docs, shards=5).collect(), 5)
    groups = {r.shard for r in got if 1000 <= (r.doc_id or 0) < 1500}
    assert max(groups) - min(groups) + 1 == len(groups)  # equal texts stand side by side


def test_files(spark, tmp_path):
    rows = [(k, f"text {k % 50}") for k in range(200)] + [(1, "text 1")] * 5
    docs = spark.createDataFrame([(*r, "x", 99) for r in rows], "doc_id int, text string, key string, shard int")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(4))


def test_few_rows(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert sharding.assign_shards(docs).count() == 0
    assert [r.slot for r in sharding.assign_shards(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()] == [0]


def test_no_range_stays_overfull(spark):
    """Keys of very unequal weight, two of them with nearly all bytes: only ranges of one key may be left above the limit."""
    weights = [1] * 3000 + [10] * 200 + [400_000, 600_000, 9_000, 9_000]
    keyed = spark.createDataFrame([(w, hashlib.md5(str(k).encode()).hexdigest()) for k, w in enumerate(weights)], "bytes long, key string")
    total, n = sum(weights), 50
    bounds = sharding._splitters(keyed, total, n)
    ranged = keyed.withColumn("range", sharding._range_of(F.col("key"), bounds)).groupBy("range").agg(F.sum("bytes").alias("b"), F.countDistinct("key").alias("keys"))
    rows = ranged.collect()
    assert not [r for r in rows if r.b > sharding.OVERFULL * total / n and r["keys"] > 1]
    assert sum(r["keys"] for r in rows) == len(weights) and len(bounds) == len(set(bounds))
