"""What stays on disk: shuffle files of written tables, second copies of stored rows; payloads read with only the fields needed."""
from pyspark.sql import functions as F

from tenurekit.functions.ordered import Ordered, write_once
from tenurekit.operators import clean as C


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_written_table(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, "false")
    write_once(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).agg(F.collect_list("id").alias("x")), str(tmp_path / "t"))
    assert not shuffle_files(spark) - before and spark.conf.get(key, "false") == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 70


def test_stored_rows_are_not_kept_twice(spark, tmp_path):
    rows = [(None if k % 9 == 0 else k % 4, k // 3, k) for k in range(400)] + [(7, k % 50, 1000 + k) for k in range(900)]
    spark.createDataFrame(rows, "k int, t int, tie int").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = []
    for stored in (True, False):
        scan = Ordered(["k"], "t", ["tie"], slices=4, stored=stored)
        spark.catalog.clearCache()
        out = scan.add(df, prev={"p": F.col("tie")}, running_sum={"s": F.col("tie").cast("bigint")})
        kept = out._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation [k#")
        got.append((sorted(map(tuple, out.collect()), key=str), kept))
    assert got[0][0] == got[1][0] and got[0][1] == 0 < got[1][1]


TEXTS = ['{"subscription":{"id":"s","status":5,"started_at":"2024-01-02 03:04:05"},"customer":{"customer_email":"A@X"},"product":{"name":"n","trial_amount":"7"},'
         '"invoices":{"i":{"orders":{"o":{"status":"settle_ok","amount":3,"processed_at":"2024-02-01 00:00:00","retry_attempt":1,"failed_reason":null},"n":null}},"j":null}}',
         '{"subscription":{"id":"s"},"customer":7,"invoices":{"i":{"orders":{"p":{"status":{"x":1},"amount":"1.5"}}}}}',
         '{"subscription":{"id":"s"},"invoices":"none","product":[1]}', '{"subscription":{"id":"s"},"invoices":{"i":{"orders":{"q":', '{"subscription":null,"invoices":{}}',
         "", "null", "[]", "no json", None, '{"invoices":{"i":{"orders":[1]}},"subscription":{"id":1}}', '{"subscription":{"id":"a"},"subscription":{"id":"b"},"invoices":{"i":{"orders":{"r":{}}}}}']


def test_fields_not_needed_change_nothing(spark):
    raw = spark.createDataFrame([(k, "update", t) for k, t in enumerate(TEXTS)], "event_id int, event_type string, data string").withColumn("created", F.timestamp_seconds("event_id"))
    for read, schema in ((C.flat_b, C.FLAT_B), (C.orders_b, C.ORDERS_B)):
        few, all_ = (sorted(map(str, read(C.parse_b(raw, s)).collect())) for s in (schema, C.PAYLOAD_B))
        assert few == all_ and few


def test_copied_hashes_may_be_given(spark):
    raw = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, None), (2, None), (3, "z")], "event_id int, data string")
    assert sorted((r.event_id, str(r.data)) for r in C.dedup_exact(raw, C.copied(raw)).collect()) == [(1, "x"), (1, "y"), (2, "None"), (3, "z")]
