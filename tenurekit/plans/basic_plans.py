"""Scans, sinks, filters, picks and samples on the driver's tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurekit.functions.exprs import billday_bin, clip, fill_blank, lookup, null_token, r6, url_dim
from tenurekit.functions.ordered import cut, shared_dir
from tenurekit.operators import ml as M
from tenurekit.operators import sample as U
from tenurekit.params import ORDERS_WEB as P
from tenurekit.plans import sql as Q
from tenurekit.plans.clean_plans import SILV, silver
from tenurekit.plans.ladder_plans import OMX, orders_mx
from tenurekit.plans.ltv_plans import table_sql, web, web_state
from tenurekit.plans.registry import query
from tenurekit.schema import CELL_PREDICTIONS, remap
from tenurekit.sources import io
from tenurekit.sources.adapters import order_events, table, web_events


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("parquet_scan", "S1", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_scan(spark, d):
    s = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return io.read_parquet(spark, f"{d}/nation.parquet", s)


@query("newest_snapshot", "S2", "SELECT c_custkey, c_mktsegment, DATE '2024-02-01' AS snapshot_date FROM customer")
def newest_snapshot(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    path = scratch(spark, "snapshots")
    days = F.array(*[F.lit(x).cast("date") for x in ("2024-01-01", "2024-01-15", "2024-02-01")])
    io.write_parquet(c.withColumn("snapshot_date", F.explode(days)), path, ["snapshot_date"])
    return io.newest_snapshot(io.read_parquet(spark, path)).select("c_custkey", "c_mktsegment", "snapshot_date")


@query("event_scan", "S3 F2", f"""WITH {Q.WE} SELECT lower(email) AS email, event_type, epoch_us(ts) AS ts_us, tie FROM we WHERE event_type IN ('trial_started', 'subscription_started')
 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01' AND funnel_name IN ('FURNITURE', 'MACHINERY')""")
def event_scan(spark, d):
    e = web_events(spark, d).withColumnRenamed("funnel_name", "app_name")
    s = io.event_scan(e, ("trial_started", "subscription_started"), F.lit("1996-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp"),
                      ("FURNITURE", "MACHINERY"), columns=["event_type", "ts", "tie"])
    return s.select("email", "event_type", F.unix_micros("ts").alias("ts_us"), "tie")


@query("csv_round_trip", "S5 S6", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'NA' WHEN c_nationkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS label, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey") % 3
    out = c.select("c_custkey", F.when(n == 0, "NA").when(n == 1, None).otherwise(F.col("c_mktsegment")).alias("label"), "c_acctbal")
    path = scratch(spark, "csv")
    io.write_csv(out, path)
    return io.read_csv(spark, path, out.schema)


@query("staged_extract", "S7", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def staged_extract(spark, d):
    path = scratch(spark, "stage")

    def build():
        return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    io.stage(spark, path, build)
    return io.stage(spark, path, build)


LAYOUT = {"cohort_date": ("cohort_date", "date"), "funnel": ("first_funnel", "string"), "utm_source": ("utm_source", "string"), "n_trial": ("n_trial", "bigint"),
          "n_base_payer": ("n_base_payer", "bigint"), "payer_rate": ("conversion", "double"), "low_n": ("low_n", "boolean"), "ltv_current": ("ltv_per_base_payer_current", "double")}


@query("conformed_predictions", "S8 S10 S6", f"""{table_sql(['cohort_date', 'first_funnel', 'utm_source'])} SELECT cohort_date, first_funnel AS funnel, utm_source, n_trial, n_base_payer, conversion AS payer_rate, low_n, ltv_per_base_payer_current AS ltv_current FROM tb""")
def conformed_predictions(spark, d):
    from tenurekit.operators import ltv as V
    w = web(spark, d)
    t = V.rounded_cells(V.cell_table(w, web_state(spark, d, w), P, ["cohort_date", "first_funnel", "utm_source"]))
    path = scratch(spark, "predictions")
    io.overwrite_table(remap(t, LAYOUT), CELL_PREDICTIONS, path, [path])
    return io.read_parquet(spark, path)


@query("snapshot_manifest", "S9 A1", "SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def snapshot_manifest(spark, d):
    return io.manifest({t: table(spark, d, t) for t in ("customer", "events", "lineitem", "orders")})


@query("list_and_prefix_filters", "F2 K1", "SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE 'p%' OR (event_type NOT IN ('view', 'click') AND event_type <> 'error') GROUP BY 1")
def list_and_prefix_filters(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events", "event_type").where(t.like("p%") | (~t.isin("view", "click") & (t != "error"))).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")).orderBy("event_type")


@query("fixed_bins", "F7", f"SELECT bin, count(*) AS n FROM (SELECT {Q.bins('day(o_orderdate)')} AS bin FROM orders) GROUP BY 1")
def fixed_bins(spark, d):
    return table(spark, d, "orders", "o_orderdate").groupBy(billday_bin(F.dayofmonth("o_orderdate")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("top_categories", "F12 K2", "WITH c AS (SELECT n_name AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 10) SELECT CASE WHEN v IN (SELECT v FROM t) THEN v ELSE 'other' END AS geo, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def top_categories(spark, d):
    e = order_events(spark, d).where("kind = 'pay'").select("geo")
    tops = M.top_categories(e, ["geo"], 10)
    return M.collapse(e, tops, ["geo"]).groupBy("geo").agg(F.count(F.lit(1)).alias("n"))


@query("page_names", "X8", """SELECT page_id, CASE WHEN lower(trim(url_decode(replace(url, '+', '%2B')))) IN ('', 'unknown', 'none', 'null', '{', 'nan', 'campaign_name') THEN '(missing)' ELSE trim(url_decode(replace(url, '+', '%2B'))) END AS name FROM pages""")
def page_names(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", url_dim("url", "campaign_name").alias("name"))


@query("bounded_money", "F6 T9", "SELECT event_id, round(CASE WHEN value < 5 THEN 5 WHEN value > 100 THEN 100 ELSE value END, 2) AS clipped FROM events")
def bounded_money(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(clip("value", 5.0, 100.0), 2).alias("clipped"))


@query("largest_keys", "K2", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25")
def largest_keys(spark, d):
    g = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return U.top_k(g, F.col("total"), 25, "o_custkey").withColumn("total", F.round("total", 2))


@query("largest_deviations", "K2", """SELECT o_custkey, n, round(abs(n / 10.0::DOUBLE - 1), 6) AS deviation FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY abs(n / 10.0::DOUBLE - 1) DESC, o_custkey LIMIT 25""")
def largest_deviations(spark, d):
    g = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    dev = F.abs(F.col("n") / 10.0 - 1)
    return U.top_k(g, dev, 25, "o_custkey").withColumn("deviation", r6(dev))


@query("representative_apps", "K4", f"""{OMX}, s AS (SELECT geo, count(DISTINCT sub_id) AS n FROM mx GROUP BY 1), b AS (SELECT geo FROM s ORDER BY n DESC, geo LIMIT 2), m AS (SELECT geo FROM s WHERE geo NOT IN (SELECT geo FROM b) ORDER BY abs(n - (SELECT median(n) FROM s)), geo LIMIT 2)
 SELECT geo, min_by(reason, o) AS reason FROM (SELECT geo, 'largest' AS reason, 0 AS o FROM b UNION ALL SELECT geo, 'median', 1 FROM m UNION ALL SELECT geo, 'named', 2 FROM s WHERE geo IN ('NATION_3', 'NATION_7')) GROUP BY 1""")
def representative_apps(spark, d):
    s = cut(orders_mx(spark, d).groupBy("geo").agg(F.count_distinct("sub_id").alias("n")))
    return U.representatives(s, "geo", "n", ["NATION_3", "NATION_7"])


@query("stage_preview", "K5", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def stage_preview(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.orderBy("o_orderkey").limit(1000).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("bounded_sample", "U5", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 5000")
def bounded_sample(spark, d):
    return U.bounded_sample(table(spark, d, "orders", "o_orderkey", "o_custkey"), ["o_orderkey"], 5000)


STRATA = (("a_voluntary", "provider_a", "voluntary", 2), ("a_involuntary", "provider_a", "involuntary", 2), ("a_renewer", "provider_a", "renewer", 2),
          ("b_fraud", "provider_b", "fraud", 1), ("b_involuntary", "provider_b", "involuntary", 2), ("b_voluntary", "provider_b", "voluntary", 1))
QUOTA, SEED = 10, 20260707


def strata_sql() -> str:
    """One member per pick, each without the keys of the picks before."""
    flags = ", ".join(f"bool_or(name = 'subscription_expired' AND coalesce(churn = '{x}', false)) AS {x}" for x in ("voluntary", "involuntary", "fraud"))
    out = [f"""{SILV}, kk AS (SELECT sub AS subscription_id, pv AS payment_provider, {flags},
 count(*) FILTER (name = 'subscription_renewed') >= 2 AND count(*) FILTER (name = 'subscription_expired') = 0 AS renewer, md5('{SEED}|' || sub) AS h FROM si WHERE sub IS NOT NULL GROUP BY 1, 2)"""]
    groups = sorted({g for _, g, _, _ in STRATA})
    fill = [("fill", g, "true", max(0, QUOTA - sum(n for _, x, _, n in STRATA if x == g))) for g in groups]
    for i, (name, g, cond, n) in enumerate([*STRATA, *fill]):
        gone = " UNION ALL ".join(f"SELECT subscription_id FROM pk{j}" for j in range(i))
        rest = f" AND subscription_id NOT IN ({gone})" if i else ""
        out.append(f" pk{i} AS (SELECT subscription_id, payment_provider, '{name}' AS stratum FROM kk WHERE payment_provider = '{g}' AND {cond}{rest} ORDER BY h, subscription_id LIMIT {n})")
    return ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM pk{i}" for i in range(len(STRATA) + len(groups)))


@query("stratified_chains", "U4", strata_sql())
def stratified_chains(spark, d):
    s = silver(spark, d).where("subscription_id is not null")
    term, c = F.col("event_name") == "subscription_expired", F.col("churn_type")
    k = s.groupBy("subscription_id", "payment_provider").agg(
        *[F.max(term & (c == x)).alias(x) for x in ("voluntary", "involuntary", "fraud")],
        ((F.count_if(F.col("event_name") == "subscription_renewed") >= 2) & (F.count_if(term) == 0)).alias("renewer"))
    return U.stratified(cut(k.fillna(False)), "subscription_id", "payment_provider", [(n, g, F.col(x), m) for n, g, x, m in STRATA], QUOTA, SEED)


@query("labels_and_fallbacks", "F4 F5 F9", """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN NULL WHEN c_nationkey % 4 = 2 THEN 'x' ELSE c_mktsegment END AS token, CASE WHEN c_nationkey % 4 = 0 THEN '(none)' WHEN c_nationkey % 4 = 1 THEN ' Unknown' WHEN c_nationkey % 4 = 2 THEN 'x' ELSE c_mktsegment END AS filled,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'FURNITURE' THEN 'f' ELSE 'other' END AS short FROM customer""")
def labels_and_fallbacks(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey") % 4
    c = c.withColumn("raw", F.when(n == 0, "").when(n == 1, " Unknown").when(n == 2, "x").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", null_token("raw").alias("token"), fill_blank("raw", "(none)").alias("filled"), lookup("c_mktsegment", {"BUILDING": "b", "FURNITURE": "f"}, "other").alias("short"))


@query("cohort_fact_pivot", "A12", "SELECT year(o_orderdate)::BIGINT AS year, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1")
def cohort_fact_pivot(spark, d):
    o = table(spark, d, "orders", "o_orderdate", "o_orderstatus").withColumn("year", F.year("o_orderdate").cast("bigint"))
    p = o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    return p.select("year", *[F.col(s).alias(f"n_{s.lower()}") for s in "FOP"])


