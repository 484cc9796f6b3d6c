"""Cleaning of webhook logs made from the driver's tables (JSON text in, lifecycle events out)."""

from functools import reduce

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.functions.ordered import cut
from tenurekit.operators import clean as C
from tenurekit.params import MOBILE as P
from tenurekit.plans import sql as Q
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged
from tenurekit.sources.adapters import table, webhooks_a, webhooks_b

GAP = 21600


def sec(c):
    return F.unix_seconds(c)


EA = """WITH ea AS (SELECT event_id, ts, user_id AS u, event_type AS t, value, k, 'sub_' || lpad(user_id::VARCHAR, 12, '0') AS sub, 'in_' || user_id || '_' || day(ts) AS inv, 'pi_' || user_id || '_' || day(ts) AS pi,
  CAST(round(value * 100) AS BIGINT) AS cents, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
 iv AS (SELECT event_id, ts, inv, CASE WHEN k % 11 <> 0 THEN sub END AS sub, t, CASE WHEN k % 4 = 0 THEN 'subscription_create' ELSE 'subscription_cycle' END AS br, CASE WHEN t = 'purchase' THEN cents END AS cents FROM ea WHERE t IN ('purchase', 'error')),
 bu0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('second', lag(ts) OVER w, ts) > 21600 THEN 1 ELSE 0 END AS nb FROM iv WHERE sub IS NOT NULL WINDOW w AS (PARTITION BY inv ORDER BY ts, 'evt_' || event_id)),
 bu1 AS (SELECT *, sum(nb) OVER (PARTITION BY inv ORDER BY ts, 'evt_' || event_id) AS bid FROM bu0),
 bu AS (SELECT inv, sub, bid::BIGINT AS bid, max(CASE WHEN t = 'purchase' THEN 1 ELSE 0 END) AS hp, max(CASE WHEN t = 'error' THEN 1 ELSE 0 END) AS hf, min(br) AS br, max(ts) FILTER (t = 'purchase') AS pa, max(ts) FILTER (t = 'error') AS fa,
   max(cents) FILTER (t = 'purchase') AS cents, count(*) AS n, min(ts) AS bs FROM bu1 GROUP BY 1, 2, 3)"""


def deduped_a(spark, d):
    return C.parse_a(staged(spark, d, "webhooks_a_unique", lambda: C.dedup_by_id(webhooks_a(spark, d))))


@query("dedup_by_id", "E1 W1", """SELECT 'evt_' || event_id AS event_id, epoch_us(ts) AS created_us FROM events UNION ALL SELECT 'evl_' || event_id, epoch_us(ts) FROM events WHERE event_type = 'purchase'""")
def dedup_by_id(spark, d):
    return C.dedup_by_id(webhooks_a(spark, d)).select("event_id", F.unix_micros("created").alias("created_us"))


@query("dedup_exact", "E2 U2", "SELECT o_orderkey * 2 + i AS event_id, count(*) AS n FROM orders JOIN (SELECT unnest([0, 1]) AS i) ON true WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def dedup_exact(spark, d):
    w = webhooks_b(spark, d)
    return C.dedup_exact(w.unionByName(w)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("frozen_log", "S4", "SELECT 'evt_' || event_id AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'evl_' || event_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-15'")
def frozen_log(spark, d):
    return C.dedup_by_id(C.frozen(webhooks_a(spark, d), F.lit("2024-01-15").cast("timestamp"))).select("event_id")


@query("subscription_payloads", "X1 X6", f"""{EA} SELECT 'evt_' || event_id AS event_id, sub AS subscription_id, substring(sub, 11, 10) AS account, 'week' AS plan_interval, 'price_' || (k % 3) AS price_id,
 CASE WHEN t = 'view' AND k % 3 = 0 THEN s + k * 3600 END AS period_end_epoch, CASE WHEN t = 'view' AND k % 3 = 1 THEN s + k * 60 END AS ended_epoch, CASE WHEN t = 'view' AND k % 5 = 0 THEN s + k END AS cancel_epoch,
 CASE WHEN t = 'view' THEN CASE k % 3 WHEN 0 THEN 'cancellation_requested' WHEN 1 THEN 'payment_failed' END END AS reason FROM ea WHERE t IN ('view', 'signup')""")
def subscription_payloads(spark, d):
    return C.subscription_events(deduped_a(spark, d)).select("event_id", "subscription_id", "account", "plan_interval", "price_id", "period_end_epoch", "ended_epoch", "cancel_epoch", "reason")


@query("invoice_bursts", "E3 W5 A3 X1", f"{EA} SELECT inv AS invoice_id, sub AS subscription_id, bid AS burst_id, hp::BIGINT AS has_paid, hf::BIGINT AS has_failed, br AS billing_reason, epoch_us(pa) AS paid_us, epoch_us(fa) AS failed_us, cents AS amount_cents, n AS n_rows, epoch_us(bs) AS start_us FROM bu")
def invoice_bursts(spark, d):
    b = C.bursts(C.invoice_rows(deduped_a(spark, d)), P, GAP)
    return b.select("invoice_id", "subscription_id", "burst_id", "has_paid", "has_failed", "billing_reason", F.unix_micros("paid_at").alias("paid_us"), F.unix_micros("failed_at").alias("failed_us"),
                    "amount_cents", "n_rows", F.unix_micros("burst_start").alias("start_us"))


OUTA = """oa AS (SELECT *, hp = 1 AND br <> 'subscription_create' AS cyc, sum(CASE WHEN hp = 1 AND br <> 'subscription_create' THEN 1 ELSE 0 END) OVER (PARTITION BY sub ORDER BY bs, inv, bid) AS rn FROM bu),
 ob AS (SELECT sub, CASE WHEN hp = 1 THEN pa ELSE fa END AS tm, CASE WHEN hp = 1 AND NOT cyc THEN 'trial_payment' WHEN cyc AND rn = 1 THEN 'trial_converted' WHEN cyc THEN 'subscription_renewed' ELSE 'billing_issue_detected' END AS name,
  CASE WHEN hp = 1 THEN 'invoice.paid' ELSE 'invoice.payment_failed' END AS raw, CASE WHEN hp = 1 THEN cents END AS cents, inv FROM oa)"""


def outcomes_a(parsed):
    return C.invoice_outcomes(C.bursts(C.invoice_rows(parsed), P, GAP), P)


@query("invoice_outcomes", "E4 W13", f"{EA}, {OUTA} SELECT sub AS subscription_id, epoch_us(tm) AS at_us, name AS event_name, raw AS raw_event_type, cents AS amount_cents, inv AS invoice_id FROM ob")
def invoice_outcomes(spark, d):
    return outcomes_a(deduped_a(spark, d)).select("subscription_id", F.unix_micros("event_datetime").alias("at_us"), "event_name", "raw_event_type", "amount_cents", "invoice_id")


STA = """sa AS (SELECT sub, CASE WHEN t = 'signup' THEN epoch_us(ts) ELSE coalesce(CASE WHEN k % 3 = 0 THEN (s + k * 3600) * 1000000 END, CASE WHEN k % 3 = 1 THEN (s + k * 60) * 1000000 END, CASE WHEN k % 5 = 0 THEN (s + k) * 1000000 END, epoch_us(ts)) END AS at_us,
  CASE WHEN t = 'signup' THEN 'trial_started' ELSE 'subscription_expired' END AS name, CASE WHEN t = 'view' THEN CASE k % 3 WHEN 0 THEN 'voluntary' WHEN 1 THEN 'involuntary' ELSE 'unknown' END END AS churn, CASE WHEN t = 'view' THEN epoch_us(ts) END AS sig,
  CASE WHEN t = 'signup' THEN 'customer.subscription.created' ELSE 'customer.subscription.deleted' END AS raw FROM ea WHERE t IN ('view', 'signup'))"""


@query("state_events", "E5 F9 X16", f"{EA}, {STA} SELECT sub AS subscription_id, at_us, name AS event_name, churn AS churn_type, sig AS signal_us FROM sa")
def state_events(spark, d):
    return C.state_events(C.subscription_events(deduped_a(spark, d))).select(
        "subscription_id", F.unix_micros("event_datetime").alias("at_us"), "event_name", "churn_type", F.unix_micros("churn_signal_datetime").alias("signal_us"))


RFA = """lk AS (SELECT DISTINCT pi, inv FROM ea WHERE t = 'purchase'), sv AS (SELECT DISTINCT inv, sub FROM iv WHERE sub IS NOT NULL),
 ra AS (SELECT event_id, sv.sub, ts, cents, lk.inv FROM ea LEFT JOIN lk USING (pi) LEFT JOIN sv ON sv.inv = lk.inv WHERE t = 'click')"""


@query("refunds_attached", "E6 J6", f"{EA}, {RFA} SELECT 'evt_' || event_id AS event_id, sub AS subscription_id, epoch_us(ts) AS at_us, cents AS amount_cents, inv AS invoice_id, sub IS NULL AS refund_orphan FROM ra")
def refunds_attached(spark, d):
    p = deduped_a(spark, d)
    return C.refunds_a(p, C.invoice_rows(p)).select("event_id", "subscription_id", F.unix_micros("event_datetime").alias("at_us"), "amount_cents", "invoice_id", "refund_orphan")


@query("paid_invoices", "E26", f"{EA} SELECT inv AS invoice_id, arg_min(coalesce(sub, '-'), (ts, 'evt_' || event_id)) AS subscription_id, round(arg_min(cents, (ts, 'evt_' || event_id)) / 100.0, 2) AS amount, epoch_us(min(ts)) AS pay_us FROM iv WHERE t = 'purchase' GROUP BY 1")
def paid_invoices(spark, d):
    return C.paid_invoices(C.invoice_rows(deduped_a(spark, d))).select("invoice_id", F.coalesce("subscription_id", F.lit("-")).alias("subscription_id"), F.round("amount", 2).alias("amount"), F.unix_micros("payment_ts").alias("pay_us"))


# ------------------------------------------------------------------ provider B
EB = """WITH sb AS (SELECT o_orderkey AS ok, 'sb_' || o_custkey AS sub, o_custkey AS c, o_orderdate AS od, o_orderstatus AS os, CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '4-NOT SPECIFIED' THEN 'expire' WHEN '5-LOW' THEN 'cancel' ELSE 'renew' END AS kind,
   CASE o_custkey % 4 WHEN 0 THEN 'voluntary' WHEN 1 THEN 'involuntary' WHEN 2 THEN 'fraud' ELSE 'unknown' END AS churn FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 ol AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS order_id, sub, 'inv_' || ok AS inv, CASE l_returnflag WHEN 'A' THEN 'auth_failed' WHEN 'N' THEN 'settle_ok' ELSE 'refunded' END AS st, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
   CASE WHEN l_tax >= 0.01 THEN l_shipdate END AS pr, l_linenumber::BIGINT AS retry FROM lineitem JOIN sb ON ok = l_orderkey)"""


def parsed_b(spark, d, schema=C.PAYLOAD_B):
    raw = staged(spark, d, "webhooks_b", lambda: webhooks_b(spark, d))
    return C.parse_b(C.dedup_exact(raw, staged(spark, d, "copied_b", lambda: C.copied(raw))), schema)


def flat(spark, d):
    return staged(spark, d, "flat_b", lambda: C.flat_b(parsed_b(spark, d, C.FLAT_B)))


def nested(spark, d):
    return staged(spark, d, "orders_b", lambda: C.orders_b(parsed_b(spark, d, C.ORDERS_B)))


@query("nested_orders", "E7 X2", f"{EB} SELECT order_id, sub AS subscription_id, inv AS invoice_id, st AS status, cents AS amount_cents, epoch_us(pr) AS processed_us, retry AS retry_attempt FROM ol")
def nested_orders(spark, d):
    return C.orders_b(parsed_b(spark, d, C.ORDERS_B)).select("order_id", "subscription_id", "invoice_id", "status", "amount_cents", F.unix_micros("processed_at").alias("processed_us"), "retry_attempt")


OUTB = """o1 AS (SELECT *, sum(CASE WHEN st = 'settle_ok' AND cents > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sub ORDER BY pr, retry, order_id) AS rn FROM ol WHERE pr IS NOT NULL),
 o2 AS (SELECT sub, pr AS tm, order_id, CASE WHEN st = 'settle_ok' AND rn = 1 THEN 'trial_converted' WHEN st = 'settle_ok' THEN 'subscription_renewed' WHEN st = 'auth_failed' THEN 'billing_issue_detected' ELSE 'subscription_refunded' END AS name,
  CASE WHEN st = 'auth_failed' THEN 'order:auth_failed(retry=' || retry || ')' ELSE 'order:' || st END AS raw, CASE WHEN st <> 'auth_failed' THEN cents END AS cents FROM o1)"""


@query("order_outcomes", "E8 W13", f"{EB}, {OUTB} SELECT sub AS subscription_id, epoch_us(tm) AS at_us, name AS event_name, raw AS raw_event_type, cents AS amount_cents, order_id FROM o2")
def order_outcomes(spark, d):
    return C.order_outcomes(nested(spark, d), P, stored=True).select("subscription_id", F.unix_micros("event_datetime").alias("at_us"), "event_name", "raw_event_type", "amount_cents", "order_id")


STB = """s1 AS (SELECT sub, min(od + INTERVAL 1 DAY) FILTER (kind = 'create') AS a, min(od) FILTER (c % 3 <> 0) AS b, min(od) AS f FROM sb GROUP BY 1),
 s2 AS (SELECT sub, coalesce(a, b, f) AS tm, CASE WHEN a IS NOT NULL THEN 'create/active' WHEN b IS NOT NULL THEN 'synth:started_at' ELSE 'synth:first_event' END AS raw FROM s1)"""


@query("one_start_per_subscription", "E9", f"{EB}, {STB} SELECT sub AS subscription_id, epoch_us(tm) AS at_us, raw AS raw_event_type FROM s2")
def one_start_per_subscription(spark, d):
    return C.starts_b(flat(spark, d)).select("subscription_id", F.unix_micros("event_datetime").alias("at_us"), "raw_event_type")


@query("missing_starts", "E10 J8", f"""{EA}, {OUTA}, {STA}, un AS (SELECT 'all' AS log, sub, name, epoch_us(tm) AS a FROM ob UNION ALL SELECT 'all', sub, name, at_us FROM sa UNION ALL SELECT 'invoices', sub, name, epoch_us(tm) FROM ob)
 SELECT log, sub AS subscription_id, min(a) AS at_us FROM un GROUP BY 1, 2 HAVING NOT bool_or(name = 'trial_started')""")
def missing_starts(spark, d):
    """Subscriptions without a start: in the whole log of provider A, and in its invoices alone."""
    p = deduped_a(spark, d)
    inv, st = outcomes_a(p), C.state_events(C.subscription_events(p))
    logs = {"all": inv.unionByName(st, allowMissingColumns=True), "invoices": inv}
    out = [C.missing_starts(e).select(F.lit(n).alias("log"), "subscription_id", F.unix_micros("event_datetime").alias("at_us")) for n, e in logs.items()]
    return out[0].unionByName(out[1])


@query("grace_entries", "E11 W11", f"""{EB}, r0 AS (SELECT sub, ok * 2 + i AS eid, od + to_days(i) AS cr, os = 'P' AS red FROM sb JOIN (SELECT unnest([0, 1]) AS i) ON true),
 r1 AS (SELECT *, lag(red) OVER (PARTITION BY sub ORDER BY cr, eid) AS was FROM r0) SELECT sub AS subscription_id, epoch_us(cr) AS at_us FROM r1 WHERE red AND NOT coalesce(was, false)""")
def grace_entries(spark, d):
    return C.entry_edges(flat(spark, d), P, stored=True).select("subscription_id", F.unix_micros("event_datetime").alias("at_us"))


TERM = """t1 AS (SELECT sub, max(pr) AS last FROM ol WHERE st = 'settle_ok' GROUP BY 1),
 t2 AS (SELECT sb.sub, ok * 2 + 1 AS eid, kind, od, CASE WHEN kind = 'cancel' THEN churn ELSE 'involuntary' END AS churn, CASE WHEN kind = 'cancel' THEN CASE WHEN os = 'F' THEN od + INTERVAL 30 DAY END
   ELSE coalesce(CASE WHEN os = 'F' THEN od + INTERVAL 30 DAY END, CASE c % 5 WHEN 0 THEN last + INTERVAL 7 DAY WHEN 1 THEN last + INTERVAL 30 DAY WHEN 2 THEN last + INTERVAL 365 DAY WHEN 3 THEN last + INTERVAL 1 DAY END) END AS death
  FROM sb LEFT JOIN t1 USING (sub) WHERE kind IN ('expire', 'cancel')),
 t3 AS (SELECT *, coalesce(death, od + INTERVAL 1 DAY) AS tm, od + INTERVAL 1 DAY AS sig FROM t2)"""


@query("terminal_events", "E12 F9 X9 X13", f"{EB}, {TERM} SELECT eid AS event_id, sub AS subscription_id, epoch_us(tm) AS at_us, kind AS raw_event_type, churn AS churn_type, epoch_us(sig) AS signal_us FROM t3")
def terminal_events(spark, d):
    t = C.terminals(flat(spark, d), nested(spark, d))
    return t.select("event_id", "subscription_id", F.unix_micros("event_datetime").alias("at_us"), "raw_event_type", "churn_type", F.unix_micros("churn_signal_datetime").alias("signal_us"))


@query("cadence", "E13 W2 A4", f"""{EB}, {OUTB}, g1 AS (SELECT sub, {Q.days('lag(tm) OVER (PARTITION BY sub ORDER BY tm, name)', 'tm')} AS gap FROM o2 WHERE name IN ('trial_converted', 'subscription_renewed')),
 g2 AS (SELECT sub, median(gap) AS gap FROM g1 WHERE gap IS NOT NULL GROUP BY 1)
 SELECT sub AS subscription_id, round(gap, 6) AS median_gap, CASE least(abs(gap - 1), abs(gap - 7), abs(gap - 30), abs(gap - 365)) WHEN abs(gap - 1) THEN 'day' WHEN abs(gap - 7) THEN 'week' WHEN abs(gap - 30) THEN 'month' ELSE 'year' END AS interval_unit FROM g2""")
def cadence(spark, d):
    return C.cadence(C.order_outcomes(nested(spark, d), P, stored=True), P).withColumn("median_gap", r6("median_gap"))


ATT = """WITH al AS (SELECT 'u' || user_id AS email, ts AS event_date, CASE WHEN k % 5 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'US' ELSE 'C' || (k % 3) END AS country, CASE WHEN k % 17 = 3 THEN 'test' ELSE 'm' || (k % 4) END AS utm_source, 'c' || k AS campaign_name, CASE WHEN k % 3 = 0 THEN 'App_W' END AS app_name FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
 ky AS (SELECT c_custkey AS key, 'u' || c_custkey AS email, TIMESTAMP '2024-01-05' + to_days(c_nationkey) AS install_date FROM customer),
 am AS (SELECT email, count(DISTINCT country) AS cc, bool_or(country IS NOT NULL) AS re FROM al GROUP BY 1),
 rk AS (SELECT key, al.*, cc, re, cc > 1 AS many, install_date, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN country IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN cc > 1 AND event_date <= install_date THEN 0 ELSE 1 END,
   CASE WHEN cc > 1 AND event_date <= install_date THEN -epoch_us(event_date) ELSE epoch_us(event_date) END, coalesce(country, ''), coalesce(utm_source, '')) AS rn FROM ky LEFT JOIN al USING (email) LEFT JOIN am USING (email))"""


def attribution(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    log = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.col("ts").alias("event_date"),
                   F.when(F.col("k") % 5 == 0, None).when(F.col("user_id") % 4 == 0, "US").otherwise(F.concat(F.lit("C"), (F.col("k") % 3).cast("string"))).alias("country"),
                   F.when(F.col("k") % 17 == 3, "test").otherwise(F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))).alias("utm_source"),
                   F.concat(F.lit("c"), F.col("k").cast("string")).alias("campaign_name"), F.when(F.col("k") % 3 == 0, "App_W").alias("app_name"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    keys = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("email"),
                    (F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(F.col("c_nationkey"))).alias("install_date"))
    return keys, log


@query("attribution_as_of", "J5 E14 K3", f"{ATT} SELECT key, CASE WHEN re THEN country END AS country, utm_source, campaign_name, CASE WHEN cc IS NULL THEN 'no_match' WHEN re THEN 'resolved' ELSE 'unknown' END AS geo_status, coalesce(many, false) AS geo_ambiguous FROM rk WHERE rn = 1")
def attribution_as_of(spark, d):
    return C.resolve_attribution(*attribution(spark, d))


@query("attribution_coalesce", "J11 E14 F4", f"""{ATT}, w1 AS (SELECT o_custkey AS key, arg_min(CASE WHEN o_orderpriority = '1-URGENT' THEN ' None ' ELSE o_orderpriority END, (o_orderdate, o_orderkey)) AS own FROM orders GROUP BY 1),
 nn AS (SELECT key, CASE WHEN lower(trim(own)) IN ('', 'null', 'none', 'unknown') THEN NULL ELSE trim(own) END AS own, utm_source AS att FROM rk LEFT JOIN w1 USING (key) WHERE rn = 1)
 SELECT key, coalesce(own, att) AS media, CASE WHEN own IS NOT NULL THEN 'subscription' WHEN att IS NOT NULL THEN 'attribution' ELSE 'none' END AS media_step FROM nn""")
def attribution_coalesce(spark, d):
    keys, log = attribution(spark, d)
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", " None ").otherwise(F.col("o_orderpriority"))
    own = o.groupBy(F.col("o_custkey").alias("key")).agg(F.min_by(raw, F.struct("o_orderdate", "o_orderkey")).alias("own"))
    j = C.resolve_attribution(keys, log).select("key", F.col("utm_source").alias("att")).join(own, "key", "left")
    return j.select("key", *C.first_known({"own": "subscription", "att": "attribution"}, "media"))


APPS = {"p0": "app_a", "p1": "app_a", "p2": "app_b", "p3": "app_c"}


@query("reclassified_apps", "E16 J12 F9", f"""{EB} SELECT sub AS subscription_id, CASE WHEN any_value(c) % 2 = 0 THEN 'p' || (any_value(c) % 7) ELSE 'p1' END AS product_id, CASE CASE WHEN any_value(c) % 2 = 0 THEN any_value(c) % 7 ELSE 1 END WHEN 0 THEN 'app_a' WHEN 1 THEN 'app_a' WHEN 2 THEN 'app_b' WHEN 3 THEN 'app_c' ELSE 'other' END AS app_id, 'old' AS app_id_old FROM sb GROUP BY 1""")
def reclassified_apps(spark, d):
    f = flat(spark, d).groupBy("subscription_id").agg(F.min("product_id").alias("product_id"))
    fresh = f.where(F.substring("subscription_id", 4, 20).cast("bigint") % 2 == 0)
    rows = f.select("subscription_id", F.lit("p1").alias("product_id"), F.lit("old").alias("app_id"))
    return C.reclassify(rows, fresh, APPS).select("subscription_id", "product_id", "app_id", "app_id_old")


@query("qa_flags", "E15", f"""{EB}, {OUTB}, n1 AS (SELECT sub, count(*) AS n FROM o2 WHERE name IN ('trial_converted', 'subscription_renewed') GROUP BY 1)
 SELECT s.sub AS subscription_id, coalesce(n, 0) AS n_payments, any_value(c) % 5 = 3 OR coalesce(n, 0) > 20 OR 'u' || any_value(c) LIKE '%99%' AS is_qa FROM sb s LEFT JOIN n1 USING (sub) GROUP BY s.sub, n""")
def qa_flags(spark, d):
    p = flat(spark, d)
    from tenurekit.functions.exprs import interval_word
    subs = p.groupBy("subscription_id").agg(F.min("product_name").alias("pn"), F.min("email").alias("e")).select(
        "subscription_id", interval_word("pn").alias("interval_unit"), F.when(F.regexp_replace(F.split("e", "@")[0], "u", "").contains("99"), "Test-src").otherwise("x").alias("utm_source"))
    pay = C.order_outcomes(nested(spark, d), P, stored=True).where("event_name in ('trial_converted', 'subscription_renewed')")
    return C.qa_flags(subs, pay, 20).select("subscription_id", "n_payments", "is_qa")


SILV = f"""{EA}, {OUTA}, {STA}, {RFA}, {EB.split('WITH ', 1)[1]}, {OUTB}, {STB}, {TERM},
 gr0 AS (SELECT sub, ok * 2 + i AS eid, od + to_days(i) AS cr, os = 'P' AS red, CASE WHEN i = 0 THEN 'update' ELSE kind END AS rw FROM sb JOIN (SELECT unnest([0, 1]) AS i) ON true), gr AS (SELECT *, lag(red) OVER (PARTITION BY sub ORDER BY cr, eid) AS was FROM gr0),
 ms AS (SELECT sub, min(a) AS a FROM (SELECT sub, name, epoch_us(tm) AS a FROM ob UNION ALL SELECT sub, name, at_us FROM sa UNION ALL SELECT sub, 'subscription_refunded', epoch_us(ts) FROM ra) WHERE sub IS NOT NULL GROUP BY 1 HAVING NOT bool_or(name = 'trial_started')),
 si AS (SELECT sub, 'provider_a' AS pv, name, epoch_us(tm) AS a, cents, NULL AS churn, false AS orphan, raw, NULL::BIGINT AS sig FROM ob WHERE name <> 'trial_payment' UNION ALL SELECT sub, 'provider_a', name, at_us, NULL, churn, false, raw, sig FROM sa
  UNION ALL SELECT sub, 'provider_a', 'trial_started', a, NULL, NULL, false, 'synth:pre_window', NULL FROM ms
  UNION ALL SELECT sub, 'provider_a', 'subscription_refunded', epoch_us(ts), cents, NULL, sub IS NULL, 'charge.refunded', NULL FROM ra UNION ALL SELECT sub, 'provider_b', name, epoch_us(tm), cents, NULL, false, raw, NULL FROM o2
  UNION ALL SELECT sub, 'provider_b', 'trial_started', epoch_us(tm), NULL, NULL, false, raw, NULL FROM s2 UNION ALL SELECT sub, 'provider_b', 'subscription_expired', epoch_us(tm), NULL, churn, false, kind, epoch_us(sig) FROM t3
  UNION ALL SELECT sub, 'provider_b', 'entered_grace_period', epoch_us(cr), NULL, NULL, false, rw, NULL FROM gr WHERE red AND NOT coalesce(was, false))"""


def parsed_a(spark, d):
    return staged(spark, d, "parsed_a", lambda: deduped_a(spark, d))


def outcomes(spark, d):
    return staged(spark, d, "outcomes_a", lambda: outcomes_a(parsed_a(spark, d)))


def silver(spark, d):
    return staged(spark, d, "silver", lambda: _silver(spark, d))


def _silver(spark, d):
    a, b, orders = parsed_a(spark, d), flat(spark, d), nested(spark, d)
    inv = C.invoice_rows(a)
    parts = [outcomes(spark, d), C.state_events(C.subscription_events(a)), C.refunds_a(a, inv)]
    known = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [x.select("subscription_id", "event_datetime", "event_name") for x in parts])
    return C.assemble({
        "provider_a": [*parts, C.missing_starts(known)],
        "provider_b": [C.order_outcomes(orders, P, stored=True), C.starts_b(b), C.terminals(b, orders), C.entry_edges(b, P, stored=True)]})


@query("silver_events", "E17 U1", f"{SILV} SELECT payment_provider, event_name, coalesce(churn_type, '-') AS churn_type, count(*) AS n, count(DISTINCT subscription_id) AS subs, sum(amount_cents)::BIGINT AS cents, min(a) AS first_us, max(a) AS last_us, count(*) FILTER (orphan) AS orphans FROM (SELECT pv AS payment_provider, name AS event_name, churn AS churn_type, sub AS subscription_id, cents AS amount_cents, a, orphan FROM si) GROUP BY 1, 2, 3")
def silver_events(spark, d):
    s = silver(spark, d)
    return s.groupBy("payment_provider", "event_name", F.coalesce("churn_type", F.lit("-")).alias("churn_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subscription_id").alias("subs"), F.sum("amount_cents").alias("cents"),
        F.min(F.unix_micros("event_datetime")).alias("first_us"), F.max(F.unix_micros("event_datetime")).alias("last_us"), F.count_if("refund_orphan").alias("orphans"))


ACCOUNT_APPS = {"0000000007": "app_seven", "0000000008": "app_eight"}
DIMS = f"""{SILV}, {ATT.split(' ky AS', 1)[0].split('WITH ', 1)[1]} st0 AS (SELECT sub, min(a) FILTER (name = 'trial_started') AS start_us FROM si WHERE sub IS NOT NULL GROUP BY 1),
 tt AS (SELECT sub, CASE WHEN bool_or(name = 'trial_payment') THEN 'paid' ELSE 'free' END AS tt FROM ob WHERE sub IS NOT NULL GROUP BY 1),
 pa AS (SELECT sub, arg_min('price_' || (k % 3), (ts, 'evt_' || event_id)) AS price_id, arg_min('prod_' || (k % 4), (ts, 'evt_' || event_id)) AS product_id FROM ea WHERE t IN ('view', 'signup') GROUP BY 1),
 pb AS (SELECT sub, any_value(c) AS c, min(od) FILTER (c % 3 <> 0) AS started FROM sb GROUP BY 1),
 dm AS (SELECT s.sub, 'provider_a' AS pv, CASE WHEN price_id IS NOT NULL THEN 'cus_' || u END AS cust, CASE WHEN price_id IS NOT NULL THEN 'u' || u END AS email, substring(s.sub, 11, 10) AS account,
   CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'test' ELSE c_mktsegment END AS om, 'camp-' || c_nationkey AS oc, CASE WHEN c_nationkey % 3 = 0 THEN 'app_n' END AS oa, CASE WHEN price_id IS NOT NULL THEN 'week' END AS pi_, NULL AS pn, price_id, product_id, coalesce(tt, 'none') AS tt, start_us
  FROM (SELECT DISTINCT sub, CAST(substring(sub, 5) AS BIGINT) AS u FROM si WHERE pv = 'provider_a' AND sub IS NOT NULL) s LEFT JOIN pa ON pa.sub = s.sub LEFT JOIN tt ON tt.sub = s.sub LEFT JOIN st0 ON st0.sub = s.sub LEFT JOIN customer ON c_custkey = u
  UNION ALL SELECT p.sub, 'provider_b', 'acc_' || c, 'u' || c, NULL, NULL, NULL, NULL, NULL, CASE c % 5 WHEN 0 THEN 'week' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'day' END, 'p' || (c % 7), 'p' || (c % 7), 'free', coalesce(epoch_us(started), start_us) FROM pb p LEFT JOIN st0 ON st0.sub = p.sub),
 am AS (SELECT email, count(DISTINCT country) AS cc, bool_or(country IS NOT NULL) AS re FROM al GROUP BY 1),
 rk AS (SELECT dm.sub, al.* EXCLUDE (email), cc, re, row_number() OVER (PARTITION BY dm.sub ORDER BY CASE WHEN country IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN cc > 1 AND epoch_us(event_date) <= start_us THEN 0 ELSE 1 END,
   CASE WHEN cc > 1 AND epoch_us(event_date) <= start_us THEN -epoch_us(event_date) ELSE epoch_us(event_date) END, coalesce(country, ''), coalesce(utm_source, '')) AS rn FROM dm LEFT JOIN al USING (email) LEFT JOIN am USING (email)),
 gp1 AS (SELECT sub, {Q.days('lag(tm) OVER (PARTITION BY sub ORDER BY tm, name)', 'tm')} AS gap FROM o2 WHERE name IN ('trial_converted', 'subscription_renewed')), gp2 AS (SELECT sub, median(gap) AS gap FROM gp1 WHERE gap IS NOT NULL GROUP BY 1),
 gp AS (SELECT sub, CASE least(abs(gap - 1), abs(gap - 7), abs(gap - 30), abs(gap - 365)) WHEN abs(gap - 1) THEN 'day' WHEN abs(gap - 7) THEN 'week' WHEN abs(gap - 30) THEN 'month' ELSE 'year' END AS u FROM gp2),
 at_ AS (SELECT dm.sub, cust, account, CAST(make_timestamp(start_us) AS DATE) AS install_date, CASE WHEN re THEN country END AS country_code, coalesce(cc > 1, false) AS geo_ambiguous, CASE WHEN cc IS NULL THEN 'no_match' WHEN re THEN 'resolved' ELSE 'unknown' END AS geo_status,
   nullif(coalesce(om, utm_source), 'test') AS media_source, CASE WHEN om IS NOT NULL THEN 'subscription' WHEN utm_source IS NOT NULL THEN 'attribution' END AS media_source_step, CASE WHEN om IS NOT NULL THEN oc WHEN utm_source IS NOT NULL THEN campaign_name END AS campaign,
   product_id, price_id, coalesce(pi_, pn, u) AS interval_unit, CASE WHEN pi_ IS NOT NULL THEN 'plan' WHEN pn IS NOT NULL THEN 'from_name' WHEN u IS NOT NULL THEN 'inferred_from_cadence' END AS interval_source, tt AS trial_type,
   coalesce(oa, CASE account {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACCOUNT_APPS.items())} END, lower(app_name), 'app_main') AS app_id, coalesce(om = 'test', false) OR coalesce(utm_source = 'test', false) OR (pv = 'provider_a' AND coalesce(coalesce(pi_, pn, u) = 'day', false)) AS is_qa
  FROM dm LEFT JOIN rk ON rk.sub = dm.sub AND rn = 1 LEFT JOIN gp ON gp.sub = dm.sub),
 st AS (SELECT si.*, at_.* EXCLUDE (sub) FROM si LEFT JOIN at_ ON at_.sub = si.sub)"""


def full_silver(spark, d):
    return staged(spark, d, "silver_table", lambda: _full_silver(spark, d))


def _full_silver(spark, d):
    events, a, b = silver(spark, d), parsed_a(spark, d), flat(spark, d)
    first = lambda c: F.min_by(c, F.struct("created", "event_id")).alias(c)
    plan = C.subscription_events(a).groupBy("subscription_id").agg(
        first("customer_id"), first("plan_interval"), first("price_id"), first("product_id"))
    trial = outcomes(spark, d).where("subscription_id is not null").groupBy("subscription_id").agg(
        F.when(F.max(F.col("event_name") == "trial_payment"), "paid").otherwise("free").alias("trial_type"))
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    subs = events.where("payment_provider = 'provider_a' and subscription_id is not null").select("subscription_id").distinct()
    seg = F.col("c_mktsegment")
    da = (subs.withColumn("_u", F.substring("subscription_id", 5, 20).cast("bigint")).join(plan, "subscription_id", "left").join(trial, "subscription_id", "left")
          .join(c, F.col("_u") == c.c_custkey, "left").select(
              "subscription_id", F.lit("provider_a").alias("payment_provider"), F.col("customer_id").alias("customer_user_id"),
              F.when(F.col("price_id").isNotNull(), F.concat(F.lit("u"), F.col("_u").cast("string"))).alias("email"), F.substring("subscription_id", 11, 10).alias("account"),
              F.when(seg == "BUILDING", " None ").when(seg == "MACHINERY", "test").otherwise(seg).alias("own_media"),
              F.concat(F.lit("camp-"), F.col("c_nationkey").cast("string")).alias("own_campaign"), F.when(F.col("c_nationkey") % 3 == 0, "App_N").alias("own_app"),
              "plan_interval", F.lit(None).cast("string").alias("plan_name"), "price_id", "product_id", F.coalesce("trial_type", F.lit("none")).alias("trial_type"),
              F.lit(None).cast("timestamp").alias("started_at")))
    none = F.lit(None).cast("string")
    g = b.where("subscription_id is not null").groupBy("subscription_id").agg(
        F.min("account_id").alias("customer_user_id"), F.min("email").alias("email"), F.min("product_name").alias("plan_name"),
        F.min("product_id").alias("product_id"), F.min("started_at").alias("started_at"), F.max("trial_cents").alias("_t"))
    db = g.select("subscription_id", F.lit("provider_b").alias("payment_provider"), "customer_user_id", F.split("email", "@")[0].alias("email"), none.alias("account"),
                  none.alias("own_media"), none.alias("own_campaign"), none.alias("own_app"), none.alias("plan_interval"), "plan_name", F.col("product_id").alias("price_id"), "product_id",
                  F.when(F.col("_t").isNotNull(), "paid").otherwise("free").alias("trial_type"), "started_at")
    gaps = C.cadence(events.where("payment_provider = 'provider_b'"), P)  # its successes are those of the orders
    att = cut(C.subscription_attributes(da.unionByName(db), events, attribution(spark, d)[1], gaps, "app_main", ACCOUNT_APPS))
    return C.silver_table(events, att)


@query("silver_table", "E17 E14 E15 E16 E13", f"""{DIMS} SELECT sub AS subscription_id, cust AS customer_user_id, pv AS payment_provider, account, app_id, name AS event_name, a AS at_us, CAST(install_date AS VARCHAR) AS install_date, country_code, geo_ambiguous, geo_status,
 media_source, media_source_step, campaign, product_id, price_id, interval_unit, interval_source, trial_type, cents / 100.0::DOUBLE AS price_amount, churn AS churn_type, coalesce(is_qa, false) AS is_qa, orphan AS refund_orphan, raw AS raw_event_type, sig AS signal_us FROM st""")
def silver_rows(spark, d):
    s = full_silver(spark, d)
    return s.select(*[c for c in C.SILVER_TABLE if c not in ("event_datetime", "install_date", "churn_signal_datetime")], F.unix_micros("event_datetime").alias("at_us"),
                    F.col("install_date").cast("string").alias("install_date"), F.unix_micros("churn_signal_datetime").alias("signal_us"))


@query("benign_duplicates", "X3 Q9", "SELECT 'evt_' || event_id AS event_id, 2::BIGINT AS copies, 1::BIGINT AS payloads, true AS benign FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0")
def benign_duplicates(spark, d):
    return C.same_payload(webhooks_a(spark, d), "pending_webhooks")


def _path(path: str, n: str, values: str, where: str = "", src: str = "x") -> str:
    hit = any(w in path for w in ("email", "country", "geo"))
    return f"SELECT '{path}' AS path, {n} AS n, count(DISTINCT {values}) AS values, {str(hit).lower()} AS interesting FROM {src} {where} HAVING count(*) > 0"


B_PATHS = " UNION ALL ".join([
    _path("subscription.id", "count(*)", "sub"), _path("subscription.status", "count(*)", "os = 'P'"),
    _path("subscription.started_at", "count(*)", "od", "WHERE c % 3 <> 0"), _path("subscription.expired_at", "count(*)", "od", "WHERE os = 'F'"),
    _path("subscription.cancel_message", "count(*)", "c % 4"), _path("customer.customer_email", "count(*)", "c"),
    _path("customer.customer_account_id", "count(*)", "c"), _path("product.name", "count(*)", "c % 5"), _path("product.product_id", "count(*)", "c % 7"),
    _path("invoices.*.orders.*.status", "2 * count(*)", "st", src="ol").replace("count(DISTINCT st)", "count(DISTINCT st) + 1"),
    _path("invoices.*.orders.*.amount", "2 * count(*)", "cents", src="ol"),
    _path("invoices.*.orders.*.processed_at", "2 * count(*)", "pr", "WHERE pr IS NOT NULL", "ol"),
    _path("invoices.*.orders.*.retry_attempt", "2 * count(*)", "retry", src="ol")])


@query("json_path_profile", "X4 X10", f"{EB}, x AS (SELECT * FROM sb JOIN (SELECT unnest([0, 1]) AS i) ON true) {B_PATHS}")
def json_path_profile(spark, d):
    leaves = C.json_leaves(webhooks_b(spark, d), ["event_id"])
    return C.path_profile(leaves, "(?i)email|country|geo").select("path", "n", "values", "interesting")


@query("json_differences", "X5", "SELECT 'pending_webhooks' AS path, count(*) AS ids FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0")
def json_differences(spark, d):
    return C.differing_paths(C.json_leaves(webhooks_a(spark, d), ["event_id"]))


@query("canonical_starts", "E24 J2 A8", """WITH cr AS (SELECT o_custkey AS sub, o_orderdate AS ts, CASE o_orderstatus WHEN 'O' THEN 'trialing' WHEN 'F' THEN 'incomplete' ELSE 'other' END AS st FROM orders WHERE o_orderpriority = '1-URGENT'),
 cv AS (SELECT o_custkey AS sub, o_orderdate AS ts FROM orders WHERE o_orderpriority = '2-HIGH'), ac AS (SELECT o_custkey AS sub, min(o_orderdate) AS a FROM orders WHERE o_orderpriority = '3-MEDIUM' GROUP BY 1),
 un AS (SELECT sub, ts, 'created_trialing' AS source FROM cr WHERE st = 'trialing' UNION ALL SELECT i.sub, cv.ts, 'incomplete_to_trialing' FROM (SELECT DISTINCT sub FROM cr WHERE st = 'incomplete') i JOIN cv USING (sub))
 SELECT sub AS subscription_id, epoch_us(arg_min(ts, (ts, source))) AS ts_us, arg_min(source, (ts, source)) AS source, epoch_us(any_value(a)) AS activated_us FROM un LEFT JOIN ac USING (sub) GROUP BY 1""")
def canonical_starts(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumnsRenamed({"o_custkey": "subscription_id", "o_orderdate": "ts"})
    st = F.when(F.col("o_orderstatus") == "O", "trialing").when(F.col("o_orderstatus") == "F", "incomplete").otherwise("other")
    c = C.canonical_starts(o.where("o_orderpriority = '1-URGENT'").withColumn("status", st), o.where("o_orderpriority = '2-HIGH'").select("subscription_id", "ts"), o.where("o_orderpriority = '3-MEDIUM'"))
    return c.select("subscription_id", F.unix_micros("ts").alias("ts_us"), "source", F.unix_micros("activated_ts").alias("activated_us"))
