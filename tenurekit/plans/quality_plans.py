"""Checks and diagnostics on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.operators import calibrate
from tenurekit.operators import clean as C
from tenurekit.operators import ltv as V
from tenurekit.operators import quality as Z
from tenurekit.operators import revenue as R
from tenurekit.params import MOBILE, ORDERS_WEB
from tenurekit.plans import sql as Q
from tenurekit.plans.clean_plans import DIMS, EB, OUTB, SILV, deduped_a, flat, full_silver, nested, silver, webhooks_a
from tenurekit.plans.cohort_plans import FITSQL, facts, pooled, ref_hazard
from tenurekit.plans.ladder_plans import OMX, orders_mx
from tenurekit.plans.ltv_plans import CURVES, curve_sql, web, web_state
from tenurekit.plans.registry import query
from tenurekit.plans.revenue_plans import PRICE, RUNNING
from tenurekit.sources import io
from tenurekit.sources.adapters import refund_events, sub_events, table, web_events


@query("matrix_preflight", "Q4 Q1", f"""{OMX} SELECT check_id, violations = 0 AS ok, violations::BIGINT AS violations FROM (SELECT 'first_step' AS check_id, CASE WHEN min(step_k) <> 1 THEN 1 ELSE 0 END AS violations FROM mx UNION ALL
 SELECT 'outcomes', count(*) FILTER (outcome NOT IN ('renewed', 'recovered', 'voluntary_cancel', 'billing_issue', 'churned')) FROM mx UNION ALL SELECT 'negative_age', count(*) FILTER (weeks_obs < 0) FROM mx UNION ALL
 SELECT 'billing_day', count(*) FILTER (billing_day_of_month NOT BETWEEN 1 AND 31) FROM mx UNION ALL SELECT 'survived', count(*) FILTER (survived <> (outcome IN ('renewed', 'recovered'))::INT) FROM mx)""")
def matrix_preflight(spark, d):
    return Z.matrix_preflight(orders_mx(spark, d))


@query("missing_overlap", "Q4 A11", f"WITH {Q.SE}, f AS (SELECT coalesce(nullif(geo, ''), '(none)') AS geo, coalesce(media_source, '(none)') AS ms FROM se) SELECT geo = '(none)' AS no_geo, ms = '(none)' AS no_media_source, count(*) AS n FROM f GROUP BY 1, 2")
def missing_overlap(spark, d):
    e = sub_events(spark, d).withColumns({"geo": F.coalesce(F.nullif("geo", F.lit("")), F.lit("(none)")), "media_source": F.coalesce("media_source", F.lit("(none)"))})
    return Z.missing_overlap(e, "geo", "media_source")


@query("silver_checks", "Q2 Q1", f"""{DIMS}, ck AS (SELECT 'id_format' AS check_id, count(*) FILTER (sub IS NOT NULL AND NOT regexp_matches(sub, '^(sub|sb)_[0-9]+$')) AS v FROM si UNION ALL SELECT 'null_id_not_orphan', count(*) FILTER (sub IS NULL AND NOT orphan) FROM si
  UNION ALL SELECT 'churn_only_on_terminals', count(*) FILTER (name <> 'subscription_expired' AND churn IS NOT NULL) FROM si UNION ALL SELECT 'unknown_churn_share', CASE WHEN count(*) FILTER (name = 'subscription_expired' AND churn = 'unknown') / count(*) FILTER (name = 'subscription_expired') > 0.05 THEN 1 ELSE 0 END FROM si
  UNION ALL SELECT 'price_ceiling', count(*) FILTER (cents > 8000000) FROM si UNION ALL SELECT 'price_ladder', 3 - count(DISTINCT cents) FILTER (cents IN (999, 99, 3999)) FROM si UNION ALL SELECT 'one_start', count(*) FILTER (n <> 1) FROM (SELECT sub, count(*) FILTER (name = 'trial_started') AS n FROM si WHERE sub IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 'possible_periods', count(*) FILTER (rn > {Q.days('f', "TIMESTAMP '2024-02-01'")} / u + 2) FROM (SELECT si.sub, count(*) FILTER (name = 'subscription_renewed') AS rn, any_value(f) AS f, any_value(u) AS u FROM si JOIN (SELECT sub, min(od) AS f, CASE any_value(c) % 5 WHEN 0 THEN 7 WHEN 1 THEN 30 WHEN 2 THEN 365 WHEN 3 THEN 1 END AS u FROM sb GROUP BY 1) USING (sub) GROUP BY 1)
  UNION ALL SELECT 'completeness', count(*) FILTER (sub NOT IN (SELECT sub FROM si WHERE sub IS NOT NULL)) FROM (SELECT DISTINCT sub FROM sb)
  UNION ALL SELECT 'manifest', ((SELECT count(*) FROM region) <> 5)::INT + ((SELECT count(*) FROM nation) <> 25)::INT
  UNION ALL SELECT 'benign_duplicates', 0
  UNION ALL SELECT 'money_currency', count(*) FILTER (k % 19 = 0) FROM ea WHERE t = 'purchase'
  UNION ALL SELECT 'terminal_totals', count(*) FILTER (abs(got - want) > 0.02 * want) FROM (SELECT churn, count(*) AS got FROM si WHERE pv = 'provider_a' AND name = 'subscription_expired' GROUP BY 1) JOIN (SELECT CASE k % 3 WHEN 0 THEN 'voluntary' WHEN 1 THEN 'involuntary' END AS churn, count(*) AS want FROM ea WHERE t = 'view' AND k % 3 < 2 GROUP BY 1) USING (churn)
  UNION ALL SELECT 'geo_coverage', count(*) FILTER (share < CASE pv WHEN 'provider_a' THEN 0.55 ELSE 0.2 END) FROM (SELECT pv, avg(known::INT) AS share FROM (SELECT pv, sub, bool_or(country_code IS NOT NULL) AS known FROM st WHERE sub IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
  UNION ALL SELECT 'media_rules', count(*) FILTER (media_source IN ('provider_a', 'm2') OR (media_source IS NOT NULL AND media_source_step IS NULL)) FROM st
  UNION ALL SELECT 'account_set', count(*) FILTER (pv = 'provider_a' AND (account IS NULL OR NOT regexp_matches(account, '^0000'))) FROM st) SELECT check_id, v = 0 AS ok, v::BIGINT AS violations FROM ck""")
def silver_checks(spark, d):
    from tenurekit.functions.exprs import interval_word
    s = full_silver(spark, d).withColumn("amount_cents", F.round(F.col("price_amount") * 100).cast("bigint"))
    iv = flat(spark, d).groupBy("subscription_id").agg(F.min("product_name").alias("pn"), F.min("created").alias("start_ts")).select("subscription_id", interval_word("pn").alias("interval_unit"), "start_ts")
    counts = io.manifest({t: table(spark, d, t) for t in ("region", "nation")})
    a = deduped_a(spark, d)
    paid = C.invoice_rows(a).where("event_type = 'invoice.paid'").select("currency")
    reason = F.col("reason")
    want = C.subscription_events(a).where("event_type = 'customer.subscription.deleted'").groupBy(
        F.when(reason == "cancellation_requested", "voluntary").when(reason == "payment_failed", "involuntary").alias("churn_type")).agg(
        F.count(F.lit(1)).alias("expected")).where("churn_type is not null")
    more = Z.table_checks(s, paid, want, {"provider_a": 0.55, "provider_b": 0.2}, ("provider_a", "m2"), "^0000")
    return Z.silver_checks(s, webhooks_a(spark, d), counts, {"region": 5, "nation": 25}, F.lit("2024-02-01").cast("timestamp"), iv,
                           "^(sub|sb)_[0-9]+$", 8_000_000, (99, 999, 3999), 0.05).unionByName(more)


@query("snapshot_integrity", "Q3", "SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM events WHERE event_type = 'purchase') + (SELECT count(*) FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0) AS n_rows, (SELECT count(*) FROM events) + (SELECT count(*) FROM events WHERE event_type = 'purchase') AS ids, 0::BIGINT AS late, true AS ok")
def snapshot_integrity(spark, d):
    return Z.snapshot_integrity(webhooks_a(spark, d), F.lit("2024-03-01").cast("timestamp")).drop("last")


@query("duplicate_classes", "Q9 A9", """WITH raw AS (SELECT 'evt_' || event_id AS id, ts FROM events UNION ALL SELECT 'evl_' || event_id, ts FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'evt_' || event_id, ts + INTERVAL 60 SECOND FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0),
 g AS (SELECT id, count(*) AS copies, count(DISTINCT ts) AS times, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS span FROM raw GROUP BY 1 HAVING count(*) > 1)
 SELECT copies, CASE WHEN times = 1 THEN 'same time' WHEN span <= 60 THEN 'within a minute' WHEN span <= 86400 THEN 'within a day' ELSE 'later' END AS span_class, count(*) AS ids FROM g GROUP BY 1, 2""")
def duplicate_classes(spark, d):
    return Z.duplicate_classes(webhooks_a(spark, d))


# Frozen values of the model at sf0.01; the anchor is revenue per payer of the first cohort at its third rebill.
EXPECT = {"alpha": -3.21234626354062, "beta": 0.451756564187839, "k_max": 11.0, "anchor": 25709.84 / 267}


@query("reconciliation_gate", "Q5 Q8", f"""{FITSQL}, mt AS (SELECT 'alpha' AS metric, alpha AS value, {EXPECT['alpha']}::DOUBLE AS expected FROM ft UNION ALL SELECT 'beta', beta, {EXPECT['beta']} FROM ft UNION ALL SELECT 'k_max', k_max, 11 FROM ft
 UNION ALL SELECT 'anchor', arg_min(cumr / payers, cohort), {EXPECT['anchor']!r} FROM ad WHERE rebill_number = 3) SELECT metric, round(value, 6) AS value, round(expected, 6) AS expected, coalesce(abs(value - expected) <= 1e-5, false) AS ok FROM mt""")
def reconciliation_gate(spark, d):
    fit = calibrate.log_linear_fit(pooled(spark, d), ref_hazard(spark, d))
    m = [fit.select(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in ("alpha", "beta", "k_max")]
    f = facts(spark, d).where("rebill_number = 3")
    m.append(f.agg(F.lit("anchor").alias("metric"), F.min_by("payer_ltv", "cohort").alias("value")))
    return Z.reconcile(Z.union(m), EXPECT).withColumns({"value": r6("value"), "expected": r6("expected")})


@query("source_gap", "Q6 J8", f"""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS net FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, sum(l_extendedprice) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1),
 y AS (SELECT sum(net) AS na, count(*) AS n_a, avg(net) FILTER (net > 0) AS pa FROM a), x AS (SELECT sum(net) AS nb, count(*) AS n_b, avg(net) FILTER (net > 0) AS pb FROM b WHERE k IN (SELECT k FROM a))
 SELECT round(na, 2) AS net_a, n_a, round(pa, 3) AS payer_a, round(nb, 2) AS net_b, n_b, round(pb, 3) AS payer_b, round((nb - na) / na * 100, 6) AS gap_pct, abs((nb - na) / na * 100) < 1.5 AS ok FROM x, y""")
def source_gap(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'")
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice")
    a = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("net"))
    b = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("l_extendedprice").alias("net"))
    g = Z.source_gap(a, b, "k")
    return g.withColumns({"net_a": F.round("net_a", 2), "net_b": F.round("net_b", 2), "payer_a": F.round("payer_a", 3), "payer_b": F.round("payer_b", 3), "gap_pct": r6("gap_pct")})


TOTALS_TOL = 0.05


@query("level_totals", "Q7", f"""{RUNNING}, a AS (SELECT subscription_id, sum(base_amt) AS b, sum(price_amount - base_amt) AS u, sum(price_amount) AS t FROM paid GROUP BY 1),
 r AS (SELECT subscription_id, sum(price_amount) AS rt FROM refd GROUP BY 1), s AS (SELECT greatest(t - coalesce(rt, 0), 0) AS net FROM a LEFT JOIN r USING (subscription_id)),
 ev AS (SELECT sum(nb - wb + nu - wu) AS event_total FROM f), su AS (SELECT sum(net) AS sub_total, count(*) FILTER (net < -1e-9) AS negative FROM s)
 SELECT round(event_total, 1) AS event_total, round(sub_total, 1) AS sub_total, round((event_total - sub_total) / sub_total, 6) AS gap, abs(event_total - sub_total) <= {TOTALS_TOL} * sub_total AS ok, negative FROM ev, su""")
def level_totals(spark, d):
    """A causal cap forgives refunds that come before the money, so the event total is the larger one; the gap has a tolerance."""
    e = refund_events(spark, d)
    t = Z.level_totals(R.net_events(e, PRICE, ORDERS_WEB), R.net_by_subscription(e, PRICE), TOTALS_TOL)
    return t.select(F.round("event_total", 1).alias("event_total"), F.round("sub_total", 1).alias("sub_total"), r6("gap").alias("gap"), "ok", "negative")


def same_totals_sql() -> str:
    each = " UNION ALL ".join(f"SELECT * FROM ({curve_sql(d)} SELECT '{n}' AS breakdown, week, sum(rebills_base) AS total FROM wc GROUP BY 2)" for n, d in CURVES.items())
    return (f"SELECT week, round(min(total), 2) AS lowest, round(max(total), 2) AS highest, count(*) AS breakdowns, max(total) - min(total) <= 1e-3 AS ok FROM ({each}) GROUP BY 1")


@query("same_week_totals", "Q8", same_totals_sql())
def same_week_totals(spark, d):
    """Every week in every breakdown; modelled weeks differ, since each breakdown fits its own cells."""
    w = web(spark, d)
    st = web_state(spark, d, w)
    t = {n: V.weekly_curve(w, st, ORDERS_WEB, dims) for n, dims in CURVES.items()}
    return Z.same_totals(t, "week", "rebills_base").select("week", F.round("lowest", 2).alias("lowest"), F.round("highest", 2).alias("highest"), "breakdowns", "ok")


@query("churn_distribution", "Q10 A10", f"{SILV} SELECT coalesce(churn, 'NULL') AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM si GROUP BY 1")
def churn_distribution(spark, d):
    return Z.distribution(silver(spark, d), "churn_type").withColumn("share", r6("share"))


NAMES = ("trial_started", "trial_converted", "subscription_renewed", "subscription_expired", "billing_issue_detected")


@query("event_crosstab", "Q10 A11", f"{SILV} SELECT pv AS payment_provider, {', '.join(f'count(*) FILTER (name = {n!r}) AS {n}' for n in NAMES)} FROM si GROUP BY 1")
def event_crosstab(spark, d):
    return Z.crosstab(silver(spark, d), "payment_provider", "event_name", NAMES)


REASONS = ("insufficient_funds", "do_not_honor", "generic_decline", "expired_card", "odd_reason")
DECL = f"""WITH dc AS (SELECT user_id AS cu, ts, event_id AS tie, CASE k % 5 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS))} END AS reason FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error'),
 tm AS (SELECT CASE WHEN user_id % 3 = 0 THEN event_id ELSE user_id END AS sid, user_id AS cu, max(ts) AS dt FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 ll AS (SELECT sid, tm.cu, arg_max(reason, (ts, tie)) AS last_reason, count(ts) AS n_before FROM tm LEFT JOIN dc ON dc.cu = tm.cu AND ts <= dt + INTERVAL 1 DAY GROUP BY 1, 2),
 cl AS (SELECT *, count(*) OVER (PARTITION BY cu) = 1 AS clean_link FROM ll)"""


def declines(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    dc = e.where("event_type = 'error'").select(F.col("user_id").alias("customer_id"), "ts", F.col("event_id").alias("tie"),
                                                F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("k") % 5 + 1).cast("int")).alias("reason"))
    sid = F.when(F.col("user_id") % 3 == 0, F.col("event_id")).otherwise(F.col("user_id"))
    tm = e.where("event_type = 'view'").groupBy(sid.alias("subscription_id"), F.col("user_id").alias("customer_id")).agg(F.max("ts").alias("death_ts"))
    return tm, dc


@query("last_decline", "Q11 J4", f"{DECL} SELECT sid AS subscription_id, cu AS customer_id, last_reason, n_before, clean_link FROM cl")
def last_decline(spark, d):
    return Z.last_decline(*declines(spark, d), MOBILE)


@query("decline_mix", "Q11 F9 A10", f"""{DECL} SELECT coalesce(last_reason, 'NULL') AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
 CASE coalesce(last_reason, 'NULL') WHEN 'NULL' THEN 'not_linked' WHEN 'insufficient_funds' THEN 'retryable' WHEN 'do_not_honor' THEN 'hard_dead' WHEN 'expired_card' THEN 'hard_dead' ELSE 'ambiguous' END AS class FROM cl WHERE clean_link GROUP BY 1""")
def decline_mix(spark, d):
    m = Z.decline_mix(Z.last_decline(*declines(spark, d), MOBILE).where("clean_link"), "last_reason")
    return m.withColumn("share", r6("share"))


CODES_B = (*Z.DECLINE_CODES_B, "9.99")


def split_sql(src: str, column: str, provider: str, moved: str, classes: dict) -> str:
    """Class split under the base mapping and with one reason moved to retryable."""
    out = []
    for name, m in (("base", classes), (f"{moved} retryable", {**classes, moved: "retryable"})):
        case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items())
        out.append(f"SELECT '{provider}' AS provider, '{name}' AS mapping, CASE {column} {case} ELSE 'ambiguous' END AS class, count(*) AS n FROM {src} WHERE {column} IS NOT NULL GROUP BY 3")
    return " UNION ALL ".join(out)


@query("decline_classes", "Q11 F9 A10", f"""{DECL}, cb AS (SELECT u, arg_max(code, (ts, tie)) AS code FROM (SELECT user_id AS u, ts, event_id AS tie, [{', '.join(repr(c) for c in CODES_B)}][CAST(json_extract(props, '$.k') AS BIGINT) % {len(CODES_B)} + 1] AS code FROM events WHERE event_type = 'error') GROUP BY 1),
 al AS ({split_sql('(SELECT last_reason FROM cl WHERE clean_link)', 'last_reason', 'provider_a', 'do_not_honor', Z.DECLINE_CLASS)} UNION ALL {split_sql('cb', 'code', 'provider_b', '3.10', Z.DECLINE_CODES_B)})
 SELECT provider, mapping, class, n, round(n / sum(n) OVER (PARTITION BY provider, mapping), 6) AS share FROM al""")
def decline_classes(spark, d):
    """What could still be collected, with the one reason moved on which the answer hangs."""
    tm, dc = declines(spark, d)
    a = Z.class_split(Z.last_decline(tm, dc, MOBILE).where("clean_link"), "last_reason", {
        "base": Z.DECLINE_CLASS, "do_not_honor retryable": {**Z.DECLINE_CLASS, "do_not_honor": "retryable"}})
    e = table(spark, d, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("bigint")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES_B]), (k % len(CODES_B) + 1).cast("int"))
    last = e.groupBy("user_id").agg(F.max_by(code, F.struct("ts", "event_id")).alias("code"))
    b = Z.class_split(last, "code", {"base": Z.DECLINE_CODES_B, "3.10 retryable": {**Z.DECLINE_CODES_B, "3.10": "retryable"}})
    both = a.withColumn("provider", F.lit("provider_a")).unionByName(b.withColumn("provider", F.lit("provider_b")))
    return both.select("provider", "mapping", "class", "n", r6("share").alias("share"))


SEF = f"WITH {Q.SE}, fa AS (SELECT sub_id, ts, tie FROM se WHERE kind = 'issue'), pa AS (SELECT sub_id, ts, tie FROM se WHERE kind = 'pay'), de AS (SELECT sub_id, min(ts) AS dt FROM se WHERE kind = 'vol' GROUP BY 1)"


def parts(spark, d):
    e = sub_events(spark, d).withColumnRenamed("sub_id", "subscription_id")
    return (e.where("kind = 'issue'").select("subscription_id", "ts", "tie"), e.where("kind = 'pay'").select("subscription_id", "ts", "tie", "amount"),
            e.where("kind = 'vol'").select("subscription_id", F.col("ts").alias("death_ts")))


DW = f"{SEF}, dw AS (SELECT f.sub_id, count(*) AS n_fail, {Q.days('min(ts)', 'max(ts)')} AS w, {Q.days('min(ts)', 'any_value(dt)')} AS td FROM fa f LEFT JOIN de USING (sub_id) GROUP BY 1)"


@query("dunning_windows", "Q12 A1", f"{DW} SELECT sub_id AS subscription_id, n_fail, round(w, 6) AS window_days, round(td, 6) AS to_death_days FROM dw")
def dunning_windows(spark, d):
    f, _, x = parts(spark, d)
    return Z.dunning_windows(f, x).withColumns({"window_days": r6("window_days"), "to_death_days": r6("to_death_days")})


@query("dunning_percentiles", "Q12 A4", f"{DW} SELECT round(quantile_cont(w, 0.5), 6) AS p50, round(quantile_cont(w, 0.95), 6) AS p95, round(quantile_cont(w, 0.99), 6) AS p99, round(max(w), 6) AS max, count(w) AS n FROM dw")
def dunning_percentiles(spark, d):
    f, _, x = parts(spark, d)
    return Z.percentiles(Z.dunning_windows(f, x), "window_days").withColumns({c: r6(c) for c in ("p50", "p95", "p99", "max")})


@query("dunning_histogram", "Q12 A14", f"{DW} SELECT CASE WHEN w >= 0 AND w < 4 THEN '0-4' WHEN w < 15 THEN '4-15' WHEN w < 27 THEN '15-27' ELSE '>=27' END AS bucket, count(*) AS n FROM dw GROUP BY 1")
def dunning_histogram(spark, d):
    f, _, x = parts(spark, d)
    return Z.histogram(Z.dunning_windows(f, x), "window_days", (0, 4, 15, 27))


@query("long_pauses", "Q13 U1 J3", f"""{SEF}, u AS (SELECT sub_id, ts, tie, 'failed' AS kind FROM fa UNION ALL SELECT sub_id, ts, tie, 'paid' FROM pa WHERE sub_id IN (SELECT sub_id FROM fa)),
 g AS (SELECT *, lag(ts) OVER w AS pt, lag(kind) OVER w AS pk FROM u WINDOW w AS (PARTITION BY sub_id ORDER BY ts, kind, tie)), f1 AS (SELECT sub_id, ts, lag(ts) OVER (PARTITION BY sub_id ORDER BY ts, tie) AS pf FROM fa),
 f2 AS (SELECT sub_id, bool_or({Q.days('pf', 'ts')} > 5) AS fail_gap, bool_or({Q.days('pf', 'ts')} > 5 AND EXISTS (SELECT 1 FROM pa WHERE pa.sub_id = f1.sub_id AND pa.ts > pf AND pa.ts < f1.ts)) AS paid_inside FROM f1 GROUP BY 1)
 SELECT sub_id AS subscription_id, coalesce(bool_or({Q.days('pt', 'ts')} > 5 AND pk = 'failed'), false) AS pause, coalesce(any_value(fail_gap), false) AS fail_gap, coalesce(any_value(paid_inside), false) AS paid_inside FROM g JOIN f2 USING (sub_id) GROUP BY 1""")
def long_pauses(spark, d):
    f, p, _ = parts(spark, d)
    return Z.long_pauses(f, p, MOBILE, 5.0)


@query("resurrections", "Q14 W2 F9", f"""{EB}, {OUTB}, g AS (SELECT sub, {Q.days('lag(tm) OVER (PARTITION BY sub ORDER BY tm, order_id)', 'tm')} AS gap FROM o2 WHERE name IN ('trial_converted', 'subscription_renewed')),
 un AS (SELECT sub, CASE any_value(c) % 5 WHEN 0 THEN 'week' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'day' END AS u FROM sb GROUP BY 1)
 SELECT sub AS subscription_id, u AS interval_unit, round(gap, 6) AS gap FROM g JOIN un USING (sub) WHERE gap > CASE u WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 WHEN 'day' THEN 1 END + 14""")
def resurrections(spark, d):
    from tenurekit.functions.exprs import interval_word
    b = flat(spark, d)
    ev = C.order_outcomes(nested(spark, d), MOBILE, stored=True).where("event_name in ('trial_converted', 'subscription_renewed')").select("subscription_id", F.col("event_datetime").alias("ts"), F.col("order_id").alias("tie"))
    u = b.groupBy("subscription_id").agg(F.min("product_name").alias("pn")).select("subscription_id", interval_word("pn").alias("interval_unit"))
    return Z.resurrections(ev, u, MOBILE).withColumn("gap", r6("gap"))


@query("late_success", "Q15 J4", f"""{SEF}, l1 AS (SELECT p.sub_id, p.ts, p.tie, max(f.ts) AS lf FROM pa p JOIN fa f ON f.sub_id = p.sub_id AND f.ts < p.ts GROUP BY 1, 2, 3)
 SELECT sub_id AS subscription_id, round(arg_min({Q.days('lf', 'ts')}, (ts, tie)), 6) AS gap_days FROM l1 WHERE {Q.days('lf', 'ts')} > 3 GROUP BY 1""")
def late_success(spark, d):
    f, p, _ = parts(spark, d)
    return Z.late_success(p, f, MOBILE, 3.0).withColumn("gap_days", r6("gap_days"))


LAD = f"""{EB}, dd AS (SELECT sub, min(od + INTERVAL 1 DAY) AS dt FROM sb WHERE kind IN ('expire', 'cancel') GROUP BY 1), pf AS (SELECT DISTINCT ol.sub, inv FROM ol JOIN dd USING (sub) WHERE st = 'auth_failed' AND pr <= dt),
 af AS (SELECT ol.sub, min({Q.days('dt', 'pr')}) AS fd, bool_or(pf.inv IS NOT NULL) AS lag FROM ol JOIN dd USING (sub) LEFT JOIN pf ON pf.sub = ol.sub AND pf.inv = ol.inv WHERE st = 'settle_ok' AND {Q.days('dt', 'pr')} > 1 GROUP BY 1)"""


@query("life_after_death", "Q15 J8", f"{LAD} SELECT sub AS subscription_id, fd IS NOT NULL AS paid_after, round(fd, 6) AS first_after_days, coalesce(lag, false) AS settle_lag FROM dd LEFT JOIN af USING (sub)")
def life_after_death(spark, d):
    o = nested(spark, d).where("processed_at is not null").withColumnRenamed("processed_at", "ts")
    dead = flat(spark, d).where("event_type in ('expire', 'cancel')").select("subscription_id", F.col("created").alias("death_ts"))
    out = Z.life_after_death(dead, o.where("status = 'settle_ok'"), o.where("status = 'auth_failed'"))
    return out.withColumn("first_after_days", r6("first_after_days"))


FILL = ("country", "utm_source", "funnel_name", "campaign_name")


@query("fill_rates", "Q16", f"WITH {Q.WE} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(nullif({c}, '')) AS filled, count(DISTINCT {c}) AS values, round(count(nullif({c}, '')) / count(*), 6) AS share FROM we" for c in FILL))
def fill_rates(spark, d):
    return Z.fill_rates(web_events(spark, d), FILL).withColumn("share", r6("share"))


@query("keys_per_person", "Q16 A2", f"WITH {Q.WE} SELECT k AS keys, count(*) AS people FROM (SELECT email, count(DISTINCT subscription_key) AS k FROM we GROUP BY 1) GROUP BY 1")
def keys_per_person(spark, d):
    return Z.keys_per_person(web_events(spark, d), "email", "subscription_key")


@query("identity_lift", "Q17", """WITH rw AS (SELECT c_custkey AS a, c_nationkey AS b FROM customer), lg AS (SELECT o_custkey AS a, NULL::INTEGER AS b FROM orders UNION ALL SELECT NULL, s_nationkey FROM supplier)
 SELECT count(*) AS n_rows, count(*) FILTER (x) AS by_first, count(*) FILTER (y AND NOT x) AS gained, count(*) FILTER (NOT x AND NOT y) AS unmatched FROM (SELECT a IN (SELECT a FROM lg WHERE a IS NOT NULL) AS x, b IN (SELECT b FROM lg WHERE b IS NOT NULL) AS y FROM rw)""")
def identity_lift(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"))
    o = table(spark, d, "orders", "o_custkey").select(F.col("o_custkey").alias("a"))
    s = table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("b"))
    return Z.identity_lift(rows, o.unionByName(s, allowMissingColumns=True), "a", "b")


def web_pays(spark, d):
    e = web_events(spark, d).where("event_type = 'subscription_started'")
    return e.select(F.lower("email").alias("email"), "subscription_key", "ts", "tie", F.col("amt").alias("amount"))


GR = f"WITH {Q.WE}, py AS (SELECT lower(email) AS email, subscription_key AS sk, ts, tie, amt FROM we WHERE event_type = 'subscription_started')"


@query("grain_gaps", "Q18 A4", f"""{GR}, g AS (SELECT 'person' AS grain, {Q.days('lag(ts) OVER (PARTITION BY email ORDER BY ts, tie)', 'ts')} AS gap FROM py UNION ALL SELECT 'subscription', {Q.days('lag(ts) OVER (PARTITION BY email, sk ORDER BY ts, tie)', 'ts')} FROM py)
 SELECT grain, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.95), 6) AS p95, round(max(gap), 6) AS max, count(gap) AS n FROM g GROUP BY 1""")
def grain_gaps(spark, d):
    p = web_pays(spark, d)
    out = [Z.percentiles(Z.payment_gaps(p, k, ORDERS_WEB), "gap", (0.5, 0.95)).withColumn("grain", F.lit(n)) for n, k in (("person", ["email"]), ("subscription", ["email", "subscription_key"]))]
    return Z.union(out).withColumns({c: r6(c) for c in ("p50", "p95", "max")})


@query("parallel_subscriptions", "Q18", f"""{GR}, sp AS (SELECT email, sk, min(ts) AS s, max(ts) AS e FROM py GROUP BY 1, 2) SELECT a.email, count(*) AS subscriptions,
 count(*) FILTER (EXISTS (SELECT 1 FROM sp b WHERE b.email = a.email AND (b.s < a.s OR (b.s = a.s AND b.sk < a.sk)) AND b.e >= a.s)) AS overlapping FROM sp a GROUP BY 1""")
def parallel_subscriptions(spark, d):
    s = web_pays(spark, d).groupBy("email", F.col("subscription_key").alias("key")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return Z.parallel_people(s, ORDERS_WEB)


@query("grain_dropped_money", "Q18", f"""{GR}, g AS (SELECT 'person' AS grain, amt, {Q.days('lag(ts) OVER (PARTITION BY email ORDER BY ts, tie)', 'ts')} AS gap FROM py UNION ALL SELECT 'subscription', amt, {Q.days('lag(ts) OVER (PARTITION BY email, sk ORDER BY ts, tie)', 'ts')} FROM py)
 SELECT grain, count(*) FILTER (gap <= 30) AS n_dropped, round(coalesce(sum(amt) FILTER (gap <= 30), 0), 2) AS money, count(*) AS n FROM g GROUP BY 1""")
def grain_dropped_money(spark, d):
    p = web_pays(spark, d)
    out = [Z.dropped_money(p, k, ORDERS_WEB).withColumn("grain", F.lit(n)) for n, k in (("person", ["email"]), ("subscription", ["email", "subscription_key"]))]
    return Z.union(out).withColumn("money", F.round("money", 2))
