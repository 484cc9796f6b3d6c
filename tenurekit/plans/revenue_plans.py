"""Revenue and population on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import epoch, r6
from tenurekit.operators import population as N
from tenurekit.operators import revenue as R
from tenurekit.params import ORDERS_WEB as P
from tenurekit.plans import sql as Q
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged
from tenurekit.sources.adapters import refund_events, table, web_events

PRICE = 20000.0
HC = 1.0 - P.haircut

PAIDSQL = f"""paid AS (SELECT *, CASE WHEN event_name = 'trial_converted' THEN 0.0::DOUBLE ELSE least(price_amount, {PRICE}::DOUBLE) END AS base_amt
  FROM re WHERE event_name IN ('trial_converted', 'subscription_renewed')),
 refd AS (SELECT subscription_id, price_amount, CAST(event_datetime AS DATE) AS ev_date, min(event_datetime) AS event_datetime, arg_min(tie, (event_datetime, tie)) AS tie
  FROM re WHERE event_name = 'subscription_refunded' GROUP BY 1, 2, 3)"""
REF = f"WITH {Q.RE}, {PAIDSQL}"


def loaded(grain: str = "person") -> str:
    sess = "lower(email)" if grain == "person" else "lower(email) || '|' || subscription_key"
    return f"""lo0 AS (SELECT * REPLACE (lower(email) AS email, CASE WHEN amt_net < 0 THEN 0 ELSE amt_net END AS amt_net), {sess} AS session_id,
   CASE WHEN event_type = 'trial_started' THEN CASE WHEN amt IS NULL OR round(amt, 2) <= 0 THEN 'free' WHEN round(amt, 2) = {P.trial_placeholder}::DOUBLE THEN 'placeholder' ELSE 'real' END END AS trial_kind FROM we),
 pb AS (SELECT DISTINCT email FROM lo0 WHERE (event_type = 'trial_started' AND round(amt, 2) = {P.product_b_trial}::DOUBLE)
   OR (event_type = 'subscription_started' AND round(amt, 2) >= {P.product_b_base_min}::DOUBLE)),
 lo AS (SELECT * FROM lo0 WHERE email NOT IN (SELECT email FROM pb)),
 mo AS (SELECT * FROM lo WHERE event_type IN ('subscription_started', 'upsale_converted', 'trial_started')
   AND NOT (event_type = 'trial_started' AND trial_kind IN ('placeholder', 'free')))"""


DIM = """CASE WHEN {c} IS NULL OR lower(trim(url_decode(replace({c}, '+', '%2B')))) IN ('', 'unknown', 'none', 'null', '{{', 'nan', '{c}')
  OR (starts_with({c}, '{{') AND ends_with({c}, '}}')) THEN '(missing)' ELSE trim(url_decode(replace({c}, '+', '%2B'))) END AS {c}"""


def first_sql(c: str) -> str:
    return f"arg_min({c}, (ts, tie)) FILTER ({c} IS NOT NULL)"


POPSQL = f"""en AS (SELECT session_id, min(ts) AS first_date, {first_sql('email')} AS email, {first_sql('funnel_name')} AS funnel_name, {first_sql('country')} AS country,
   {first_sql('utm_source')} AS utm, {first_sql('campaign_name')} AS campaign_name, {first_sql('ad_name')} AS ad_name
  FROM lo WHERE event_type IN ('trial_started', 'subscription_started') GROUP BY 1),
 pop0 AS (SELECT session_id, email, first_date, coalesce(nullif(funnel_name, ''), 'unknown') AS first_funnel, coalesce(nullif(country, ''), '(none)') AS geo,
   coalesce(nullif(utm, ''), '(missing)') AS utm_source, {DIM.format(c='campaign_name')}, {DIM.format(c='ad_name')},
   greatest(CAST(floor({Q.whole('first_date', '(SELECT max(ts) FROM lo)')} / {P.period_days}) AS BIGINT), 0) AS age_weeks_now,
   CAST(date_trunc('quarter', first_date) AS DATE) AS cohort_date FROM en)"""
REVSQL = f"""rv AS (SELECT email, session_id, {', '.join(f"sum(CASE WHEN event_type = '{t}' THEN coalesce(amt_net, 0) ELSE 0 END) * {HC!r} AS {n}_net" for n, t in (('trial', R.TRIAL), ('base', R.BASE), ('ups', R.UPSELL)))}
  FROM mo GROUP BY 1, 2),
 pop AS (SELECT p.*, coalesce(trial_net, 0) AS trial_net, coalesce(base_net, 0) AS base_net, coalesce(ups_net, 0) AS ups_net,
   coalesce(trial_net + base_net + ups_net, 0) AS total_net, coalesce(ups_net > 0, false) AS has_ups, coalesce(trial_net > 0, false) AS has_paid_trial,
   coalesce(base_net > 0, false) AS has_base, coalesce(trial_net + base_net + ups_net > 0, false) AS paid_anything
  FROM pop0 p LEFT JOIN rv USING (session_id))"""
WEB = f"WITH {Q.WE}, {loaded()}"
POP = f"{WEB}, {POPSQL}, {REVSQL}"


def web_log(spark, d, grain="person"):
    raw = staged(spark, d, "web_log", lambda: web_events(spark, d))
    return staged(spark, d, f"web_events_{grain}", lambda: R.load_events(raw, P, grain))


def web_pop(spark, d):
    ev = web_log(spark, d)
    return staged(spark, d, "web_population", lambda: N.attach_revenue(
        N.build_population(ev, P, cohort_unit="quarter"), R.revenue_by_key(ev, P)))


@query("base_upsell_split", "R1", f"{REF} SELECT event_name, count(*) AS n, round(sum(base_amt), 2) AS base, round(sum(price_amount - base_amt), 2) AS ups FROM paid GROUP BY 1")
def base_upsell_split(spark, d):
    return R.paid_events(refund_events(spark, d), PRICE).groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("base_amt"), 2).alias("base"), F.round(F.sum("ups_amt"), 2).alias("ups"))


@query("refund_dedup", "R2 U2", f"{REF} SELECT subscription_id, round(price_amount, 4) AS price_amount, ev_date, tie FROM refd")
def refund_dedup(spark, d):
    return R.dedup_refunds(refund_events(spark, d)).select("subscription_id", F.round("price_amount", 4).alias("price_amount"), "ev_date", "tie")


@query("net_by_subscription", "R3 J1", f"""{REF}, a AS (SELECT subscription_id, sum(base_amt) AS b, sum(price_amount - base_amt) AS u, sum(price_amount) AS t FROM paid GROUP BY 1),
 r AS (SELECT subscription_id, sum(price_amount) AS rt FROM refd GROUP BY 1),
 s AS (SELECT a.*, coalesce(rt, 0) AS rt, least(coalesce(rt, 0), t) AS rc, CASE WHEN t > 0 THEN b / t ELSE 0 END AS sh FROM a LEFT JOIN r USING (subscription_id))
 SELECT subscription_id, round(b, 3) AS base_payments, round(u, 3) AS ups_payments, round(t, 3) AS total_payments, subscription_id AS customer_user_id,
  round(rt, 3) AS refund_total, round(rc, 3) AS refund_capped, round(greatest(b - rc * sh, 0), 4) AS base_net, round(greatest(u - rc * (1 - sh), 0), 4) AS ups_net,
  round(greatest(b - rc * sh, 0) + greatest(u - rc * (1 - sh), 0), 3) AS net_revenue FROM s""")
def net_by_subscription(spark, d):
    s = R.net_by_subscription(refund_events(spark, d), PRICE)
    r2 = ("base_payments", "ups_payments", "total_payments", "refund_total", "refund_capped", "net_revenue")
    return s.select("subscription_id", "customer_user_id", *[F.round(c, 3).alias(c) for c in r2],
                    *[F.round(c, 4).alias(c) for c in ("base_net", "ups_net")])


RUNNING = f"""WITH RECURSIVE {Q.RE}, {PAIDSQL}, u AS (
  SELECT subscription_id, event_datetime, tie, 0 AS rk, base_amt AS b, price_amount - base_amt AS p, price_amount AS amt FROM paid
  UNION ALL SELECT subscription_id, event_datetime, tie, 1, 0, 0, price_amount FROM refd),
 o AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY event_datetime, rk, tie, amt) AS rn FROM u),
 f AS (SELECT subscription_id, tie, rk, rn, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wu, CASE WHEN rk = 0 THEN b ELSE 0 END::DOUBLE AS nb, CASE WHEN rk = 0 THEN p ELSE 0 END::DOUBLE AS nu FROM o WHERE rn = 1
  UNION ALL SELECT o.subscription_id, o.tie, o.rk, o.rn, f.nb, f.nu,
   CASE WHEN o.rk = 0 THEN f.nb + o.b WHEN f.nb + f.nu > 0 THEN f.nb - least(o.amt, f.nb + f.nu) * (f.nb / (f.nb + f.nu)) ELSE f.nb END,
   CASE WHEN o.rk = 0 THEN f.nu + o.p WHEN f.nb + f.nu > 0 THEN f.nu - least(o.amt, f.nb + f.nu) * (1 - f.nb / (f.nb + f.nu)) ELSE f.nu END
  FROM f JOIN o ON o.subscription_id = f.subscription_id AND o.rn = f.rn + 1)"""


@query("running_refund_cap", "R4 W12 W5", f"""{RUNNING}
 SELECT subscription_id, tie, CASE WHEN rk = 0 THEN 'pay' ELSE 'refund' END AS kind, round(nb - wb, 3) + 0 AS base_net_ev, round(nu - wu, 3) + 0 AS ups_net_ev FROM f""")
def running_refund_cap(spark, d):
    e = R.net_events(refund_events(spark, d), PRICE, P)
    return e.select("subscription_id", "tie", "kind", (F.round("base_net_ev", 3) + 0.0).alias("base_net_ev"),
                    (F.round("ups_net_ev", 3) + 0.0).alias("ups_net_ev"))


@query("signed_revenue", "R5", f"WITH {Q.RE} SELECT subscription_id, count(*) AS n, round(sum(CASE WHEN event_name = 'subscription_refunded' THEN -price_amount ELSE price_amount END), 3) AS revenue FROM re GROUP BY 1")
def signed_revenue(spark, d):
    return R.signed_events(refund_events(spark, d)).groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 3).alias("revenue"))


@query("refund_rate", "R11", f"""WITH {Q.RE} SELECT round(sum(price_amount) FILTER (event_name <> 'subscription_refunded'), 3) AS gross,
 round(sum(price_amount) FILTER (event_name = 'subscription_refunded'), 3) AS refunds,
 round(sum(price_amount) FILTER (event_name = 'subscription_refunded') / sum(price_amount) FILTER (event_name <> 'subscription_refunded'), 6) AS rate FROM re""")
def refund_rate(spark, d):
    return R.refund_rate(refund_events(spark, d)).select(F.round("gross", 3).alias("gross"), F.round("refunds", 3).alias("refunds"), r6("rate").alias("rate"))


@query("trial_classes", "E19", f"WITH {Q.WE}, {loaded()} SELECT trial_kind, count(*) AS n, round(sum(amt), 2) AS gross FROM lo0 WHERE event_type = 'trial_started' GROUP BY 1")
def trial_classes(spark, d):
    e = R.load_events(web_events(spark, d), P, exclude=False).where("event_type = 'trial_started'")
    return e.groupBy("trial_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("gross"))


@query("product_scope", "E20 F10", f"{WEB} SELECT email FROM pb")
def product_scope(spark, d):
    return R.out_of_scope(R.load_events(web_events(spark, d), P, exclude=False), P)


@query("loaded_events", "E21 X7 F6", f"{WEB} SELECT session_id, event_type, epoch_us(ts) AS ts_us, tie, round(amt, 2) AS amt, round(amt_net, 6) AS amt_net, trial_kind FROM lo")
def loaded_events(spark, d):
    return web_log(spark, d).select("session_id", "event_type", epoch("ts").alias("ts_us"), "tie", F.round("amt", 2).alias("amt"), r6("amt_net").alias("amt_net"), "trial_kind")


@query("session_grain", "E18", f"""WITH {Q.WE}, {loaded('subscription')} SELECT email, count(DISTINCT session_id) AS sessions, count(*) AS n FROM lo GROUP BY 1""")
def session_grain(spark, d):
    return web_log(spark, d, "subscription").groupBy("email").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"))


@query("net_coverage", "R9", f"""{WEB} SELECT payment_provider, round(sum(amt), 2) AS gross, round(coalesce(sum(amt) FILTER (amt_net IS NULL), 0), 2) AS lost, count(*) FILTER (amt_net IS NULL) AS n_lost,
  CAST(min(ts) FILTER (amt_net IS NULL) AS DATE) AS lost_from, CAST(max(ts) FILTER (amt_net IS NULL) AS DATE) AS lost_to,
  round(coalesce(sum(amt) FILTER (amt_net IS NULL), 0) / sum(amt), 6) AS share, coalesce(sum(amt) FILTER (amt_net IS NULL), 0) / sum(amt) <= 0.005 AS ok
 FROM lo WHERE event_type IN ('subscription_started', 'upsale_converted', 'trial_started') AND amt > 0 GROUP BY 1""")
def net_coverage(spark, d):
    c = R.net_coverage(web_log(spark, d), P, ["payment_provider"])
    return c.withColumns({"gross": F.round("gross", 2), "lost": F.round("lost", 2), "share": r6("share")})


@query("money_events", "R6", f"{WEB} SELECT event_type, trial_kind, count(*) AS n, round(sum(amt_net), 3) AS net FROM mo GROUP BY 1, 2")
def money_events(spark, d):
    return R.money_events(web_log(spark, d)).groupBy("event_type", "trial_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt_net"), 3).alias("net"))


@query("revenue_by_key", "R7 A3", f"""{WEB}, {POPSQL}, {REVSQL} SELECT email, session_id, round(trial_net, 6) AS trial_net, round(base_net, 6) AS base_net, round(ups_net, 6) AS ups_net,
 round(trial_net + base_net + ups_net, 6) AS total_net, trial_net + base_net + ups_net > 0 AS is_payer, ups_net > 0 AS has_ups, trial_net > 0 AS has_paid_trial FROM rv""")
def revenue_by_key(spark, d):
    r = R.revenue_by_key(web_log(spark, d), P)
    return r.withColumns({c: r6(c) for c in ("trial_net", "base_net", "ups_net", "total_net")})


@query("revenue_as_of", "R7", f"""{WEB} SELECT session_id, round(sum(CASE WHEN event_type = 'subscription_started' THEN coalesce(amt_net, 0) ELSE 0 END) * {HC!r}, 6) AS base_net
 FROM mo WHERE ts <= TIMESTAMP '1998-01-01' GROUP BY 1""")
def revenue_as_of(spark, d):
    return R.revenue_by_key(web_log(spark, d), P, F.lit("1998-01-01").cast("timestamp")).select("session_id", r6("base_net").alias("base_net"))


@query("cumulative_by_week", "R8 W5 J9 X12 A12", f"""{POP}, wk AS (SELECT session_id, greatest(CAST(floor({Q.whole('first_date', 'ts')} / {P.period_days}) AS BIGINT), 0) AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net
   FROM mo JOIN pop0 USING (session_id) GROUP BY 1, 2)
 SELECT session_id, g.week, round(sum(coalesce(net, 0)) OVER (PARTITION BY session_id ORDER BY g.week), 4) AS cum
 FROM pop0 JOIN (SELECT unnest(range(0, 13))::BIGINT AS week) g ON true LEFT JOIN wk USING (session_id, week)""")
def cumulative_by_week(spark, d):
    ev = web_log(spark, d)
    pop = N.build_population(ev, P, cohort_unit="quarter")
    return R.cumulative_by_week(ev, pop, P, 12).withColumn("cum", F.round("cum", 4))


@query("person_rollup", "R10 J10", f"""{REF}, cus AS (SELECT c_custkey AS customer_user_id, lower(CASE WHEN c_nationkey % 2 = 0 THEN 'A' || c_custkey ELSE 'S' || c_nationkey END) AS email FROM customer),
 a AS (SELECT subscription_id, sum(base_amt) AS b, sum(price_amount - base_amt) AS u, sum(price_amount) AS t FROM paid GROUP BY 1),
 r AS (SELECT subscription_id, sum(price_amount) AS rt FROM refd GROUP BY 1),
 s AS (SELECT a.*, least(coalesce(rt, 0), t) AS rc, CASE WHEN t > 0 THEN b / t ELSE 0 END AS sh FROM a LEFT JOIN r USING (subscription_id))
 SELECT m.email, round(coalesce(sum(greatest(b - rc * sh, 0) + greatest(u - rc * (1 - sh), 0)), 0), 3) AS total
 FROM (SELECT DISTINCT email FROM cus) m LEFT JOIN cus USING (email) LEFT JOIN s ON s.subscription_id = cus.customer_user_id GROUP BY 1""")
def person_rollup(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    key, even = F.col("c_custkey"), F.col("c_nationkey") % 2 == 0
    shared = F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))
    ids = N.identity_map(c.where(even).select(key.alias("customer_user_id"), F.concat(F.lit("A"), key.cast("string")).alias("email")),
                         c.select(key.alias("customer_user_id"), shared.alias("email")))
    net = R.net_by_subscription(refund_events(spark, d), PRICE)
    return R.person_rollup(net, ids, ids.select("email").distinct()).withColumn("total", F.round("total", 3))


@query("population", "P1 P2 X8 X11 F5 A8", f"{WEB}, {POPSQL} SELECT session_id, email, epoch_us(first_date) AS first_us, first_funnel, geo, utm_source, campaign_name, ad_name, age_weeks_now, cohort_date FROM pop0")
def population(spark, d):
    return N.build_population(web_log(spark, d), P, cohort_unit="quarter").select(
        "session_id", "email", epoch("first_date").alias("first_us"), "first_funnel", "geo", "utm_source", "campaign_name", "ad_name", "age_weeks_now", "cohort_date")


@query("population_window", "P1 P2", f"{WEB}, {POPSQL} SELECT session_id, CAST(date_trunc('week', first_date) AS DATE) AS cohort_date, age_weeks_now FROM pop0 WHERE first_date >= TIMESTAMP '1995-06-01'")
def population_window(spark, d):
    return N.build_population(web_log(spark, d), P, "1995-06-01").select("session_id", "cohort_date", "age_weeks_now")


@query("population_revenue", "P3 J1", f"{POP} SELECT session_id, round(base_net, 6) AS base_net, round(total_net, 6) AS total_net, has_ups, has_paid_trial, has_base, paid_anything FROM pop")
def population_revenue(spark, d):
    return web_pop(spark, d).select("session_id", r6("base_net").alias("base_net"), r6("total_net").alias("total_net"), "has_ups", "has_paid_trial", "has_base", "paid_anything")


@query("denominators", "P4", f"{POP} SELECT cohort_date, count(*) AS n_attributed, count(*) FILTER (total_net > 0) AS n_payers FROM pop GROUP BY 1")
def denominators(spark, d):
    return N.denominators(web_pop(spark, d), ["cohort_date"])


@query("maturity_report", "P5", f"{POP} SELECT a AS min_age, count(*) AS n_before, count(*) FILTER (age_weeks_now >= a) AS n_after FROM pop JOIN (SELECT unnest([1, 3, 18])::BIGINT AS a) g ON true GROUP BY 1")
def maturity_report(spark, d):
    return N.maturity_report(N.build_population(web_log(spark, d), P), (1, 3, 18))


FUNNELS = ("FURNITURE", "MACHINERY")


@query("funnel_report", "F11 P21", f"""WITH {Q.WE}, f AS (SELECT email, arg_min(funnel_name, (ts, tie)) FILTER (funnel_name IS NOT NULL) AS x FROM we GROUP BY 1)
 SELECT CASE WHEN x IN {FUNNELS} THEN 'whitelist' WHEN x IS NULL OR lower(trim(x)) IN ('', 'unknown', 'none') THEN 'organic' ELSE 'other' END AS funnel_class, count(*) AS n,
  funnel_class <> 'other' AS kept FROM f GROUP BY 1""")
def funnel_report(spark, d):
    from tenurekit.operators.ladder import first_values
    return N.funnel_report(first_values(web_events(spark, d), "email", ["funnel_name"]), "funnel_name", FUNNELS)
