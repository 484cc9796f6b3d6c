"""Plain SQL building blocks for the oracle side. Each function returns WITH-clause members."""

from __future__ import annotations

from tenurekit.params import Params

DAY = "86400000000::DOUBLE"


def days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / {DAY})"


def whole(a: str, b: str) -> str:
    return f"CAST(floor({days(a, b)}) AS BIGINT)"


def bins(c: str) -> str:
    return (f"CASE WHEN {c} > 0 AND {c} <= 10 THEN 'd01_10' WHEN {c} > 10 AND {c} <= 20 THEN 'd11_20' "
            f"WHEN {c} > 20 AND {c} <= 31 THEN 'd21_31' END")


OE = """oe AS (
 SELECT o_custkey AS sub_id, o_orderdate AS ts, 'pay' AS kind, 'subscription_renewed' AS event_name,
        o_totalprice AS amount, o_orderkey AS tie, c_mktsegment AS app_id, n_name AS geo, o_orderpriority AS media_source
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL
 SELECT o_custkey, l_shipdate, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'issue' WHEN 'AF' THEN 'vol' ELSE 'other' END,
        CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'billing_issue_detected' WHEN 'AF' THEN 'subscription_cancelled' ELSE 'shipment' END,
        NULL, l_orderkey * 10 + l_linenumber, NULL, NULL, NULL
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SE = """se AS (
 SELECT user_id AS sub_id, ts,
  CASE event_type WHEN 'purchase' THEN 'pay' WHEN 'error' THEN 'issue' WHEN 'view' THEN 'vol' ELSE 'other' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'subscription_renewed' WHEN 'error' THEN 'billing_issue_detected'
   WHEN 'view' THEN 'subscription_cancelled' WHEN 'signup' THEN 'trial_started' ELSE 'upsale_converted' END AS event_name,
  value AS amount, event_id AS tie, 'app' || (user_id % 5) AS app_id,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '' ELSE 'g' || (k % 7) END AS geo,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'm' || (k % 3) END AS media_source
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

WE = """we AS (
 SELECT *, CASE WHEN amt >= 0.2 THEN amt * 0.957 - 0.057 END AS amt_net FROM (
 SELECT 'U' || o_custkey || '@Mail' AS email, o_orderstatus AS subscription_key, o_orderdate AS ts,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'trial_started' ELSE 'subscription_started' END AS event_type,
  floor(o_totalprice / 100.0::DOUBLE) / 100.0::DOUBLE AS amt, o_orderkey AS tie,
  CASE WHEN o_orderstatus = 'F' THEN 'provider_a' ELSE 'provider_b' END AS payment_provider,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS funnel_name,
  CASE WHEN c_nationkey = 24 THEN NULL ELSE n_name END AS country,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS utm_source,
  CASE c_nationkey % 5 WHEN 0 THEN '{campaign_name}' WHEN 1 THEN 'Camp%3A' || c_mktsegment
   ELSE 'Camp:' || c_mktsegment END AS campaign_name,
  CASE WHEN o_orderstatus = 'P' THEN 'ad_name' ELSE 'ad+' || o_orderstatus END AS ad_name
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL
 SELECT 'U' || o_custkey || '@Mail', 'F', l_shipdate,
  CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'billing_issue' WHEN 'AF' THEN 'sub_cancelled' WHEN 'NF' THEN 'upsale_converted' ELSE 'other' END,
  CASE WHEN l_returnflag || l_linestatus = 'NF' THEN floor(l_extendedprice / 100.0::DOUBLE) / 100.0::DOUBLE END,
  l_orderkey * 10 + l_linenumber, 'provider_a', NULL, NULL, NULL, NULL, NULL
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""

RE = """re AS (
 SELECT o_custkey AS subscription_id, o_custkey AS customer_user_id, l_shipdate AS event_datetime,
  CASE WHEN l_returnflag = 'R' THEN 'subscription_refunded' WHEN l_linestatus = 'F' THEN 'trial_converted'
   ELSE 'subscription_renewed' END AS event_name,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.5::DOUBLE ELSE l_extendedprice END AS price_amount,
  l_orderkey * 10 + l_linenumber AS tie
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def steps(src: str, p: Params, key: str = "sub_id", extra: str = "") -> str:
    """Kept payments with flags: members pay, kept, fl, st."""
    return f"""
 pay AS (SELECT {key}, ts, tie{extra}, lag(ts) OVER (PARTITION BY {key} ORDER BY ts, tie) AS pv FROM {src} WHERE kind = 'pay'),
 kept AS (SELECT {key}, ts, tie{extra}, row_number() OVER w AS step_k, lead(ts) OVER w AS next_ts,
   min(ts) OVER (PARTITION BY {key}) AS first_pay
  FROM pay WHERE pv IS NULL OR {days('pv', 'ts')} > {p.dedup_days} WINDOW w AS (PARTITION BY {key} ORDER BY ts, tie)),
 fl AS (SELECT k.{key}, k.step_k, bool_or(e.kind = 'issue') AS hi, bool_or(e.kind = 'vol') AS hv
  FROM kept k JOIN {src} e ON e.{key} = k.{key} AND e.kind IN ('issue', 'vol') AND e.ts > k.ts
   AND (k.next_ts IS NULL OR e.ts <= k.next_ts) GROUP BY 1, 2),
 st AS (SELECT k.*, coalesce(hi, false) AS had_issue, coalesce(hv, false) AS had_vol,
   {days('k.ts', 'k.next_ts')} AS days_to_next
  FROM kept k LEFT JOIN fl ON fl.{key} = k.{key} AND fl.step_k = k.step_k)"""


def outcome(p: Params) -> str:
    return (f"CASE WHEN next_ts IS NOT NULL AND days_to_next <= {p.return_days} AND (had_issue OR days_to_next > {p.late_days}) "
            f"THEN 'recovered' WHEN next_ts IS NOT NULL AND days_to_next <= {p.return_days} THEN 'renewed' "
            "WHEN had_vol THEN 'voluntary_cancel' WHEN had_issue THEN 'billing_issue' ELSE 'churned' END")


def interval(key: str = "sub_id") -> str:
    """Member pi: plan interval per key from st."""
    return f""" pi AS (SELECT {key}, g AS median_gap, CASE WHEN g BETWEEN 5 AND 10 THEN 'week' WHEN g BETWEEN 25 AND 35 THEN 'month'
   WHEN g >= 350 THEN 'year' ELSE 'unknown' END AS plan_interval
  FROM (SELECT {key}, median(days_to_next) AS g FROM st WHERE days_to_next <= 60 GROUP BY 1))"""


def mobile_mx(src: str, p: Params) -> str:
    return steps(src, p) + f""",
{interval()},
 lev AS (SELECT sub_id, arg_min(app_id, (ts, tie)) FILTER (app_id IS NOT NULL) AS app_id,
   coalesce(nullif(arg_min(geo, (ts, tie)) FILTER (geo IS NOT NULL), ''), '(none)') AS geo,
   coalesce(nullif(arg_min(media_source, (ts, tie)) FILTER (media_source IS NOT NULL), ''), '(none)') AS media_source,
   min(ts) AS first_ts,
   {whole("min(ts) FILTER (event_name = 'trial_started')", "min(ts) FILTER (event_name = 'subscription_renewed')")} AS trial_days
  FROM {src} GROUP BY 1),
 mx AS (SELECT st.sub_id, step_k, 'active' AS state_from, {outcome(p)} AS outcome,
   {days('first_ts', f'(SELECT max(ts) FROM {src})')} / {p.period_days} AS weeks_obs, st.ts AS pay_ts, days_to_next,
   app_id, geo, media_source, '(none)' AS attribution_source, coalesce(plan_interval, 'unknown') AS plan_interval,
   trial_days, strftime(first_ts, '%Y-%m') AS cohort_month, day(st.ts) AS billing_day_of_month, tie,
   day(first_pay) AS first_billing_day,
   CASE WHEN outcome IN ('renewed', 'recovered') THEN 1 ELSE 0 END AS survived,
   CASE WHEN outcome IN ('renewed', 'recovered') THEN 0 ELSE 1 END AS died
  FROM st JOIN lev ON lev.sub_id = st.sub_id LEFT JOIN pi ON pi.sub_id = st.sub_id)"""


def hbase(mx: str, p: Params, name: str = "hb", by: str = "") -> str:
    """Member `name`: step_k, h, votes."""
    return f""" {name} AS (SELECT {by}step_k, 1 - median(surv / n) AS h, count(*) AS votes FROM (
   SELECT {by}app_id, step_k, sum(survived)::DOUBLE AS surv, count(*) AS n FROM {mx} WHERE weeks_obs >= step_k AND step_k <= {p.hmax}
   GROUP BY ALL HAVING count(*) >= {p.min_risk}) GROUP BY ALL)"""


def levered(mx: str, p: Params, name: str = "lv") -> str:
    """Member `name`: the matrix with lever columns filled."""
    cols = [f"coalesce(nullif({c}, ''), '(none)') AS {c}" for c in p.levers if c != "billday_bin"]
    ex = ", ".join(c for c in p.levers if c != "billday_bin")
    return (f" {name} AS (SELECT * EXCLUDE ({ex}), {', '.join(cols)}, {bins('billing_day_of_month')} AS billday_bin, "
            f"{bins('first_billing_day')} AS billday_first FROM {mx})")


def multipliers(lv: str, hb: str, p: Params, name: str = "mu", crash: str | None = None,
                levers=None, by: str = "") -> str:
    """Members for the residual chain on rows; `name` has lever, raw, cat, mult, n."""
    levers = list(levers if levers is not None else p.levers)
    part = by
    anti = f" AND app_id NOT IN (SELECT app_id FROM {crash})" if crash else ""
    using = f"USING ({by}step_k)"
    out = [f""" {name}_0 AS (SELECT l.*, h.h AS e0 FROM {lv} l LEFT JOIN {hb} h {using}
   WHERE step_k <= {p.clean_step_max} AND weeks_obs >= step_k{anti})"""]
    prev, sel = f"{name}_0", []
    for i, c in enumerate(levers, 1):
        out.append(f""" {name}_{i}c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {part}{c}) < {p.min_rows}
   THEN 'other' ELSE {c} END AS c{i} FROM {prev}),
 {name}_{i}g AS (SELECT {part}c{i}, least(greatest(avg(died) / avg(e{i - 1}), {p.clip[0]}), {p.clip[1]}) AS m{i}
   FROM {name}_{i}c GROUP BY ALL),
 {name}_{i} AS (SELECT a.*, g.m{i}, a.e{i - 1} * coalesce(g.m{i}, 1) AS e{i}
   FROM {name}_{i}c a LEFT JOIN {name}_{i}g g USING ({part}c{i}))""")
        prev = f"{name}_{i}"
        sel.append(f"SELECT {part}'{c}' AS lever, {c} AS raw, c{i} AS cat, any_value(m{i}) AS mult, count(*) AS n FROM {{last}} GROUP BY ALL")
    out.append(f" {name} AS (" + " UNION ALL ".join(s.format(last=prev) for s in sel) + ")")
    return ",\n".join(out)


def first_levers(lv: str, p: Params, by: str, name: str = "fl1") -> str:
    """Member `name`: levers of each key's first step, with group columns."""
    cols = ", ".join(("arg_min(billday_first, step_k) AS billday_bin" if c == "billday_bin" else f"arg_min({c}, step_k) AS {c}")
                     for c in p.levers)
    return f" {name} AS (SELECT {by}, sub_id, {cols} FROM {lv} GROUP BY {by}, sub_id)"


def personal(src: str, mu: str, p: Params, name: str, mby: str = "", levers=None) -> str:
    """Member `name`: rows of src with `mult`."""
    levers = list(levers if levers is not None else p.levers)
    joins, prod = "", []
    for i, c in enumerate(levers):
        extra = "".join(f" AND t{i}.{b.strip()} = s.{b.strip()}" for b in mby.split(",") if b.strip())
        joins += f" LEFT JOIN {mu} t{i} ON t{i}.lever = '{c}' AND t{i}.raw = s.{c}{extra}"
        prod.append(f"coalesce(t{i}.mult, 1)")
    expr = " * ".join(prod) or "1"
    return f" {name} AS (SELECT s.*, least(greatest({expr}, {p.clip[0]}), {p.clip[1]}) AS mult FROM {src} s{joins})"


def ratio(lv: str, per: str, hb: str, p: Params, by: str, name: str = "hr", weeks=None, hby: str = "") -> str:
    """Member `name`: shrunk ratio by group from per-key multipliers `per`."""
    wk = f" JOIN (SELECT unnest([{', '.join(map(str, weeks))}])::BIGINT AS weeks) ww ON l.step_k <= ww.weeks" if weeks else ""
    byw = by + (", weeks" if weeks else "")
    lo, hi = p.hazard_clip
    olo, ohi = p.oe_clip
    return f""" {name}_s AS (SELECT {', '.join('l.' + b.strip() for b in by.split(','))}{', weeks' if weeks else ''}, l.step_k,
   count(*) AS n, avg(l.died) AS o, avg(least(greatest(h.h * q.mult, {lo}), {hi})) AS e
  FROM {lv} l JOIN {per} q ON {' AND '.join(f'q.{b.strip()} = l.{b.strip()}' for b in by.split(','))} AND q.sub_id = l.sub_id
  LEFT JOIN {hb} h ON h.step_k = l.step_k{''.join(f' AND h.{b} = l.{b}' for b in hby.split())}{wk} WHERE l.weeks_obs >= l.step_k + 1 GROUP BY ALL),
 {name} AS (SELECT {byw}, sum(n) AS n_seen, exp(coalesce(sum(n * ln(least(greatest(o / e, {olo}), {ohi}))) FILTER (n >= {p.hr_min_n} AND e > 0)
   / sum(n) FILTER (n >= {p.hr_min_n} AND e > 0), 0) * sum(n) / (sum(n) + {p.k_shrink})) AS hr FROM {name}_s GROUP BY ALL)"""


def curve(mix: str, hb: str, p: Params, by: str, name: str = "cv", length: int | None = None, hby: str = "") -> str:
    """Member `name`: by, k, s from combos (by, w, mult, hr) by running products."""
    n = length or p.hmax
    lo, hi = p.hazard_clip
    return f""" {name}_i AS (SELECT *, row_number() OVER () AS rid FROM {mix}),
 {name}_s AS (SELECT i.*, k, product(1 - least(greatest(h.h * i.mult * i.hr, {lo}), {hi})) OVER (PARTITION BY rid ORDER BY k) AS s1,
   count(h.h) OVER (PARTITION BY rid ORDER BY k) AS nn
  FROM {name}_i i JOIN (SELECT unnest(range(1, {n + 1}))::BIGINT AS k) g ON true LEFT JOIN {hb} h ON h.step_k = g.k{''.join(f' AND h.{b} = i.{b}' for b in hby.split())}),
 {name} AS (SELECT {by}, k, CASE WHEN min(nn - k) = 0 THEN sum(w * s1) / sum(w) END AS s FROM {name}_s GROUP BY ALL)"""


def survival(mx: str, p: Params, by: str = "app_id", name: str = "ds", offset: float = 0.0) -> str:
    return f""" {name}_p AS (SELECT {by}, sub_id, max(step_k) AS ms, max(weeks_obs) AS wo FROM {mx} GROUP BY ALL),
 {name} AS (SELECT {by}, k, count(*) AS mature, sum(CASE WHEN ms >= k + 1 THEN 1 ELSE 0 END)::BIGINT AS alive,
   avg(CASE WHEN ms >= k + 1 THEN 1.0::DOUBLE ELSE 0 END) AS fact
  FROM {name}_p JOIN (SELECT unnest(range(1, {p.hmax + 1}))::BIGINT AS k) g ON wo >= k + {offset} GROUP BY ALL)"""


def crash(mx: str, p: Params, name: str = "cr") -> str:
    return f""" {name}_p AS (SELECT app_id, sub_id, max(step_k) AS ms, max(weeks_obs) AS wo FROM {mx} GROUP BY ALL),
 {name}_k AS (SELECT app_id, k, count(*) AS at_risk, avg(CASE WHEN ms >= k THEN 1.0::DOUBLE ELSE 0 END) AS r
  FROM {name}_p JOIN (SELECT unnest(range(2, {p.hmax + 1}))::BIGINT AS k) g ON wo >= k AND ms >= k - 1 GROUP BY ALL),
 {name}_a AS (SELECT app_id, least(1.0, coalesce(min(r) FILTER (at_risk >= {p.crash_min_risk}), 1.0)) AS worst,
   count(DISTINCT sub_id) AS payers FROM {name}_p LEFT JOIN {name}_k USING (app_id) GROUP BY 1),
 {name} AS (SELECT app_id, payers, worst, worst < {p.crash_floor} AS crash FROM {name}_a WHERE payers >= {p.min_payers})"""
