"""Data-quality checks and diagnostics. Checks return rows (check_id, ok, detail); nothing is printed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import UNIT_DAYS, days_between
from tenurekit.functions.ordered import Ordered
from tenurekit.functions.ranks import percentiles as ranked
from tenurekit.operators.clean import payload_form
from tenurekit.params import Params

# Decline reasons by what can still be collected.
DECLINE_CLASS = {
    "insufficient_funds": "retryable", "try_again_later": "retryable", "card_velocity_exceeded": "retryable",
    "processing_error": "retryable", "do_not_honor": "hard_dead", "expired_card": "hard_dead",
    "stolen_card": "hard_dead", "lost_card": "hard_dead", "pickup_card": "hard_dead",
    "revocation_of_authorization": "hard_dead", "invalid_account": "hard_dead", "incorrect_number": "hard_dead",
    "transaction_not_allowed": "hard_dead", "previously_declined_do_not_retry": "hard_dead",
    "highest_risk_level": "hard_dead", "generic_decline": "ambiguous",
}
# Decline codes of the second provider by what can still be collected.
DECLINE_CODES_B = {
    "3.02": "retryable", "3.10": "hard_dead", "3.08": "retryable", "3.04": "hard_dead", "4.03": "hard_dead", "3.12": "hard_dead",
    "3.07": "hard_dead", "4.09": "hard_dead", "4.02": "hard_dead", "4.04": "hard_dead", "5.04": "retryable", "3.11": "hard_dead",
    "2.02": "hard_dead", "4.05": "hard_dead", "2.01": "hard_dead", "2.08": "hard_dead", "3.03": "retryable", "5.01": "retryable",
}
OUTCOMES = ("renewed", "recovered", "voluntary_cancel", "billing_issue", "churned")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check(df: DataFrame, name: str, violations: Column) -> DataFrame:
    """One row: number of violations counted over a whole frame."""
    n = df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))
    return n.select(F.lit(name).alias("check_id"), (F.col("violations") == 0).alias("ok"), "violations")


def matrix_preflight(mx: DataFrame) -> DataFrame:
    """Ranges, allowed outcomes and consistency of the step matrix."""
    expected = F.col("outcome").isin("renewed", "recovered").cast("bigint")
    v = {
        "first_step": F.when(F.min("step_k") != 1, 1).otherwise(0),
        "outcomes": F.count_if(~F.col("outcome").isin(*OUTCOMES)), "negative_age": F.count_if(F.col("weeks_obs") < 0),
        "billing_day": F.count_if(~F.col("billing_day_of_month").between(1, 31)), "survived": F.count_if(F.col("survived") != expected),
    }
    one = mx.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in v.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("violations")) for n in v]))
    return one.select(rows.alias("r")).select("r.check_id", (F.col("r.violations") == 0).alias("ok"), "r.violations")


def missing_overlap(mx: DataFrame, a: str, b: str, token: str = "(none)") -> DataFrame:
    """Two-by-two table of missing levers."""
    return mx.groupBy((F.col(a) == token).alias(f"no_{a}"), (F.col(b) == token).alias(f"no_{b}")).agg(F.count(F.lit(1)).alias("n"))


def silver_checks(silver: DataFrame, raw: DataFrame, counts: DataFrame, expected: Mapping[str, int], now: Column,
                  intervals: DataFrame, id_format: str, max_price_cents: int, ladder: Sequence[int], max_unknown: float) -> DataFrame:
    """The assertion suite over the silver table; the write is meant to depend on all being ok.

    raw: event_id, data. counts: table_name, n_rows. intervals: subscription_id, interval_unit,
    start_ts (unit null when unknown)."""
    exp = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    term = F.col("event_name") == "subscription_expired"
    known = F.col("subscription_id").isNotNull()
    out = [check(counts, "manifest", F.count_if(~F.coalesce(F.col("n_rows") == F.try_element_at(exp, F.col("table_name")), F.lit(False))))]
    form = F.xxhash64(payload_form(F.col("data"), "pending_webhooks"))
    copies = raw.select("event_id", form.alias("h")).groupBy("event_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    out.append(check(copies, "benign_duplicates", F.count_if(F.col("a") != F.col("b"))))
    out.append(check(silver, "id_format", F.count_if(known & ~F.col("subscription_id").rlike(id_format))))
    out.append(check(silver, "null_id_not_orphan", F.count_if(~known & ~F.col("refund_orphan"))))
    out.append(check(silver, "churn_only_on_terminals", F.count_if(~term & F.col("churn_type").isNotNull())))
    unknown = F.count_if(term & (F.col("churn_type") == "unknown")) / F.count_if(term)
    out.append(check(silver, "unknown_churn_share", F.when(unknown > max_unknown, 1).otherwise(0)))
    out.append(check(silver, "price_ceiling", F.count_if(F.col("amount_cents") > max_price_cents)))
    found = F.array_distinct(F.collect_set(F.when(F.col("amount_cents").isin(*ladder), F.col("amount_cents"))))
    out.append(check(silver, "price_ladder", F.lit(len(set(ladder))) - F.size(found)))
    per = silver.where(known).groupBy("subscription_id").agg(F.count_if(F.col("event_name") == "trial_started").alias("starts"),
                                                             F.count_if(F.col("event_name") == "subscription_renewed").alias("renewals"))
    out.append(check(per, "one_start", F.count_if(F.col("starts") != 1)))
    unit = F.create_map(*[x for k, v in UNIT_DAYS.items() for x in (F.lit(k), F.lit(v))])
    j = per.join(intervals, "subscription_id").withColumn("now", now)
    room = days_between("start_ts", "now") / F.try_element_at(unit, F.col("interval_unit")) + 2
    out.append(check(j, "possible_periods", F.count_if(F.col("renewals") > room)))
    gone = intervals.select("subscription_id").join(per.select("subscription_id"), "subscription_id", "left_anti")
    out.append(check(gone, "completeness", F.count(F.lit(1))))
    return union(out)


def table_checks(silver: DataFrame, paid: DataFrame, terminals: DataFrame, coverage: Mapping[str, float], providers: Sequence[str],
                 accounts: str, currency: str = "usd", tol: float = 0.02) -> DataFrame:
    """Assertions that need the attributes of subscriptions.

    paid: currency of each money row. terminals: churn_type, expected (of the first provider).
    coverage: least share of subscriptions with a country per provider. providers: names that are no
    media. accounts: pattern of the known accounts of the first provider."""
    first = next(iter(coverage))
    out = [check(paid, "money_currency", F.count_if(F.coalesce(F.col("currency") != currency, F.lit(True))))]
    got = silver.where((F.col("payment_provider") == first) & (F.col("event_name") == "subscription_expired")).groupBy("churn_type").agg(F.count(F.lit(1)).alias("got"))
    both = terminals.join(got, "churn_type", "left")
    out.append(check(both, "terminal_totals", F.count_if(F.abs(F.coalesce("got", F.lit(0)) - F.col("expected")) > tol * F.col("expected"))))
    subs = silver.where("subscription_id is not null").groupBy("payment_provider", "subscription_id").agg(F.max(F.col("country_code").isNotNull()).alias("known"))
    share = subs.groupBy("payment_provider").agg(F.avg(F.col("known").cast("double")).alias("share"))
    least = F.create_map(*[x for k, v in coverage.items() for x in (F.lit(k), F.lit(float(v)))])
    out.append(check(share, "geo_coverage", F.count_if(F.col("share") < F.try_element_at(least, F.col("payment_provider")))))
    media = F.col("media_source")
    out.append(check(silver, "media_rules", F.count_if(media.isin(*providers) | (media.isNotNull() & F.col("media_source_step").isNull()))))
    account = F.col("account")
    out.append(check(silver, "account_set", F.count_if((F.col("payment_provider") == first) & (account.isNull() | ~account.rlike(accounts)))))
    return union(out)


def snapshot_integrity(raw: DataFrame, snapshot: Column) -> DataFrame:
    """Empty, late or repeated rows of a pulled snapshot."""
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("ids"), F.max("created").alias("last"),
                   F.count_if(F.col("created") >= snapshot).alias("late")).withColumn("ok", (F.col("n_rows") > 0) & (F.col("late") == 0))


def duplicate_classes(raw: DataFrame) -> DataFrame:
    """Repeated ids by number of copies and how far apart the copies are."""
    g = raw.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("created").alias("times"),
                                    (F.max(F.unix_seconds("created")) - F.min(F.unix_seconds("created"))).alias("span")).where("copies > 1")
    c = F.when(F.col("times") == 1, "same time").when(F.col("span") <= 60, "within a minute").when(F.col("span") <= 86400, "within a day").otherwise("later")
    return g.groupBy("copies", c.alias("span_class")).agg(F.count(F.lit(1)).alias("ids"))


def reconcile(metrics: DataFrame, expected: Mapping[str, float], tol: float = 1e-5) -> DataFrame:
    """Named metrics against frozen values.

    metrics: metric, value."""
    exp = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))])
    out = metrics.withColumn("expected", F.try_element_at(exp, F.col("metric")))
    return out.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tol, F.lit(False)))


def reconcile_tables(metrics: DataFrame, expected: DataFrame, keys: Sequence[str] = (), rel: float = 1e-9) -> DataFrame:
    """Metrics of two computations of the same data, per key. Both tables: keys, metric, value; one row each. A metric that only one
    side has, or whose value is null on one side, is not ok; null keys are keys. The tolerance is relative, and absolute below 1."""
    by = [*keys, "metric"]
    both = metrics.select(*by, "value", F.lit(True).alias("_got")).unionByName(expected.select(*by, "value", F.lit(False).alias("_got")))
    out = both.groupBy(*by).agg(F.max(F.when(F.col("_got"), F.col("value"))).alias("value"), F.max(F.when(~F.col("_got"), F.col("value"))).alias("expected"))
    near = F.abs(F.col("value") - F.col("expected")) <= rel * F.greatest(F.lit(1.0), F.abs("expected"))
    return out.withColumn("ok", F.coalesce(near, F.lit(False)))


def source_gap(a: DataFrame, b: DataFrame, key: str, gate_pct: float = 1.5) -> DataFrame:
    """Net of two sources over the keys of the first, and the mean per payer.

    a, b: key, net."""
    pop = a.select(key).distinct()
    x = b.join(pop, key, "left_semi").agg(F.sum("net").alias("net_b"), F.count(F.lit(1)).alias("n_b"), F.avg(F.when(F.col("net") > 0, F.col("net"))).alias("payer_b"))
    y = a.agg(F.sum("net").alias("net_a"), F.count(F.lit(1)).alias("n_a"), F.avg(F.when(F.col("net") > 0, F.col("net"))).alias("payer_a"))
    j = y.withColumn("_b", x.select(F.struct("*")).scalar()).select("*", "_b.*").drop("_b")
    gap = F.try_divide(F.col("net_b") - F.col("net_a"), "net_a") * 100
    return j.withColumn("gap_pct", gap).withColumn("ok", F.abs("gap_pct") < gate_pct)


def level_totals(event_level: DataFrame, sub_level: DataFrame, tol: float) -> DataFrame:
    """Event-level and key-level totals, their gap against a tolerance, and keys below zero."""
    e = event_level.agg(F.sum(F.col("base_net_ev") + F.col("ups_net_ev")).alias("event_total"))
    s = sub_level.agg(F.sum("net_revenue").alias("sub_total"), F.count_if(F.col("net_revenue") < -1e-9).alias("negative"))
    both = e.withColumn("_s", s.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    gap = F.try_divide(F.col("event_total") - F.col("sub_total"), "sub_total")
    return both.withColumn("gap", gap).withColumn("ok", F.coalesce(F.abs("gap") <= tol, F.lit(False)))


def same_totals(tables: Mapping[str, DataFrame], by: str, value: str, tol: float = 1e-3) -> DataFrame:
    """Sums of one column by week must be equal in every breakdown of the same snapshot."""
    t = union([df.groupBy(by).agg(F.sum(value).alias("total")).withColumn("breakdown", F.lit(n)) for n, df in tables.items()])
    return t.groupBy(by).agg(F.min("total").alias("lowest"), F.max("total").alias("highest"), F.count(F.lit(1)).alias("breakdowns")).withColumn(
        "ok", F.col("highest") - F.col("lowest") <= tol)


# ------------------------------------------------------------------ profiles
def distribution(df: DataFrame, c: str) -> DataFrame:
    """Rows and share per value, the null row included."""
    g = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def crosstab(df: DataFrame, row: str, c: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column per listed value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(c) == v).alias(v) for v in values])


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled share and distinct values per column: rows are unpivoted once and counted per value first."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    per = df.select(cells.alias("c")).groupBy("c.column_name", "c.value").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value") != "", F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("values"), F.sum("n").alias("_n"))
    return g.select("column_name", "filled", "values", (F.col("filled") / F.col("_n")).alias("share"))


def keys_per_person(df: DataFrame, person: str, key: str) -> DataFrame:
    g = df.groupBy(person).agg(F.count_distinct(key).alias("keys"))
    return g.groupBy("keys").agg(F.count(F.lit(1)).alias("people"))


def identity_lift(rows: DataFrame, log: DataFrame, first: str, second: str) -> DataFrame:
    """Matches through the first key, and how many more the second key gives."""
    a = rows.join(log.select(first).where(F.col(first).isNotNull()).distinct().withColumn("_a", F.lit(True)), first, "left")
    b = a.join(log.select(second).where(F.col(second).isNotNull()).distinct().withColumn("_b", F.lit(True)), second, "left")
    one, two = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(one).alias("by_first"), F.count_if(two & ~one).alias("gained"), F.count_if(~one & ~two).alias("unmatched"))


# ------------------------------------------------------------------ declines and dunning
def last_decline(terminals: DataFrame, declines: DataFrame, p: Params, grace_days: float = 1.0) -> DataFrame:
    """Per terminal: the latest decline of its customer at or before death (plus grace) and how many
    came before. Terminals and declines share one ordered scan per customer.

    terminals: subscription_id, customer_id, death_ts. declines: customer_id, ts, reason, tie."""
    t = terminals.select("customer_id", F.timestamp_micros(F.unix_micros("death_ts") + F.lit(int(grace_days * 86_400e6))).alias("ts"),
                         F.lit(1).alias("rank"), F.col("subscription_id"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("tie"))
    d = declines.select("customer_id", "ts", F.lit(0).alias("rank"), F.lit(None).cast(terminals.schema["subscription_id"].dataType).alias("subscription_id"),
                        "reason", F.col("tie").cast("bigint"))
    u = t.unionByName(d)
    scan = Ordered(["customer_id"], "ts", ["rank", "tie", "subscription_id"])
    u = scan.add(u, last_before={"last_reason": F.col("reason")}, running_sum={"n_before": (F.col("rank") == 0).cast("bigint")})
    u = u.where("rank = 1")
    per = u.groupBy("customer_id").agg(F.count_distinct("subscription_id").alias("_s"))
    return u.join(per, "customer_id").select("subscription_id", "customer_id", "last_reason", "n_before", (F.col("_s") == 1).alias("clean_link"))


def decline_mix(df: DataFrame, c: str, classes: Mapping[str, str] = DECLINE_CLASS, default: str = "ambiguous") -> DataFrame:
    """Share of each reason with its class; an alternative mapping gives the sensitivity."""
    m = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    d = distribution(df, c)
    return d.withColumn("class", F.when(F.col("value") == "NULL", "not_linked").otherwise(F.coalesce(F.try_element_at(m, F.col("value")), F.lit(default))))


def class_split(df: DataFrame, c: str, mappings: Mapping[str, Mapping[str, str]], default: str = "ambiguous") -> DataFrame:
    """Rows and share per class of the linked reasons under each mapping: one borderline reason moved
    from class to class shows how much hangs on it. Reasons are counted once for all mappings."""
    n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for name, classes in mappings.items():
        m = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
        out.append(n.select(F.lit(name).alias("mapping"), F.coalesce(F.try_element_at(m, F.col("value")), F.lit(default)).alias("class"), "n"))
    g = union(out).groupBy("mapping", "class").agg(F.sum("n").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("mapping")))


def dunning_windows(fails: DataFrame, deaths: DataFrame, key: str = "subscription_id") -> DataFrame:
    """Per key: days from first to last failure, and from first failure to death."""
    f = fails.groupBy(key).agg(F.min("ts").alias("first_fail"), F.max("ts").alias("last_fail"), F.count(F.lit(1)).alias("n_fail"))
    d = deaths.groupBy(key).agg(F.min("death_ts").alias("death_ts"))
    return f.join(d, key, "left").select(key, "n_fail", days_between("first_fail", "last_fail").alias("window_days"),
                                         days_between("first_fail", "death_ts").alias("to_death_days"))


def percentiles(df: DataFrame, c: str, points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles of a column, its largest value and the number of values."""
    names = {f"q{i}": f"p{round(q * 100)}" for i, q in enumerate(points)}
    return ranked(df, c, points).withColumnsRenamed({**names, "top": "max"})


def histogram(df: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    """Rows per bucket [lo, hi); the last bucket is open."""
    b = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        cond = (F.col(c) >= lo) & ((F.col(c) < hi) if hi is not None else F.lit(True))
        label = f">={lo}" if hi is None else f"{lo}-{hi}"
        b = F.when(cond, label) if b is None else b.when(cond, label)
    return df.where(F.col(c).isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("bucket is not null")


def long_pauses(fails: DataFrame, pays: DataFrame, p: Params, days: float = 20.0, key: str = "subscription_id") -> DataFrame:
    """Two readings per key: a failure followed by silence; a long gap between two failures, and
    whether a payment fell inside it."""
    u = fails.select(key, "ts", "tie", F.lit("failed").alias("kind")).unionByName(pays.select(key, "ts", "tie", F.lit("paid").alias("kind")))
    u = u.join(fails.select(key).distinct(), key, "left_semi")
    failed = F.col("kind") == "failed"
    scan = Ordered([key], "ts", ["kind", "tie"])
    u = scan.add(u, prev={"_t": F.col("ts"), "_k": F.col("kind")}, last_before={"_f": F.when(failed, F.col("ts")), "_p": F.when(~failed, F.col("ts"))})
    silence = (days_between("_t", "ts") > days) & (F.col("_k") == "failed")
    gap = failed & (days_between("_f", "ts") > days)
    inside = gap & (F.col("_p") > F.col("_f")) & (F.col("_p") < F.col("ts"))
    no = F.lit(False)
    return u.groupBy(key).agg(F.max(F.coalesce(silence, no)).alias("pause"), F.max(F.coalesce(gap, no)).alias("fail_gap"), F.max(F.coalesce(inside, no)).alias("paid_inside"))


def resurrections(pays: DataFrame, units: DataFrame, p: Params, slack_days: float = 14.0, key: str = "subscription_id") -> DataFrame:
    """Gaps between payments longer than one interval plus slack.

    units: key, interval_unit."""
    scan = Ordered([key], "ts", ["tie"])
    g = scan.add(pays.select(key, "ts", "tie"), prev={"_p": F.col("ts")}).withColumn("gap", days_between("_p", "ts"))
    unit = F.create_map(*[x for k, v in UNIT_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return g.join(units, key).where(F.col("gap") > F.try_element_at(unit, F.col("interval_unit")) + slack_days).select(key, "interval_unit", "gap")


def late_success(pays: DataFrame, fails: DataFrame, p: Params, days: float = 20.0, key: str = "subscription_id") -> DataFrame:
    """Keys with a payment long after the failure before it, with the first such gap."""
    u = pays.select(key, "ts", "tie", F.lit(1).alias("paid")).unionByName(fails.select(key, "ts", "tie", F.lit(2).alias("paid")))
    scan = Ordered([key], "ts", ["paid", "tie"])
    u = scan.add(u, last_before={"_f": F.when(F.col("paid") == 2, F.col("ts"))})
    late = u.where((F.col("paid") == 1) & (days_between("_f", "ts") > days))
    return late.groupBy(key).agg(F.min_by(days_between("_f", "ts"), F.struct("ts", "tie")).alias("gap_days"))


def life_after_death(deaths: DataFrame, pays: DataFrame, fails: DataFrame, grace_days: float = 1.0, key: str = "subscription_id") -> DataFrame:
    """Dead keys that paid later, and whether that payment settled an attempt begun before death
    (same invoice as an earlier failure).

    pays, fails: key, invoice_id, ts."""
    d = deaths.groupBy(key).agg(F.min("death_ts").alias("death_ts"))
    after = pays.join(d, key).where(days_between("death_ts", "ts") > grace_days)
    before = fails.join(d, key).where(F.col("ts") <= F.col("death_ts")).select(key, "invoice_id").distinct().withColumn("_lag", F.lit(True))
    a = after.join(before, [key, "invoice_id"], "left").groupBy(key).agg(
        F.min(days_between("death_ts", "ts")).alias("first_after_days"), F.max(F.coalesce("_lag", F.lit(False))).alias("settle_lag"))
    return d.select(key).join(a, key, "left").select(key, F.col("first_after_days").isNotNull().alias("paid_after"), "first_after_days",
                                                     F.coalesce("settle_lag", F.lit(False)).alias("settle_lag"))


# ------------------------------------------------------------------ grain study
def payment_gaps(pays: DataFrame, keys: Sequence[str], p: Params) -> DataFrame:
    """Days between consecutive payments of a key."""
    scan = Ordered(list(keys), "ts", ["tie"])
    return scan.add(pays.select(*keys, "ts", "tie", "amount"), prev={"_p": F.col("ts")}).withColumn("gap", days_between("_p", "ts"))


def parallel_people(spans: DataFrame, p: Params, person: str = "email") -> DataFrame:
    """People with subscriptions that overlap in time: a start not after the latest end so far. One
    ordered scan, no pairs.

    spans: person, key, start_ts, end_ts."""
    s = spans.withColumn("ts", F.col("start_ts"))
    scan = Ordered([person], "ts", ["key"])
    s = scan.add(s, running_min={"_m": -F.unix_micros("end_ts")})
    s = scan.add(s, prev={"_e": F.col("_m")})
    over = F.coalesce(F.unix_micros("start_ts") <= -F.col("_e"), F.lit(False))
    return s.groupBy(person).agg(F.count(F.lit(1)).alias("subscriptions"), F.count_if(over).alias("overlapping"))


def dropped_money(pays: DataFrame, keys: Sequence[str], p: Params) -> DataFrame:
    """Payments, and their money, that the dedup rule would drop at a grain."""
    g = payment_gaps(pays, keys, p).withColumn("dropped", F.coalesce(F.col("gap") <= p.dedup_days, F.lit(False)))
    return g.agg(F.count_if("dropped").alias("n_dropped"), F.sum(F.when(F.col("dropped"), F.col("amount")).otherwise(0.0)).alias("money"),
                 F.count(F.lit(1)).alias("n"))
