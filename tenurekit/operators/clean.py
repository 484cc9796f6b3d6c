"""From raw webhooks of two billing providers to one table of lifecycle events.

Raw rows: event_id, event_type, created (timestamp), data (JSON text). Each payload is parsed once
with a declared schema. Ordered logic per subscription runs through `Ordered`, deduplication through
aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.exprs import add_unit, interval_word, lookup, null_token
from tenurekit.functions.ordered import Ordered, cut
from tenurekit.functions.ranks import percentiles
from tenurekit.params import Params

# Cancel reasons of provider A and cancel messages of provider B by churn type.
REASONS_A = {"cancellation_requested": "voluntary", "payment_failed": "involuntary"}
MESSAGES_B = {
    "Cancellation after redemption period": "involuntary", "Card Token has expired": "involuntary",
    "Cancellation by support": "voluntary", "Token revoked by customer": "voluntary",
    "Fraud Alert received": "fraud", "Fraud Decline received": "fraud",
    "Recurring payment is blocked by Antifraud": "fraud", "Bank antifraud system": "fraud",
    "Fraud Chargeback received": "fraud",
}

PAYLOAD_A = """data struct<object struct<
 id string, customer string, start_date string, created string, ended_at string, cancel_at string,
 plan struct<interval string, id string, product string>, items struct<data array<struct<current_period_end string>>>,
 cancellation_details struct<reason string>, parent struct<subscription_details struct<subscription string>>,
 billing_reason string, amount_paid string, status string, currency string, payment_intent string,
 amount_refunded string, amount string, payment struct<payment_intent string>, invoice string>>"""

PAYLOAD_B = """subscription struct<id string, status string, started_at string, expired_at string, cancel_message string>,
 customer struct<customer_email string, customer_account_id string>,
 product struct<name string, product_id string, trial_amount string, amount string, trial string, payment_action string, currency string>,
 invoices map<string, struct<orders map<string, struct<
  status string, amount string, operation string, processed_at string, created_at string, updated_at string,
  retry_attempt string, failed_reason string>>>>"""


#: what flat_b reads of it, and what orders_b reads
FLAT_B = """subscription struct<id string, status string, started_at string, expired_at string, cancel_message string>,
 customer struct<customer_email string, customer_account_id string>, product struct<name string, product_id string, trial_amount string>"""
ORDERS_B = """subscription struct<id string>, invoices map<string, struct<orders map<string, struct<
  status string, amount string, processed_at string, retry_attempt string, failed_reason string>>>>"""


# ------------------------------------------------------------------ raw
def frozen(raw: DataFrame, snapshot: Column) -> DataFrame:
    """Rows of the log before a frozen time."""
    return raw.where(F.col("created") < snapshot)


def dedup_by_id(raw: DataFrame) -> DataFrame:
    """At-least-once delivery: the earliest copy of each event id."""
    rest = [c for c in raw.columns if c not in ("event_id", "created", "data")]
    pick = F.min(F.struct("created", "data", *rest))  # the payload once, not again as the order
    return raw.groupBy("event_id").agg(pick.alias("r")).select("event_id", "r.*").select(*raw.columns)


def copied(raw: DataFrame) -> DataFrame:
    """Hashes (_h) that more than one row has."""
    return raw.groupBy(F.xxhash64(*raw.columns).alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h")


def dedup_exact(raw: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """Only rows equal in every column are copies; an id may legitimately repeat.

    Rows are counted by a hash first. Those whose hash stands alone have no copy and stay where they are; only the others, copies and
    the rare pairs of one hash, are compared whole. `raw` is read twice, so it should be a stored log. `twice`: what `copied` gives,
    if it is stored already."""
    twice = cut(copied(raw)) if twice is None else twice
    if twice.isEmpty():
        return raw
    rows = raw.withColumn("_h", F.xxhash64(*raw.columns))
    alone, met = (rows.join(twice, "_h", how).drop("_h") for how in ("left_anti", "left_semi"))
    return alone.unionByName(met.distinct())


def payload_form(data: Column, volatile: str) -> Column:
    """The payload without one top-level key, in a form that the order of keys does not change: a
    variant keeps the keys of every object sorted. A text that is no JSON stands for itself."""
    parsed = F.from_json(F.to_json(F.try_parse_json(data)), "map<string,string>")
    kept = F.array_sort(F.map_entries(F.map_filter(parsed, lambda k, _: k != volatile)))
    return F.when(parsed.isNull(), F.struct(data.alias("text"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("fields"))) \
        .otherwise(F.struct(F.lit(None).cast("string").alias("text"), kept.alias("fields")))


def same_payload(raw: DataFrame, volatile: str) -> DataFrame:
    """Per repeated id: copies, and whether payloads agree once one volatile top-level key is taken out."""
    return raw.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct(F.xxhash64(payload_form(F.col("data"), volatile))).alias("payloads")).where("copies > 1").withColumn(
        "benign", F.col("payloads") == 1)


# ------------------------------------------------------------------ provider A
def parse_a(raw: DataFrame) -> DataFrame:
    o = F.from_json("data", f"{PAYLOAD_A}")["data"]["object"]
    return raw.select("event_id", "event_type", "created", o.alias("o"))


def big(c: str) -> Column:
    return F.col(c).try_cast("bigint")


def subscription_events(parsed: DataFrame) -> DataFrame:
    p = parsed.where(F.col("event_type").isin("customer.subscription.created", "customer.subscription.deleted"))
    return p.select(
        "event_id", "event_type", "created", F.col("o.id").alias("subscription_id"), F.substring("o.id", 11, 10).alias("account"),
        F.col("o.customer").alias("customer_id"), F.col("o.plan.interval").alias("plan_interval"), F.col("o.plan.id").alias("price_id"),
        F.col("o.plan.product").alias("product_id"), big("o.start_date").alias("start_epoch"),
        F.try_element_at("o.items.data", F.lit(1))["current_period_end"].try_cast("bigint").alias("period_end_epoch"),
        big("o.ended_at").alias("ended_epoch"), big("o.cancel_at").alias("cancel_epoch"),
        F.col("o.cancellation_details.reason").alias("reason"), F.col("o.currency").alias("currency"))


def invoice_rows(parsed: DataFrame) -> DataFrame:
    p = parsed.where(F.col("event_type").like("invoice.%") & (F.col("event_type") != "invoice.upcoming"))
    return p.select(
        "event_id", "event_type", "created", F.col("o.id").alias("invoice_id"),
        F.col("o.parent.subscription_details.subscription").alias("subscription_id"), F.col("o.billing_reason").alias("billing_reason"),
        big("o.amount_paid").alias("amount_cents"), F.col("o.status").alias("invoice_status"), F.col("o.customer").alias("customer_id"),
        F.lower("o.currency").alias("currency"))


def bursts(invoices: DataFrame, p: Params, gap_seconds: int = 300) -> DataFrame:
    """Rows of one invoice closer than the gap are one payment attempt."""
    inv = invoices.where("subscription_id is not null")
    scan = Ordered(["invoice_id"], "created", ["event_id"])
    g = scan.add(inv, prev={"_p": F.col("created")})
    # seconds are counted as the source does: by the second boundaries between the two times
    gap = F.unix_seconds(F.date_trunc("second", "created")) - F.unix_seconds(F.date_trunc("second", "_p"))
    g = g.withColumn("_new", F.when(F.col("_p").isNull() | (gap > gap_seconds), 1).otherwise(0).cast("bigint"))
    g = scan.add(g, running_sum={"burst_id": F.col("_new")})

    def of(t, c):
        return F.max(F.when(F.col("event_type") == t, F.col(c)))

    def has(t):
        return F.max((F.col("event_type") == t).cast("bigint"))

    paid, failed, lost = "invoice.paid", "invoice.payment_failed", "invoice.marked_uncollectible"
    return g.groupBy("invoice_id", "subscription_id", "burst_id").agg(
        has(paid).alias("has_paid"), has(failed).alias("has_failed"), has(lost).alias("has_uncollectible"),
        F.min("billing_reason").alias("billing_reason"), of(paid, "created").alias("paid_at"), of(failed, "created").alias("failed_at"),
        of(lost, "created").alias("uncollectible_at"), of(paid, "amount_cents").alias("amount_cents"),
        F.count(F.lit(1)).alias("n_rows"), F.min("created").alias("burst_start"))


def invoice_outcomes(b: DataFrame, p: Params) -> DataFrame:
    """One lifecycle event per attempt. A paid creation invoice only enriches the trial; the first
    paid cycle converts, later ones renew; failed attempts are billing issues."""
    cycle = (F.col("has_paid") == 1) & ~F.coalesce(F.col("billing_reason") == "subscription_create", F.lit(False))
    scan = Ordered(["subscription_id"], "burst_start", ["invoice_id", "burst_id"])
    b = scan.add(b, running_sum={"_n": cycle.cast("bigint")})
    paid = F.col("has_paid") == 1
    name = (F.when(paid & ~cycle, "trial_payment").when(cycle & (F.col("_n") == 1), "trial_converted").when(cycle, "subscription_renewed")
            .when((F.col("has_failed") == 1) | (F.col("has_uncollectible") == 1), "billing_issue_detected"))
    raw = (F.when(paid, "invoice.paid").when(F.col("has_failed") == 1, "invoice.payment_failed").otherwise("invoice.marked_uncollectible"))
    at = F.when(paid, F.col("paid_at")).when(F.col("has_failed") == 1, F.col("failed_at")).otherwise(F.col("uncollectible_at"))
    return b.select("subscription_id", at.alias("event_datetime"), name.alias("event_name"), raw.alias("raw_event_type"),
                    F.when(paid, F.col("amount_cents")).alias("amount_cents"), "invoice_id").where("event_name is not null")


def state_events(subs: DataFrame) -> DataFrame:
    """Created: trial start. Deleted: expiry moved to the period end, the raw moment kept."""
    end = F.coalesce(*[F.timestamp_seconds(c) for c in ("period_end_epoch", "ended_epoch", "cancel_epoch")], F.col("created"))
    new = F.col("event_type") == "customer.subscription.created"
    return subs.select(
        "subscription_id", F.when(new, F.col("created")).otherwise(end).alias("event_datetime"),
        F.when(new, "trial_started").otherwise("subscription_expired").alias("event_name"), F.col("event_type").alias("raw_event_type"),
        F.when(~new, lookup("reason", REASONS_A, "unknown")).alias("churn_type"), F.when(~new, F.col("created")).alias("churn_signal_datetime"))


def payment_links(parsed: DataFrame) -> DataFrame:
    return parsed.where("event_type = 'invoice_payment.paid'").select(
        F.col("o.payment.payment_intent").alias("payment_intent"), F.col("o.invoice").alias("invoice_id")).distinct()


def refunds_a(parsed: DataFrame, invoices: DataFrame) -> DataFrame:
    """Refunds attached to a subscription through payment and invoice; those without one are kept and flagged."""
    r = parsed.where(F.col("event_type").isin("charge.refunded", "refund.created")).select(
        "event_id", "event_type", "created", F.col("o.id").alias("object_id"), F.substring("o.id", 10, 10).alias("account"),
        F.col("o.payment_intent").alias("payment_intent"), big("o.amount_refunded").alias("refunded_cents"), big("o.amount").alias("total_cents"))
    subs = invoices.where("subscription_id is not null").select("invoice_id", "subscription_id").distinct()
    j = r.join(payment_links(parsed), "payment_intent", "left").join(subs, "invoice_id", "left")
    cents = F.when(F.col("event_type") == "charge.refunded", F.col("refunded_cents")).otherwise(F.col("total_cents"))
    return j.select("event_id", "subscription_id", F.col("created").alias("event_datetime"), F.lit("subscription_refunded").alias("event_name"),
                    F.col("event_type").alias("raw_event_type"), cents.alias("amount_cents"), "invoice_id", "account",
                    F.col("subscription_id").isNull().alias("refund_orphan"))


def paid_invoices(invoices: DataFrame) -> DataFrame:
    """One row per paid invoice: earliest time, money in dollars."""
    return invoices.where("event_type = 'invoice.paid'").groupBy("invoice_id").agg(
        F.min_by(F.struct("subscription_id", "amount_cents"), F.struct("created", "event_id")).alias("f"),
        F.min("created").alias("payment_ts")).select(
        "invoice_id", "f.subscription_id", (F.col("f.amount_cents") / 100.0).alias("amount"), "payment_ts")


# ------------------------------------------------------------------ provider B
def parse_b(raw: DataFrame, schema: str = PAYLOAD_B) -> DataFrame:
    """Rows with the fields of `schema`; other fields of a payload are skipped."""
    return raw.select("event_id", "event_type", "created", F.from_json("data", schema).alias("p"))


def flat_b(parsed: DataFrame) -> DataFrame:
    s, c, q = "p.subscription.", "p.customer.", "p.product."
    return parsed.select(
        "event_id", "event_type", "created", F.col(s + "id").alias("subscription_id"), F.lower(c + "customer_email").alias("email"),
        F.col(c + "customer_account_id").alias("account_id"), F.col(s + "status").alias("status"), F.col(s + "cancel_message").alias("cancel_message"),
        F.try_to_timestamp(s + "started_at").alias("started_at"), F.try_to_timestamp(s + "expired_at").alias("expired_at"),
        F.col(q + "name").alias("product_name"), F.col(q + "product_id").alias("product_id"), big(q + "trial_amount").alias("trial_cents"))


def orders_b(parsed: DataFrame) -> DataFrame:
    """One row per order of the nested invoices; payloads are cumulative, so the latest snapshot wins."""
    inv = parsed.select("event_id", "created", F.col("p.subscription.id").alias("subscription_id"), F.explode("p.invoices").alias("invoice_id", "i"))
    o = inv.select("event_id", "created", "subscription_id", "invoice_id", F.explode("i.orders").alias("order_id", "o"))
    f = "o."
    # figures and times are read before the rows are sorted and shuffled, and fields that nobody reads stay behind
    o = o.select(
        "event_id", "order_id", "subscription_id", "invoice_id", F.col(f + "status").alias("status"), big(f + "amount").alias("amount_cents"),
        F.try_to_timestamp(f + "processed_at").alias("processed_at"), big(f + "retry_attempt").alias("retry_attempt"),
        F.col(f + "failed_reason").alias("failed_reason"), F.col("created").alias("seen_at"))
    rest = [c for c in o.columns if c not in ("seen_at", "event_id", "order_id")]
    last = F.max(F.struct("seen_at", "event_id", *rest))
    return o.groupBy("order_id").agg(last.alias("r")).select("order_id", *[f"r.{c}" for c in (*rest, "seen_at")])


def order_outcomes(orders: DataFrame, p: Params, stored: bool = False) -> DataFrame:
    """Settled money converts or renews, failed authorisations are issues, refunds are refunds; other
    states and orders without a processing time give nothing. `stored`: the orders are a written table."""
    o = orders.where("subscription_id is not null and processed_at is not null").select(
        "subscription_id", "processed_at", "retry_attempt", "order_id", "status", "amount_cents")
    ok = (F.col("status") == "settle_ok") & (F.coalesce("amount_cents", F.lit(0)) > 0)
    o = o.withColumn("_retry", F.coalesce("retry_attempt", F.lit(2**62)))
    scan = Ordered(["subscription_id"], "processed_at", ["_retry", "order_id"], stored=stored)
    o = scan.add(o, running_sum={"_n": F.coalesce(ok, F.lit(False)).cast("bigint")})
    st = F.col("status")
    name = (F.when(ok & (F.col("_n") == 1), "trial_converted").when(ok, "subscription_renewed")
            .when(st == "auth_failed", "billing_issue_detected").when(st == "refunded", "subscription_refunded"))
    raw = F.when(st == "auth_failed", F.concat(F.lit("order:auth_failed(retry="), F.coalesce(F.col("retry_attempt").cast("string"), F.lit("None")), F.lit(")"))).otherwise(
        F.concat(F.lit("order:"), st))
    cents = F.when(st != "auth_failed", F.col("amount_cents"))
    return o.select("subscription_id", F.col("processed_at").alias("event_datetime"), name.alias("event_name"), raw.alias("raw_event_type"),
                    cents.alias("amount_cents"), "order_id").where("event_name is not null")


def starts_b(flat: DataFrame) -> DataFrame:
    """Exactly one start per subscription, with where it came from."""
    g = flat.where("subscription_id is not null").groupBy("subscription_id").agg(
        F.min(F.when(F.col("event_type").isin("create", "active"), F.col("created"))).alias("c"),
        F.min("started_at").alias("s"), F.min("created").alias("f"))
    src = F.when(F.col("c").isNotNull(), "create/active").when(F.col("s").isNotNull(), "synth:started_at").otherwise("synth:first_event")
    return g.select("subscription_id", F.coalesce("c", "s", "f").alias("event_datetime"), F.lit("trial_started").alias("event_name"), src.alias("raw_event_type"))


def missing_starts(events: DataFrame) -> DataFrame:
    """A start at the earliest event for subscriptions that have none."""
    g = events.where("subscription_id is not null").groupBy("subscription_id").agg(
        F.min("event_datetime").alias("event_datetime"), F.max(F.col("event_name") == "trial_started").alias("_s"))
    return g.where("not _s").select("subscription_id", "event_datetime", F.lit("trial_started").alias("event_name"),
                                    F.lit("synth:pre_window").alias("raw_event_type"))


def entry_edges(flat: DataFrame, p: Params, status: str = "redemption", stored: bool = False) -> DataFrame:
    """Rows where the status becomes `status` and was something else in the row before. `stored`: the rows are a written table."""
    f = flat.where("subscription_id is not null").select(
        "subscription_id", "created", "event_id", "event_type", F.coalesce(F.col("status") == status, F.lit(False)).alias("_in"))
    scan = Ordered(["subscription_id"], "created", ["event_id"], stored=stored)
    f = scan.add(f, prev={"_was": F.col("_in")})
    return f.where(F.col("_in") & ~F.coalesce("_was", F.lit(False))).select(
        "subscription_id", F.col("created").alias("event_datetime"), F.lit("entered_grace_period").alias("event_name"),
        F.col("event_type").alias("raw_event_type"))


def terminals(flat: DataFrame, orders: DataFrame) -> DataFrame:
    """Cancel and expire events with churn type and time of death: the stated expiry, else (expire)
    one interval after the last success, else the moment of the signal."""
    last = orders.where("status = 'settle_ok' and subscription_id is not null").groupBy("subscription_id").agg(F.max("processed_at").alias("_last"))
    unit = flat.where("subscription_id is not null").groupBy("subscription_id").agg(
        F.min_by("product_name", F.when(F.col("product_name").isNotNull(), F.struct("created", "event_id"))).alias("_n"))
    t = flat.where(F.col("event_type").isin("expire", "cancel") & F.col("subscription_id").isNotNull())
    t = t.join(last, "subscription_id", "left").join(unit, "subscription_id", "left").withColumn("_unit", interval_word("_n"))
    cancel = F.col("event_type") == "cancel"
    death = F.when(cancel, F.col("expired_at")).otherwise(F.coalesce("expired_at", add_unit("_last", "_unit")))
    return t.select("event_id", "subscription_id", F.coalesce(death, F.col("created")).alias("event_datetime"), F.lit("subscription_expired").alias("event_name"),
                    F.col("event_type").alias("raw_event_type"),
                    F.when(cancel, lookup("cancel_message", MESSAGES_B, "unknown")).otherwise("involuntary").alias("churn_type"),
                    F.col("created").alias("churn_signal_datetime"))


# ------------------------------------------------------------------ enrichment and assembly
def cadence(events: DataFrame, p: Params, success: Sequence[str] = ("trial_converted", "subscription_renewed")) -> DataFrame:
    """Interval closest to the median gap of successes."""
    s = events.where(F.col("event_name").isin(*success) & F.col("subscription_id").isNotNull()).select("subscription_id", "event_datetime", "event_name")
    tie = ["event_name"]
    scan = Ordered(["subscription_id"], "event_datetime", tie)
    s = scan.add(s, prev={"_p": F.col("event_datetime")})
    gap = (F.unix_micros("event_datetime") - F.unix_micros("_p")) / F.lit(86_400e6)
    m = percentiles(s.withColumn("gap", gap), "gap", [0.5], ["subscription_id"]).withColumnRenamed("q0", "gap")
    near = F.array(*[F.struct(F.abs(F.col("gap") - d).alias("d"), F.lit(i).alias("i"), F.lit(u).alias("u"))
                     for i, (u, d) in enumerate((("day", 1), ("week", 7), ("month", 30), ("year", 365)))])
    return m.select("subscription_id", F.col("gap").alias("median_gap"), F.array_min(near)["u"].alias("interval_unit"))


def resolve_attribution(keys: DataFrame, log: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Attribution row per key: among rows with a country (else all), when the key has several
    countries the latest at or before the install, else the earliest.

    keys: key, email, install_date. log: email, event_date, country, utm_source, campaign_name, and
    the columns named in `extra`."""
    row = F.struct(F.unix_micros("event_date").alias("us"), F.coalesce("country", F.lit("")).alias("c"),
                   F.coalesce("utm_source", F.lit("")).alias("u"), "country", "utm_source", "campaign_name", *extra)
    real = F.col("country").isNotNull()
    # one row per address: the earliest row with a country, the earliest of all, and how many countries
    amb = log.groupBy("email").agg(
        F.count_distinct("country").alias("_c"), F.max(real).alias("_real"),
        F.min(F.when(real, row)).alias("_first_real"), F.min(row).alias("_first"))
    # the latest row at or before an install: one union of log and keys, one ordered scan per address;
    # of rows at one time the first by country and source counts, so only that one is in the scan
    times = log.where(real).groupBy("email", "event_date").agg(F.min(row).alias("_r"))
    both = times.select("email", F.col("event_date").alias("_t"), F.lit(0).alias("_is_key"), "_r").unionByName(
        keys.select("email", F.col("install_date").alias("_t"), F.lit(1).alias("_is_key"), "key"), allowMissingColumns=True)
    last = Ordered(["email"], "_t", ["_is_key", "key"]).add(both, last_before={"_last": F.col("_r")}).where("_is_key = 1")
    j = last.join(amb, "email", "left")
    many = F.coalesce(F.col("_c") > 1, F.lit(False))
    r = F.when(many & F.col("_t").isNotNull(), F.coalesce("_last", "_first_real", "_first")).otherwise(F.coalesce("_first_real", "_first"))
    g = j.select("key", r.alias("r"), "_real", many.alias("geo_ambiguous"), "_c")
    status = F.when(F.col("_c").isNull(), "no_match").when(F.col("_real"), "resolved").otherwise("unknown")
    return g.select("key", F.when(F.col("_real"), F.col("r.country")).alias("country"), F.col("r.utm_source").alias("utm_source"),
                    F.col("r.campaign_name").alias("campaign_name"), status.alias("geo_status"), "geo_ambiguous",
                    *[F.col(f"r.{c}").alias(c) for c in extra])


def first_known(columns: Mapping[str, str], name: str) -> list[Column]:
    """First non-blank of several sources, and which one it was (`none` when all are blank)."""
    vals = [(null_token(c), step) for c, step in columns.items()]
    step = None
    for v, s in vals:
        step = F.when(v.isNotNull(), s) if step is None else step.when(v.isNotNull(), s)
    return [F.coalesce(*[v for v, _ in vals]).alias(name), step.otherwise("none").alias(f"{name}_step")]


def reclassify(rows: DataFrame, fresh: DataFrame, apps: Mapping[str, str], key: str = "subscription_id", default: str = "other") -> DataFrame:
    """A fresh product id overrides the stored one; the application follows it, the old one is kept."""
    j = rows.join(fresh.select(key, F.col("product_id").alias("_new")), key, "left")
    product = F.coalesce("_new", "product_id")
    return j.withColumn("app_id_old", F.col("app_id")).withColumn("product_id", product).withColumn(
        "app_id", lookup("product_id", apps, default)).drop("_new")


def qa_flags(subs: DataFrame, payments: DataFrame, max_payments: int = 45) -> DataFrame:
    """Test subscriptions: daily plan, test source, or too many payments."""
    n = payments.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n_payments"))
    j = subs.join(n, "subscription_id", "left").withColumn("n_payments", F.coalesce("n_payments", F.lit(0)))
    flag = (F.coalesce(F.col("interval_unit") == "day", F.lit(False)) | F.coalesce(F.lower("utm_source").contains("test"), F.lit(False))
            | (F.col("n_payments") > max_payments))
    return j.withColumn("is_qa", flag)


SILVER_COLUMNS = ("subscription_id", "payment_provider", "event_name", "event_datetime", "raw_event_type", "amount_cents",
                  "churn_type", "churn_signal_datetime", "refund_orphan")


def assemble(parts: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """Union of all lifecycle events in one fixed layout; churn type only on terminal events."""
    out = None
    for provider, frames in parts.items():
        for f in frames:
            f = f.withColumn("payment_provider", F.lit(provider))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    term = F.col("event_name") == "subscription_expired"
    missing = {"amount_cents": "bigint", "churn_type": "string", "churn_signal_datetime": "timestamp", "refund_orphan": "boolean"}
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in out.columns})
    return out.withColumn("churn_type", F.when(term, F.col("churn_type"))).withColumn(
        "refund_orphan", F.coalesce("refund_orphan", F.lit(False))).where("event_name <> 'trial_payment'").select(*SILVER_COLUMNS)


SILVER_TABLE = (
    "subscription_id", "customer_user_id", "payment_provider", "account", "app_id", "event_name", "event_datetime", "install_date",
    "country_code", "geo_ambiguous", "geo_status", "media_source", "media_source_step", "campaign", "product_id", "price_id",
    "interval_unit", "interval_source", "trial_type", "price_amount", "churn_type", "is_qa", "refund_orphan", "raw_event_type",
    "churn_signal_datetime")


def subscription_attributes(dims: DataFrame, events: DataFrame, log: DataFrame, gaps: DataFrame, default_app: str,
                            account_apps: Mapping[str, str], test: str = "test", qa_plans: Sequence[str] = ("provider_a",)) -> DataFrame:
    """One row per subscription with everything that its events carry.

    dims: subscription_id, payment_provider, customer_user_id, email, account, own_media, own_campaign,
    own_app, plan_interval, plan_name, price_id, product_id, trial_type, started_at.
    log: attribution rows with app_name. gaps: subscription_id, interval_unit by cadence.
    Own media go before attributed media, a plan's interval before the one in its name, and that before
    the cadence; a test source leaves no media, but a flag, as do daily plans of the named providers."""
    start = events.where("event_name = 'trial_started'").groupBy("subscription_id").agg(F.min("event_datetime").alias("_start"))
    d = dims.join(start, "subscription_id", "left").withColumn("install", F.coalesce("started_at", "_start"))
    att = resolve_attribution(d.select(F.col("subscription_id").alias("key"), "email", F.col("install").alias("install_date")), log, ["app_name"])
    d = d.join(att, d.subscription_id == att.key, "left").join(
        gaps.select("subscription_id", F.col("interval_unit").alias("_by_gap")), "subscription_id", "left")
    media, step = first_known({"own_media": "subscription", "utm_source": "attribution"}, "_media")
    d = d.withColumns({"_own": null_token("own_media"), "_att": null_token("utm_source")}).select("*", media, step)
    named = interval_word("plan_name")
    plan = null_token("plan_interval")
    unit = F.coalesce(plan, named, "_by_gap")
    source = F.when(plan.isNotNull(), "plan").when(named.isNotNull(), "from_name").when(F.col("_by_gap").isNotNull(), "inferred_from_cadence")
    is_test = F.coalesce(F.col("_own") == test, F.lit(False)) | F.coalesce(F.col("_att") == test, F.lit(False))
    campaign = F.when(F.col("_own").isNotNull(), null_token("own_campaign")).when(F.col("_att").isNotNull(), null_token("campaign_name"))
    known_app = F.create_map(*[x for k, v in account_apps.items() for x in (F.lit(k), F.lit(v))]) if account_apps else F.lit(None).cast("map<string,string>")
    return d.select(
        "subscription_id", "customer_user_id", "account", F.to_date("install").alias("install_date"), F.col("country").alias("country_code"),
        F.coalesce("geo_ambiguous", F.lit(False)).alias("geo_ambiguous"), F.coalesce("geo_status", F.lit("no_match")).alias("geo_status"),
        F.nullif("_media", F.lit(test)).alias("media_source"), F.nullif("_media_step", F.lit("none")).alias("media_source_step"),
        campaign.alias("campaign"), "product_id", "price_id", unit.alias("interval_unit"), source.alias("interval_source"), "trial_type",
        F.coalesce(F.lower(null_token("own_app")), F.try_element_at(known_app, F.col("account")), F.lower(null_token("app_name")), F.lit(default_app)).alias("app_id"),
        (is_test | (F.col("payment_provider").isin(*qa_plans) & F.coalesce(unit == "day", F.lit(False)))).alias("is_qa"))


def silver_table(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """Lifecycle events with the attributes of their subscription, in the published layout. A refund
    without a subscription keeps its row and has none of them."""
    j = events.join(attributes, "subscription_id", "left").withColumns({
        "price_amount": F.col("amount_cents") / 100, "is_qa": F.coalesce("is_qa", F.lit(False)), "app_id": F.coalesce("app_id", F.lit(None).cast("string"))})
    return j.select(*SILVER_TABLE)


def canonical_starts(created: DataFrame, converted: DataFrame, activated: DataFrame) -> DataFrame:
    """Starts of a subscription: trials created as such, and incomplete ones that later began their
    trial; the earliest per subscription.

    created: subscription_id, ts, status. converted: subscription_id, ts of the change to trialing.
    activated: subscription_id, ts (an attached fact of the start)."""
    direct = created.where("status = 'trialing'").select("subscription_id", "ts", F.lit("created_trialing").alias("source"))
    late = created.where("status = 'incomplete'").select("subscription_id").distinct().join(converted, "subscription_id").select(
        "subscription_id", "ts", F.lit("incomplete_to_trialing").alias("source"))
    first = direct.unionByName(late).groupBy("subscription_id").agg(F.min(F.struct("ts", "source")).alias("f")).select("subscription_id", "f.*")
    a = activated.groupBy("subscription_id").agg(F.min("ts").alias("activated_ts"))
    return first.join(a, "subscription_id", "left")


# ------------------------------------------------------------------ payload profiles
# what the recursive query still has to open of a text that the fixed levels below don't exhaust
_LEAVES = """
WITH RECURSIVE t(k, path, v, done) AS (
  SELECT k, '' AS path, v, false AS done FROM {texts}
  UNION ALL
  SELECT t.k, CASE WHEN e.pos IS NULL THEN t.path WHEN e.key IS NULL THEN concat(t.path, '[]')
    ELSE concat(t.path, CASE WHEN t.path = '' THEN '' ELSE '.' END, regexp_replace(e.key, :dynamic, '*')) END,
    CASE WHEN e.pos IS NULL THEN t.v ELSE e.value END, e.pos IS NULL
  FROM t, LATERAL variant_explode_outer(t.v) e WHERE NOT t.done)
SELECT k, path, CAST(v AS STRING) AS value, v IS NULL AS unread FROM t WHERE done"""
# one level more of every open value; a leaf stays as it is
_LEVEL = """
SELECT t.k, CASE WHEN e.pos IS NULL THEN t.path WHEN e.key IS NULL THEN concat(t.path, '[]')
  ELSE concat(t.path, CASE WHEN t.path = '' THEN '' ELSE '.' END, regexp_replace(e.key, :dynamic, '*')) END AS path,
  CASE WHEN e.pos IS NULL THEN t.v ELSE e.value END AS v, e.pos IS NULL AS done
FROM {t} t, LATERAL variant_explode_outer(CASE WHEN t.done THEN NULL ELSE t.v END) e"""
LEVELS = 12  # levels opened by one pass without a shuffle; deeper texts go through the recursive query


def _depth(text: Column, most: int) -> Column:
    """How deep objects and lists of a JSON text are nested, `most` + 1 for all that are deeper. Of the text only brackets outside of
    strings are left; taking out all empty pairs lowers the depth by one."""
    whole = F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r'[^\[\]{}"]+', ""), '"[^"]*"', ""), '"', "")
    start = F.struct(left.alias("left"), F.lit(0).alias("n"))
    deeper = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, i: F.when(s["left"] == "", s).otherwise(
        F.struct(F.regexp_replace(s["left"], r"\[\]|\{\}", "").alias("left"), (s["n"] + 1).alias("n"))),
        lambda s: F.when(s["left"] == "", s["n"]).otherwise(most + 1))
    return F.when(text.isNull(), 0).otherwise(deeper)


def json_leaves(raw: DataFrame, keys: Sequence[str], column: str = "data",
                dynamic: str = "^[A-Za-z]*_?[0-9][0-9-]*$") -> DataFrame:
    """(keys, path, value, readable) for every leaf of a JSON text; key names that look like ids become `*`, list items add `[]`.

    The texts are written once and their depth is counted; then as many levels are opened as the deepest text has, in one pass without a
    shuffle. Texts of more than LEVELS levels go through a recursive query, which ends with the data. Values are the text of the leaf as
    a variant writes it (2.50 is 2.5, 1e3 is 1000.0), null for null; an empty object or list is one leaf. A null text is one leaf without
    value at the empty path; so is a text that no variant can hold, with the text as value and `readable` false: no JSON, a key twice in
    an object, or nested more than 1,000 deep. Takes the limits off the session's recursive queries."""
    spark = raw.sparkSession
    rows = cut(raw.select(*keys, F.col(column).cast("string").alias("_text")))
    levels = rows.agg(F.max(_depth(F.col("_text"), LEVELS))).first()[0] or 0

    def opened(texts: DataFrame) -> DataFrame:
        r = texts.withColumn("v", F.try_parse_json("_text"))
        # only what can't be read takes its text along
        return r.select(F.struct(*keys, F.when(F.col("v").isNull(), F.col("_text")).alias("_text")).alias("k"), "v")

    shallow = rows if levels <= LEVELS else rows.where(_depth(F.col("_text"), LEVELS) <= LEVELS)
    t = opened(shallow).select("k", F.lit("").alias("path"), "v", F.lit(False).alias("done"))
    for _ in range(min(levels, LEVELS)):
        t = spark.sql(_LEVEL, {"dynamic": dynamic}, t=t)
    found = t.select("k", "path", F.col("v").cast("string").alias("value"), F.col("v").isNull().alias("unread"))
    if levels > LEVELS:
        for limit in ("Level", "Row"):
            spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", "-1")
        deep = rows.where(_depth(F.col("_text"), LEVELS) > LEVELS)
        found = found.unionByName(spark.sql(_LEAVES, {"dynamic": dynamic}, texts=opened(deep)))
    bad = F.col("unread") & F.col("k._text").isNotNull()
    return found.select(*[F.col("k")[c].alias(c) for c in keys], "path", F.when(bad, F.col("k._text")).otherwise(F.col("value")).alias("value"), (~bad).alias("readable"))


def path_profile(leaves: DataFrame, interesting: str) -> DataFrame:
    """Occurrences, filled values, distinct values and a sample per path; flags names of interest."""
    g = leaves.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.count_distinct("value").alias("values"),
        F.min("value").alias("sample"))
    return g.withColumn("interesting", F.col("path").rlike(interesting))


def differing_paths(leaves: DataFrame, key: str = "event_id") -> DataFrame:
    """Paths whose value differs between copies of one id, with the number of ids."""
    per = leaves.groupBy(key, "path").agg(F.count_distinct("value").alias("v")).where("v > 1")
    return per.groupBy("path").agg(F.count(F.lit(1)).alias("ids"))
