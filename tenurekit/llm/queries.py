"""One registered query per operator: the operator over a whole table, and the digest columns made from its result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenurekit.llm import bpe, chat, dac, decontaminate, hard_negatives, html_text, periods, personal, prefix_tree, quality, secrets, sharding, warc
from tenurekit.llm.tables import query, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT r, i, n, word, {grams} FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
{marks}
cov AS (SELECT g.r, g.i, length(g.word) AS c, {covers} FROM g {joins}),
sums AS (SELECT r, sum(c) AS word_chars, {totals} FROM cov GROUP BY r),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_dup_lines, sum(c) AS dup_line_chars FROM lines WHERE k > 1 GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {names}
  FROM d JOIN w USING (r) LEFT JOIN sums USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {base_share} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {casts}, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {line_share} * word_chars AND {verdict} AS kept FROM f
"""


def rules_sql(rules: quality.Rules = quality.RULES) -> str:
    sizes = sorted({rules.base_window, *(m for m, _ in rules.coverage)})
    ns = [m for m, _ in rules.coverage]
    gram = lambda m: f"CASE WHEN i + {m} <= n + 1 THEN " + " || ' ' || ".join(
        "word" if k == 0 else f"lead(word, {k}) OVER o" for k in range(m)) + f" END AS g{m}"
    mark = lambda m: (f"m{m} AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g{m}) AS c FROM g "  # noqa: E731
                      f"WHERE g{m} IS NOT NULL), range({m}) t(k) WHERE c > 1),")
    return _RULES_SQL.format(
        grams=", ".join(map(gram, sizes)), marks="\n".join(map(mark, sizes)),
        covers=", ".join(f"m{m}.i IS NOT NULL AS in{m}" for m in sizes),
        joins=" ".join(f"LEFT JOIN m{m} ON m{m}.r = g.r AND m{m}.i = g.i" for m in sizes),
        totals=f"count(*) FILTER (in{rules.base_window}) AS n_repeat_words, " + ", ".join(
            f"coalesce(sum(c) FILTER (in{m}), 0) AS dup_{m}gram_chars" for m in ns),
        names=", ".join(f"coalesce(dup_{m}gram_chars, 0) AS dup_{m}gram_chars" for m in ns),
        casts=", ".join(f"CAST(dup_{m}gram_chars AS BIGINT) AS dup_{m}gram_chars" for m in ns),
        verdict=" AND ".join(f"100 * dup_{m}gram_chars <= {most} * word_chars" for m, most in rules.coverage),
        min_words=rules.min_words, base_share=rules.base_share, line_share=rules.line_share)


@query("op1_quality_rules", rules_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM o
"""


@query("op8_warc", _WARC_SQL)
def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(headers, payloads).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query("op4_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = dac.write_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return dac.checksums(segments).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


_LEAKS_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all({fold}, '{word}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (
  SELECT item_id, ws, least(10, len(ws)) AS l, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold}, '{word}') AS ws FROM documents),
dw AS (SELECT r, i, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (
  SELECT r, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)),
h AS (SELECT r, i, dw.l, CAST(item_id AS VARCHAR) AS item FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, range(10) t(k) WHERE k < l GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
""".format(fold="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
           word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@query("op10_decontamination", _LEAKS_SQL)
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_LINKS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CAST(l AS VARCHAR) || ':' || array_to_string(ws[i:i + l - 1], ' ') AS g FROM (
  SELECT doc_id, ws, least(5, len(ws)) AS l, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id GROUP BY doc_id
"""


@query("op3_jaccard_join", _LINKS_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.link_components(table(spark, sf_dir, "documents"))


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op5_chat", _CHAT_SQL)
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and a conversation whose texts look like control strings, as a log of events; folded, rendered, read back."""
    hard = F.lit(chat.END + chat.START + "assistant ok")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return chat.digests(chat.format_log(chat.log_of(rows.unionByName(extra))))


@query("op9_secrets")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query("op7_main_text")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
q AS (SELECT *, row_number() OVER () AS pr FROM p)
SELECT q.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pr ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score FROM q JOIN s USING (ar)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY pr ORDER BY score DESC, vec_id) <= 10
"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(vectors.select("vec_id", "embedding", noisy.alias("label")))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by crc32 of the id, the words from one place on repeat the first ones there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    hit = hit.withColumn("n", F.greatest(F.size("words"), F.lit(1))).withColumn("a", F.col("g") % F.col("n"))
    hit = hit.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return hit.select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


# a run of 24 words and three periods q holds 16-word windows that are equal at distance q, one from each of its places on
_RUNS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda s, v: xor((xor(s, v) >> 1), 3988292384 * (xor(s, v) & 1))) AS c FROM documents),
h AS (SELECT r, doc_id, ws, len(ws) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM d),
k AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM h),
w AS (SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM k)),
g AS (SELECT r, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS g FROM w),
f AS (SELECT r, i, n, hash(g) AS g FROM g WHERE i + 16 <= n),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM
  (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
u AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length // period DESC, (length % period) / period DESC, start, period) = 1),
t AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line FROM u GROUP BY r),
o AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN o ON w.r = o.r AND w.i = o.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN t USING (r) LEFT JOIN c USING (r)
"""


@query("op13_periodic_runs", _RUNS_SQL)
def periodic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(planted_periods(table(spark, sf_dir, "documents")), digests=True)


@query("op12_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["plain"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, personal.KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
