"""Content-addressed WARC archive.

Payload bytes are stored once per (SHA-256, length); the exact header block of every record is stored apart with the
address of its payload. Reading joins the two, checks both digests against the bytes, puts the original records together
byte for byte and parses them. Of records with equal payloads of at least `min_revisit` bytes the one with the largest
id is the response, the others are revisits that carry no block; smaller ones are all responses.

Every record has an id of its own (of its page and of its row) and a date, of its page or of the run.

Null or empty payloads are zero bytes. Null ids and URLs are written as empty fields and read back as null. Rows equal in
id and payload give as many records; one of them is the response of a large payload.
"""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tenurekit.llm.store import new_folder, written

MIN_REVISIT = 1000
COPIES = 16  # a payload that many records may read is dealt to so many join keys
_CRLF = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(_CRLF))


def _record_id(id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _one_line(c: Column) -> Column:
    """A header value: percent signs and line ends are escaped, so that the header block stays well formed."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _plain(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


def write_archive(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = MIN_REVISIT, folder: str | None = None, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables (headers, payloads): a header block per row of `pages`, and each distinct payload once. `date`: column of the time of
    each record; without one, or where it is null, the time of the run."""
    now = F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    when = F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), now) if date else now
    folder = folder or new_folder(pages.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), when.alias("date"), body.alias("body"))
    named = rows.select("id", "url", "date", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("address"),
                        F.sha1("body").alias("sha1"))
    named = written(named.withColumn("row", F.monotonically_increasing_id()), "", f"{folder}/named")  # written, so that a row keeps its number
    large = named.where(F.col("bytes") >= min_revisit)
    # one row of each payload is the response: of the largest id (null is the least), then of the largest URL
    owner = large.groupBy("address", "bytes").agg(F.max(F.struct("id", "url", "row")).alias("top")) \
        .select("address", "bytes", F.col("top.id").alias("owner"), F.col("top.row").alias("bearer"))
    small = named.where(F.col("bytes") < min_revisit).withColumns({"owner": F.col("id"), "bearer": F.col("row"), "kind": F.lit("response")})
    # the records of one payload are dealt to COPIES keys
    dealt = owner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    owned = (large.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(COPIES)).cast("int")).join(dealt, ["address", "bytes", "salt"])
             .withColumn("kind", F.when(F.col("row") == F.col("bearer"), "response").otherwise("revisit")).select(*small.columns))
    revisit = F.col("kind") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF), _field("WARC-Type", F.col("kind")), _field("WARC-Record-ID", _record_id(F.col("id"), F.col("row"))), _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", _one_line(F.col("url"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _record_id(F.col("owner"), F.col("bearer"))), _field("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(_CRLF))
    headers = written(small.unionByName(owned).select(F.encode(head, "UTF-8").alias("header"), "address", "bytes"), "", f"{folder}/headers")
    # one row of `pages` stands for each payload; rows equal in id and payload are one before they move (a struct of null equals another)
    bearer = owner.select("address", F.struct(F.col("owner").alias("id")).alias("who"))
    bodies = rows.select(F.struct("id").alias("who"), "body", F.sha2("body", 256).alias("address"))
    large_bodies = bodies.where(F.octet_length("body") >= min_revisit).groupBy("address", "who").agg(F.first("body").alias("body")) \
        .join(bearer, ["address", "who"], "left_semi")
    small_bodies = bodies.where(F.octet_length("body") < min_revisit).groupBy("address").agg(F.first("body").alias("body"))
    payloads = large_bodies.select("address", "body").unionByName(small_bodies.select("address", "body"))
    return headers, written(payloads, "", f"{folder}/payloads")


def read_archive(headers: DataFrame, payloads: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Per record: `record` (its exact bytes), the parsed fields, and the digest and length of its full payload.

    Raises if a stored payload does not have the digests that its address and the records state.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(COPIES)).cast("int")
    stored = payloads.select("address", "body", F.octet_length("body").cast("long").alias("stored_bytes"), F.sha1("body").alias("stored_sha1"),
                             (F.sha2("body", 256) == F.col("address")).alias("sound"))
    stored = stored.withColumn("sound", F.when(F.col("sound"), True).otherwise(F.raise_error("payload does not match its address")))
    deal = F.when(F.col("stored_bytes") < min_revisit, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    text = F.decode("header", "UTF-8")
    value = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    # revisits need the length and digest of their payload, not its bytes
    lines = headers.select("header", "address", value("WARC-Type").alias("record_type"), "bytes", salt(F.col("header")).alias("salt"))
    known = stored.withColumn("salt", F.explode(deal))
    response = (lines.where("record_type = 'response'").withColumn("salt", F.when(F.col("bytes") < min_revisit, F.col("salt")).otherwise(0))
                .join(known, ["address", "salt"]))
    known = (stored.withColumn("body", F.lit(None).cast("binary"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))))
    revisit = lines.where("record_type = 'revisit'").join(known, ["address", "salt"])
    block = F.coalesce(F.col("body"), F.lit(b""))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*):[0-9]+>$", 1), F.lit(""))
    out = response.unionByName(revisit).select(
        page(value("WARC-Record-ID")).alias("id"), value("WARC-Record-ID").alias("record_id"), value("WARC-Date").alias("date"), F.nullif(_plain(value("WARC-Target-URI")), F.lit("")).alias("url"),
        "record_type", page(value("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(value("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        F.col("stored_bytes").alias("payload_bytes"), "stored_sha1", "sound",
        F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
    return out.where(F.when(F.col("sound") & (F.col("payload_digest") == F.col("stored_sha1")), True)
                     .otherwise(F.raise_error("record does not match its payload"))).drop("stored_sha1", "sound")
