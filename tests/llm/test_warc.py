import hashlib
from collections import Counter

import pytest

from tenurekit.llm import warc

BIG = "<p>é</p>" * 200
ROWS = [(1, "u/1", BIG), (2, "u/2", BIG), (9, "u\r\n%0A9", BIG), (3, "u/3", "small"), (4, "u/4", "small"), (5, None, None), (6, "u/6", ""),
        (7, "u/7", "y" * 1000), (8, "u/8", "y" * 1000), (8, "u/8b", "y" * 1000), (None, "u/n", "z" * 5000), (10, "u/10", "w" * 999)]


def test_records(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, address string")
    headers, payloads = warc.write_archive(pages)
    texts = {(t or "").encode() for _, _, t in ROWS}
    assert sorted(bytes(r.body) for r in payloads.collect()) == sorted(texts)  # each once
    got = warc.read_archive(headers, payloads).collect()
    assert len(got) == len(ROWS)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert Counter((r.id, r.url, r.payload_digest, r.payload_bytes) for r in got) == Counter(
        (None if i is None else str(i), u, sha(t), len((t or "").encode())) for i, u, t in ROWS)
    owner = {sha(BIG): "9", sha("y" * 1000): "8"}
    for digest, of in owner.items():
        mine = [r for r in got if r.payload_digest == digest]
        assert [r.id for r in mine if r.record_type == "response"] == [of]
        assert all(r.refers_to == of for r in mine if r.record_type == "revisit")
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_digest not in owner)
    for r in got:
        raw = bytes(r.record)
        head, _, body = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and body.endswith(b"\r\n\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(body) == length + 4
        if r.record_type == "response":
            assert hashlib.sha1(body[:length]).hexdigest() == r.payload_digest
    again = [bytes(r.header) for r in headers.collect()]
    assert sorted(again) == sorted(bytes(r.record).partition(b"\r\n\r\n")[0] + b"\r\n\r\n" for r in got)


def test_damage_is_found(spark):
    headers, payloads = warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    from pyspark.sql import functions as F

    bad = payloads.withColumn("body", F.when(F.length("body") == 5, F.lit(b"smell")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(headers, bad).collect()


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(*warc.write_archive(empty)).count() == 0


def test_equal_rows_without_id(spark):
    rows = [(None, "u/1", BIG), (None, "u/2", BIG), (None, None, BIG), (None, "u/2", BIG), (None, "v", "z" * 5000), (4, "v", "z" * 5000), (4, "v", "z" * 5000), (None, "v", "z" * 5000)]
    headers, payloads = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert sorted(bytes(r.body) for r in payloads.collect()) == sorted([BIG.encode(), b"z" * 5000])
    got = warc.read_archive(headers, payloads).collect()
    assert Counter((r.id, r.url, r.payload_bytes) for r in got) == Counter((None if i is None else str(i), u, len(t.encode())) for i, u, t in rows)
    assert sorted((r.id or "", r.url) for r in got if r.record_type == "response") == [("", "u/2"), ("4", "v")]
    assert Counter(r.refers_to for r in got if r.record_type == "revisit") == {None: 3, "4": 3}


def test_required_fields_and_unique_ids(spark):
    """What WARC/1.1 makes mandatory for every record, and a revisit that names exactly one record."""
    import re

    rows = [(8, "u/8", "y" * 1000, "2024-03-01 10:00:00"), (8, "u/8", "y" * 1000, None), (8, "u/8b", "y" * 1000, "2024-03-02 00:00:00"), (None, None, "", None), (None, None, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string")
    got = warc.read_archive(*warc.write_archive(pages, date="at")).collect()
    heads = [bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n") for r in got]
    fields = [dict(x.split(": ", 1) for x in h[1:]) for h in heads]
    assert all(h[0] == "WARC/1.1" for h in heads)
    for f in fields:
        assert {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"} <= set(f)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) and re.fullmatch("<urn:page:[0-9]*:[0-9]+>", f["WARC-Record-ID"])
    ids = Counter(f["WARC-Record-ID"] for f in fields)
    assert len(ids) == 5 and set(ids.values()) == {1}
    assert "2024-03-01T10:00:00Z" in {f["WARC-Date"] for f in fields}
    answers = {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}
    assert [f["WARC-Refers-To"] in answers for f in fields if f["WARC-Type"] == "revisit"] == [True, True]
