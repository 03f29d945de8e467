import gzip
import hashlib

from pyspark.sql import functions as F

from semifold.llm import warc
from semifold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, same

BIG = "é<p>x</p>\r\n\r\nWARC/1.1\r\n" * 60


def brute(rows):
    out = []
    for pid, _, html in rows:
        data = (html or "").encode()
        same_ = [p for p, _, h in rows if (h or "").encode() == data]
        owner = max((p for p in same_ if p is not None), default=None)
        rev = len(data) >= 1000 and len(same_) > 1 and owner is not None and owner != pid
        out.append((pid, len(data), hashlib.sha1(data).hexdigest(), "revisit" if rev else "response", owner if rev else None))
    return sorted(out, key=repr)


def test_matches_sql(spark):
    same(QUERIES["op4_warc"](spark, SF), ORACLE_SQL["op4_warc"])


def test_odd_rows(spark):
    rows = [(1, "http://a/%0A\n", BIG), (2, None, BIG), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", BIG), (7, "u", BIG), (8, "z", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive_pages(spark, df, with_payload=True).cache()
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=repr) == brute(rows)
    full = {r["page_id"]: r for r in got.collect()}
    assert bytes(full[7]["response"]["payload"]).decode() == BIG and full[1]["response"]["payload"] is None
    assert full[1]["response"]["target_uri"] == "http://a/%0A\n" and full[2]["response"]["target_uri"] is None
    assert all(r["request"]["record_id"] and r["metadata"]["record_id"] for r in full.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_pages(spark, df).count() == 0


def test_records_survive_a_round_trip():
    recs = warc._capture(5, "http://x/\r\n", b"a\r\n\r\nb", hashlib.sha1(b"a\r\n\r\nb").hexdigest(), 6, None, None)
    parsed = warc.parse_bytes(b"".join(recs))
    assert [h["warc-type"] for h, _ in parsed] == ["request", "response", "metadata"]
    assert parsed[1][1].endswith(b"\r\n\r\na\r\n\r\nb") and len(gzip.decompress(recs[1])) > 0
    assert parsed[0][0]["warc-concurrent-to"] == parsed[1][0]["warc-record-id"]
