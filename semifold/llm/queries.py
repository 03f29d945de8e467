"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, imatch, licenses, lm, mixing, pii, quality, simhash, suffixes, warc
from .common import load


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(load(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digest(load(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(load(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(load(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(load(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_lm": op7_lm,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
o AS (SELECT d, n, max(page_id) AS owner FROM q WHERE n >= 1000 GROUP BY d, n)
SELECT q.page_id, q.n AS payload_bytes, q.d AS payload_digest,
  CASE WHEN o.owner IS NOT NULL AND o.owner IS DISTINCT FROM q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.owner IS NOT NULL AND o.owner IS DISTINCT FROM q.page_id THEN o.owner END AS refers_to
FROM q LEFT JOIN o ON q.d = o.d AND q.n = o.n
""",
}
