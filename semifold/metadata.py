"""What a search reports about each of its joins."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .plans.compiler import Action

SCHEMA = "to_indices array<string>, to_field string, from_indices array<string>, from_types array<string>, from_field string, size bigint, size_in_bytes bigint, is_pruned boolean, cache_hit boolean, terms_encoding string, order_by string, max_terms_per_shard int, took bigint"


def describe(a: Action) -> dict:
    """Runs the counts of one join; innermost joins come first in a search's list."""
    began = time.monotonic()
    out = {
        "relations": {
            "from": {"indices": list(a.join.indices) if a.join.indices else None, "types": list(a.join.types) if a.join.types else None, "field": a.join.path},
            "to": {"indices": list(a.to.indices) if a.to and a.to.indices else None, "types": list(a.to.types) if a.to and a.to.types else None, "field": a.join.field},
        },
        "size": a.terms.size if a.terms else 0,
        "size_in_bytes": a.terms.size_in_bytes if a.terms else 0,
        "is_pruned": a.terms.is_pruned if a.terms else False,
        "cache_hit": a.cache_hit,
        "terms_encoding": a.join.encoding,
    }
    if a.join.order_by:
        out["order_by"] = a.join.order_by
    if a.join.limit is not None:
        out["max_terms_per_shard"] = a.join.limit
    out["took"] = int((time.monotonic() - began) * 1000)
    return out


def to_frame(spark: SparkSession, actions: list[dict]) -> DataFrame:
    rows = [(a["relations"]["to"]["indices"], a["relations"]["to"]["field"], a["relations"]["from"]["indices"], a["relations"]["from"]["types"], a["relations"]["from"]["field"], a["size"], a["size_in_bytes"], a["is_pruned"], a["cache_hit"], a["terms_encoding"], a.get("order_by"), a.get("max_terms_per_shard"), a["took"]) for a in actions]
    return spark.createDataFrame(rows, SCHEMA)
