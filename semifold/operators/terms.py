"""Distinct values of one field over the documents that match a query."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, TermsLimitExceeded
from ..sources.catalog import IndexDef
from .joins import element

ENCODINGS = ("long", "integer", "bloom", "bytes")


@dataclass
class TermsResult:
    """``df`` has one column ``term`` and is lazy; the counts run a job when they are first read."""

    df: DataFrame
    dtype: T.DataType
    encoding: str
    hits: DataFrame | None
    limit: int | None
    distinct: bool = True

    @cached_property
    def size(self) -> int:
        return self.df.distinct().count()

    @cached_property
    def is_pruned(self) -> bool:
        """Whether a shard had more hits than the limit: hits, not distinct terms."""
        if self.limit is None or self.hits is None:
            return False
        return bool(self.hits.agg(F.coalesce(F.bool_or(F.col("hits") > self.limit), F.lit(False))).first()[0])

    @cached_property
    def size_in_bytes(self) -> int:
        """What the key set would weigh on the wire in its encoding."""
        if self.encoding == "bytes":
            n = F.length(F.col("term").cast("string").cast("binary"))
            return 9 + int(self.df.distinct().agg(F.coalesce(F.sum(n + F.when(n < 128, 1).otherwise(2)), F.lit(0))).first()[0])
        if self.encoding == "bloom":
            from ..functions.bloom import DEFAULT_FPP, optimal_bits

            return 17 + 8 * -(-optimal_bits(self.size, DEFAULT_FPP) // 64)
        return 9 + (8 if self.encoding == "long" else 5) * self.size

    def guard(self, max_terms: int) -> TermsResult:
        """Fails instead of going on with a key set over the given size; looks at no more than that many."""
        if self.df.distinct().limit(max_terms + 1).count() > max_terms:
            raise TermsLimitExceeded(f"Data too large: more than {max_terms} terms")
        return self

    def capped(self, max_terms: int) -> TermsResult:
        """The same terms; reading them fails if there are more.  Lazy, and counts no further than one beyond the bound."""
        over = self.df.distinct().limit(max_terms + 1).agg(F.count("*") > max_terms).scalar()
        fail = F.raise_error(F.lit(f"Data too large: more than {max_terms} terms")).cast("boolean")
        return replace(self, df=self.df.filter(F.when(over, fail).otherwise(F.lit(True))))


def validate(encoding: str, limit: int | None, order_by: str | None) -> None:
    if encoding not in ENCODINGS:
        raise QueryError(f"unknown termsEncoding: {encoding}")
    if encoding == "bytes" and limit is None:
        raise QueryError("termsEncoding bytes needs maxTermsPerShard")
    if order_by not in (None, "default", "doc_score"):
        raise QueryError(f"unknown orderBy: {order_by}")
    if order_by == "doc_score" and limit is None:
        raise QueryError("orderBy doc_score needs maxTermsPerShard")
    if limit is not None and limit < 0:
        raise QueryError("maxTermsPerShard must not be negative")


def _values(idx: IndexDef, field: str) -> Column:
    c = F.col(field)
    return F.explode(c) if isinstance(idx.types[field], T.ArrayType) else c


def terms_by_query(parts: list[tuple[IndexDef, DataFrame, Column]], field: str, *, encoding: str = "long", limit: int | None = None, order_by: str | None = None) -> TermsResult:
    """parts: an index, its matching documents, and their score.  Indices without the field are left out before.

    Without a limit the frame may hold repeats (a semi-join does not care); with
    one, each shard keeps its first ``limit`` distinct terms by document order,
    or the terms of its ``limit`` best-scored documents.
    """
    validate(encoding, limit, order_by)
    dtype = element(parts[0][0].types[field])
    frames, hits = [], []
    for idx, df, score in parts:
        shard = F.concat_ws("/", F.lit(idx.name), idx.shard().cast("string"))
        if limit is None:
            frames.append(df.select(_values(idx, field).alias("term")).filter("term is not null"))
            continue
        hits.append(df.select(shard.alias("shard")).groupBy("shard").agg(F.count("*").alias("hits")))
        if order_by == "doc_score":
            w = Window.partitionBy("__shard").orderBy(F.col("__score").desc(), F.col("__ord"))
            top = df.select(F.col(field), shard.alias("__shard"), score.alias("__score"), idx.order().alias("__ord")).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit)
            frames.append(top.select(_values(idx, field).alias("term")).filter("term is not null").distinct())
        else:
            first = df.select(_values(idx, field).alias("term"), shard.alias("__shard"), idx.order().alias("__ord")).filter("term is not null").groupBy("__shard", "term").agg(F.min("__ord").alias("__first"))
            w = Window.partitionBy("__shard").orderBy("__first", "term")
            frames.append(first.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).select("term"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    allhits = None
    for h in hits:
        allhits = h if allhits is None else allhits.unionByName(h)
    return TermsResult(out.distinct() if limit is not None else out, dtype, encoding, allhits, limit, limit is not None)
