"""The search API: coordinate search, multi-search, terms, cache administration."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache import DEFAULT_CAPACITY, TermsCache
from .errors import QueryError
from .metadata import describe, to_frame
from .operators.terms import TermsResult, terms_by_query
from .plans import dsl
from .plans.compiler import Action, Compiler
from .sources.catalog import Catalog, IndexDef

BODY_KEYS = {"query", "post_filter", "_source", "fields", "sort", "from", "size", "aggs", "aggregations", "track_scores"}


@dataclass(frozen=True)
class EngineConfig:
    cache_enabled: bool = True
    cache_size: int = DEFAULT_CAPACITY
    #: A search fails, when it runs, if the key set of one of its joins has more distinct terms.
    max_join_terms: int | None = None


@dataclass
class SearchResult:
    """``df``: the hits.  Everything is lazy; ``actions`` and ``total`` run jobs when they are read."""

    df: DataFrame
    matched: DataFrame
    joins: list[Action] = field(default_factory=list)
    aggs: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def actions(self) -> list[dict]:
        return [describe(a) for a in self.joins]

    @cached_property
    def total(self) -> int:
        return self.matched.count()

    def actions_frame(self) -> DataFrame:
        return to_frame(self.df.sparkSession, self.actions)

    def exists(self) -> bool:
        return not self.matched.limit(1).isEmpty()

    def exists_frame(self) -> DataFrame:
        return self.matched.limit(1).agg((F.count("*") > 0).alias("exists_flag"))


@dataclass
class SearchError:
    """An item of a multi-search that failed; the other items are not touched by it."""

    error: Exception


class Engine:
    def __init__(self, catalog: Catalog, config: EngineConfig | None = None):
        self.catalog = catalog
        self.config = config or EngineConfig()
        self.cache = TermsCache(self.config.cache_size if self.config.cache_enabled else 0)

    def _compiler(self) -> Compiler:
        return Compiler(self.catalog, self.cache if self.cache.capacity > 0 else None, self.config.max_join_terms)

    # ---- search ---------------------------------------------------------

    def search(self, body=None, index=None, types=None, q: str | None = None, score: bool = False) -> SearchResult:
        """body: a dict or JSON text. q: the URI form, which plans no joins. score: adds ``_score``."""
        body = {"query": dsl.parse_uri(q)} if q is not None else dsl.decode(body)
        if extra := set(body) - BODY_KEYS:
            raise QueryError(f"a search body does not know {sorted(extra)}")
        comp = self._compiler()
        indices = self.catalog.resolve(index)
        types = [types] if isinstance(types, str) else types
        hits, matched = None, None
        aggs: dict[str, DataFrame] = {}
        for idx in indices:
            df = comp.filter(idx, idx.typed(types), body.get("query"))
            for name, spec in (body.get("aggs") or body.get("aggregations") or {}).items():
                if len(indices) > 1:
                    raise QueryError("aggregations need one index")
                aggs[name] = self._agg(comp, idx, df, name, spec)
            df = comp.filter(idx, df, body.get("post_filter"))
            page = df.withColumn("_score", comp.score(idx, body.get("query"))) if score or "_score" in str(body.get("sort", "")) else df
            if len(indices) > 1:
                page = page.withColumn("_index", F.lit(idx.name))
            matched = df if matched is None else matched.unionByName(df, allowMissingColumns=True)
            hits = page if hits is None else hits.unionByName(page, allowMissingColumns=True)
        if hits is None:
            raise QueryError("no index to search")
        return SearchResult(self._page(hits, body), matched, comp.actions, aggs)

    @staticmethod
    def _page(df: DataFrame, body: dict) -> DataFrame:
        sort = body.get("sort")
        if sort:
            order: list[Column] = []
            for s in sort if isinstance(sort, list) else [sort]:
                (name, how), = ({s: "desc" if s == "_score" else "asc"} if isinstance(s, str) else s).items()
                how = how.get("order", "asc") if isinstance(how, dict) else how
                order.append(F.col(name).desc_nulls_last() if how == "desc" else F.col(name).asc_nulls_last())
            df = df.orderBy(*order)
        if body.get("from"):
            df = df.offset(int(body["from"]))
        if body.get("size") is not None:
            df = df.limit(int(body["size"]))
        wanted = body.get("_source", body.get("fields"))
        if isinstance(wanted, (list, str)):
            wanted = [wanted] if isinstance(wanted, str) else wanted
            df = df.select(*[c for c in wanted if c in df.columns])
        return df

    def _agg(self, comp: Compiler, idx: IndexDef, df: DataFrame, name: str, spec: dict) -> DataFrame:
        """terms, filter, filters and single-value metrics; the first three may hold metrics and filters below them."""
        subs = spec.get("aggs") or spec.get("aggregations") or {}
        if "terms" in spec:
            key = spec["terms"]["field"]
            outs = [F.count("*").alias("doc_count")]
            for sub, s in subs.items():
                df, c = self._metric(comp, idx, df, s)
                outs.append(c.alias(sub))
            out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*outs)
            if "size" in spec["terms"]:
                out = out.orderBy(F.col("doc_count").desc(), F.col(key)).limit(int(spec["terms"]["size"]))
            return out
        if "filter" in spec and subs:
            df = comp.filter(idx, df, spec["filter"])
            outs = [F.count("*").alias("doc_count")]
            for sub, s in subs.items():
                df, c = self._metric(comp, idx, df, s)
                outs.append(c.alias(sub))
            return df.agg(*outs)
        if "filters" in spec:
            named = spec["filters"]["filters"]
            tests = []
            for bucket, q in named.items():
                df, p = comp.predicate(idx, df, q)
                tests.append(F.when(F.coalesce(p, F.lit(False)), F.lit(bucket)))
            outs = [F.count("*").alias("doc_count")]
            for sub, s in subs.items():
                df, c = self._metric(comp, idx, df, s)
                outs.append(c.alias(sub))
            out = df.withColumn("bucket", F.explode(F.array_compact(F.array(*tests)))).groupBy("bucket").agg(*outs)
            # Buckets without documents are listed too; there are as many as the request names.
            buckets = df.sparkSession.createDataFrame([(b,) for b in named], "bucket string")
            return buckets.join(out, "bucket", "left").fillna(0, ["doc_count"])
        df, c = self._metric(comp, idx, df, spec)
        return df.agg(c.alias(name))

    @staticmethod
    def _metric(comp: Compiler, idx: IndexDef, df: DataFrame, spec: dict) -> tuple[DataFrame, Column]:
        (kind, body), = ((k, v) for k, v in spec.items() if k not in ("aggs", "aggregations"))
        if kind == "filter":
            df, p = comp.predicate(idx, df, body)
            return df, F.count_if(F.coalesce(p, F.lit(False)))
        made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "value_count": F.count, "cardinality": F.approx_count_distinct}
        if kind not in made:
            raise QueryError(f"unknown aggregation: {kind}")
        return df, made[kind](F.col(body["field"]))

    def search_template(self, source, params: dict, **kw) -> SearchResult:
        return self.search(dsl.render_template(source, params), **kw)

    def msearch(self, items: list) -> list[SearchResult | SearchError]:
        """items: bodies, or (header, body) pairs with ``index``/``type`` in the header; planned in order over one cache."""
        out: list[SearchResult | SearchError] = []
        for item in items:
            header, body = item if isinstance(item, tuple) else ({}, item)
            try:
                out.append(self.search(body, index=header.get("index"), types=header.get("type", header.get("types"))))
            except Exception as e:  # one bad item does not stop the others
                out.append(SearchError(e))
        return out

    def msearch_ndjson(self, text: str) -> list[SearchResult | SearchError]:
        import json

        lines = [x for x in text.split("\n") if x.strip()]
        if len(lines) % 2:
            raise QueryError("multi-search needs pairs of header and body lines")
        return self.msearch([(json.loads(h), b) for h, b in zip(lines[::2], lines[1::2], strict=True)])

    def exists(self, body=None, index=None, types=None) -> bool:
        return self.search(body, index, types).exists()

    # ---- terms ----------------------------------------------------------

    def terms_by_query(self, field: str, query=None, index=None, types=None, encoding: str = "long", order_by: str | None = None, max_terms_per_shard: int | None = None, max_terms: int | None = None, routing=None, preference=None) -> TermsResult:
        """Distinct values of a field.  routing and preference are accepted and have no effect."""
        comp = self._compiler()
        query = dsl.unwrap(query)
        types = [types] if isinstance(types, str) else types
        indices = [i for i in self.catalog.resolve(index) if i.has(field)]
        if not indices:
            raise QueryError(f"no index has the field {field}")
        parts = [(i, comp.filter(i, i.typed(types), query), comp.score(i, query) if order_by == "doc_score" else F.lit(1.0)) for i in indices]
        made = terms_by_query(parts, field, encoding=encoding, limit=max_terms_per_shard, order_by=order_by)
        made = TermsResult(made.df.distinct(), made.dtype, made.encoding, made.hits, made.limit, True)
        return made.guard(max_terms) if max_terms is not None else made

    def cardinality(self, field: str, index=None, types=None, rsd: float = 0.05) -> DataFrame:
        types = [types] if isinstance(types, str) else types
        out = None
        for i in self.catalog.resolve(index):
            if i.has(field):
                part = i.typed(types).select(F.col(field).alias("term"))
                out = part if out is None else out.unionByName(part)
        if out is None:
            raise QueryError(f"no index has the field {field}")
        return out.agg(F.approx_count_distinct("term", rsd).alias("cardinality"))

    # ---- administration -------------------------------------------------

    def clear_cache(self) -> None:
        self.cache.clear()

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def index_version(self, index=None) -> str:
        return self.catalog.versions(index)
