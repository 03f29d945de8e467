"""The driver's queries over the star-schema tables, each built through the query language."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, EngineConfig
from .sources.catalog import Catalog

TABLES = {
    "region": {"id_col": "r_regionkey"},
    "nation": {"id_col": "n_nationkey"},
    "customer": {"id_col": "c_custkey"},
    "supplier": {"id_col": "s_suppkey"},
    "part": {"id_col": "p_partkey"},
    "orders": {"id_col": "o_orderkey"},
    "lineitem": {"order_col": "l_orderkey"},
    "events": {"id_col": "event_id", "type_col": "event_type"},
    "documents": {"id_col": "doc_id", "analyzed": ["text"]},
}


def engine(spark: SparkSession, sf_dir: str, *names: str, cache: bool = False, shards: dict | None = None) -> Engine:
    cat = Catalog(spark)
    for n in names:
        cat.register_parquet(n, os.path.join(sf_dir, f"{n}.parquet"), **TABLES[n], **({"num_shards": shards[n]} if shards and n in shards else {}))
    return Engine(cat, EngineConfig(cache_enabled=cache))


def fj(target: str, index, path: str, query=None, **more) -> dict:
    return {"filterjoin": {target: {"indices": index, "path": path, "query": query, **more}}}


def _search(names: list[str], index: str, body: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d, *names).search(body, index=index).df


def _term(f, v):
    return {"term": {f: v}}


def _range(f, **b):
    return {"range": {f: b}}


BUILDING = fj("o_custkey", ["customer"], "c_custkey", _term("c_mktsegment", "BUILDING"))


def _with_partkeys(spark, d, *names) -> Engine:
    """An index whose field holds the part keys of an order."""
    eng = engine(spark, d, "lineitem", *names)
    made = eng.catalog["lineitem"].df.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("partkeys"))
    eng.catalog.register("order_parts", made, id_col="l_orderkey")
    return eng


def multivalued_target(spark, d):
    eng = _with_partkeys(spark, d, "part")
    q = {"bool": {"must": [_term("p_brand", "Brand#2"), _range("p_size", lte=5)]}}
    return eng.search({"query": fj("partkeys", "part", "p_partkey", q), "_source": ["l_orderkey"]}, index="order_parts").df


def multivalued_source(spark, d):
    eng = _with_partkeys(spark, d, "part")
    return eng.search({"query": fj("p_partkey", "order_parts", "partkeys", _range("l_orderkey", lt=50)), "_source": ["p_partkey"]}, index="part").df


def multi_index(spark, d):
    """One lookup over two indices whose key field has one name."""
    eng = engine(spark, d, "nation", "customer", "supplier")
    for n, p in (("customer", "c"), ("supplier", "s")):
        df = eng.catalog[n].df
        eng.catalog.register(f"{n}_bal", df.select(F.col(f"{p}_nationkey").alias("nationkey"), F.col(f"{p}_acctbal").alias("acctbal"), F.lit(n).alias("kind")))
    q = {"bool": {"should": [{"bool": {"must": [_term("kind", "customer"), _range("acctbal", gt=9900)]}}, {"bool": {"must": [_term("kind", "supplier"), _range("acctbal", gt=9500)]}}]}}
    return eng.search({"query": fj("n_nationkey", ["customer_bal", "supplier_bal"], "nationkey", q), "_source": ["n_nationkey", "n_name"]}, index="nation").df


def filter_agg(spark, d):
    eng = engine(spark, d, "orders", "customer")
    body = {"aggs": {"by": {"terms": {"field": "o_orderpriority"}, "aggs": {"joined_docs": {"filter": fj("o_custkey", "customer", "c_custkey", _term("c_mktsegment", "MACHINERY"))}}}}}
    return eng.search(body, index="orders").aggs["by"].select("o_orderpriority", "joined_docs", "doc_count")


def terms_limit(spark, d):
    return engine(spark, d, "customer", shards={"customer": 3}).terms_by_query("c_nationkey", _range("c_acctbal", gt=0), "customer", max_terms_per_shard=5).df


def terms_top(spark, d):
    q = {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "o_totalprice"}}}
    return engine(spark, d, "orders", shards={"orders": 3}).terms_by_query("o_custkey", q, "orders", order_by="doc_score", max_terms_per_shard=50).df


def terms_pruned(spark, d):
    r = engine(spark, d, "customer", shards={"customer": 3}).terms_by_query("c_nationkey", _range("c_acctbal", gt=0), "customer", max_terms_per_shard=5)
    wide = engine(spark, d, "customer", shards={"customer": 3}).terms_by_query("c_nationkey", _range("c_acctbal", gt=0), "customer", max_terms_per_shard=10**7)
    return r.hits.agg(F.lit(r.is_pruned).alias("is_pruned"), F.lit(wide.is_pruned).alias("wide_is_pruned"), F.sum("hits").alias("total_hits"))


def cardinality_exact(spark, d):
    return engine(spark, d, "orders").terms_by_query("o_custkey", None, "orders").df.agg(F.count("*").alias("cardinality"))


def msearch(spark, d):
    eng = engine(spark, d, "orders", "customer", "lineitem")
    got = eng.msearch([({"index": "orders"}, {"query": fj("o_custkey", "customer", "c_custkey", _range("c_acctbal", gt=9900))}), ({"index": "orders"}, {"query": fj("o_orderkey", "lineitem", "l_orderkey", _range("l_quantity", gte=50))})])
    parts = [r.df.select(F.lit(i).alias("response"), F.col("o_orderkey").alias("id")) for i, r in enumerate(got)]
    return parts[0].unionByName(parts[1])


def exists_query(spark, d):
    return engine(spark, d, "orders", "customer").search({"query": fj("o_custkey", "customer", "c_custkey", _range("c_acctbal", gt=9000))}, index="orders").exists_frame()


def actions_metadata(spark, d):
    df = engine(spark, d, "orders", "customer").search({"query": BUILDING}, index="orders").actions_frame()
    return df.select("to_field", F.col("from_indices")[0].alias("from_index"), "from_field", "size", "is_pruned", "cache_hit", "terms_encoding")


def cardinality_approx(spark, d):
    """Whether the sketch lies within three of its standard errors of the exact count."""
    eng = engine(spark, d, "orders")
    exact = eng.terms_by_query("o_custkey", None, "orders").df.agg(F.count("*").alias("exact"))
    near = F.abs(F.col("cardinality") - F.col("exact")) <= 0.15 * F.col("exact")
    return exact.crossJoin(eng.cardinality("o_custkey", "orders")).select("exact", near.alias("near"))  # one row each


def cache_stats(spark, d):
    eng = engine(spark, d, "orders", "customer", cache=True)
    for _ in range(2):
        eng.search({"query": BUILDING}, index="orders")
    stats = eng.cache_stats()
    eng.clear_cache()
    return spark.createDataFrame([(stats["size"], stats["size_in_bytes"], stats["hit_count"], stats["miss_count"], stats["eviction_count"])], "size int, size_in_bytes bigint, hit_count int, miss_count int, eviction_count int")


def index_version(spark, d):
    """An index keeps its version while nothing is written, and every write changes it."""
    eng = engine(spark, d, "orders", "customer")
    df = eng.catalog["customer"].df
    rows = [("orders", eng.index_version("orders") == engine(spark, d, "orders").index_version("orders"))]
    eng.catalog.register("customer", df, id_col="c_custkey")
    before = eng.index_version("customer")
    eng.catalog.register("customer", df.filter("c_custkey < 100"), id_col="c_custkey")
    return spark.createDataFrame([*rows, ("customer", eng.index_version("customer") == before)], "index string, stable boolean")


def cache_staleness(spark, d):
    """What a join finds before and after a write to an index that only a nested join reads."""
    eng = engine(spark, d, "orders", "customer", "nation", cache=True)
    q = {"query": fj("o_custkey", "customer", "c_custkey", fj("c_nationkey", "nation", "n_nationkey", _range("n_nationkey", lt=5)))}
    rows = [(0, eng.search(q, index="orders").total)]
    eng.catalog.register("nation", eng.catalog["nation"].df.filter("n_nationkey = 3"), id_col="n_nationkey")
    again = eng.search(q, index="orders")
    rows.append((1, again.total))
    hits = eng.cache_stats()["hit_count"]
    eng.clear_cache()
    return spark.createDataFrame([(i, n, hits) for i, n in rows], "write int, total bigint, hit_count int")


def all_indices(spark, d):
    """A lookup that names no index reads all that have the field."""
    eng = engine(spark, d, "nation")
    for n, p in (("customer", "c"), ("supplier", "s")):
        df = spark.read.parquet(os.path.join(d, f"{n}.parquet"))
        eng.catalog.register(f"{n}_bal", df.select(F.col(f"{p}_nationkey").alias("nationkey"), F.col(f"{p}_acctbal").alias("acctbal")))
    return eng.search({"query": fj("n_nationkey", None, "nationkey", _range("acctbal", gt=9950)), "_source": ["n_nationkey"]}, index="nation").df


def alias_terms(spark, d):
    eng = engine(spark, d, "customer")
    eng.catalog.alias("builders", "customer", F.col("c_mktsegment") == "BUILDING")
    return eng.terms_by_query("c_nationkey", _range("c_acctbal", gt=9000), "builders").df


def guard(spark, d):
    """Key sets at and over a limit of terms."""
    from .errors import TermsLimitExceeded

    def passes(limit):
        try:
            engine(spark, d, "customer").terms_by_query("c_nationkey", None, "customer", max_terms=limit)
        except TermsLimitExceeded:
            return False
        return True

    return spark.createDataFrame([(n, passes(n)) for n in (10**6, 2)], "max_terms int, passes boolean")


def _refused(made) -> bool:
    from .errors import QueryError

    try:
        made()
    except QueryError:
        return True
    return False


def terms_validation(spark, d):
    eng = engine(spark, d, "customer")
    bad = {"bytes_unlimited": {"encoding": "bytes"}, "score_unlimited": {"order_by": "doc_score"}, "unknown_encoding": {"encoding": "odd"}, "negative": {"max_terms_per_shard": -1}, "fine": {"encoding": "integer"}}
    return spark.createDataFrame([(n, _refused(lambda k=k: eng.terms_by_query("c_nationkey", None, "customer", **k))) for n, k in bad.items()], "request string, refused boolean")


def parser_validation(spark, d):
    eng = engine(spark, d, "customer")
    bad = {
        "no_path": {"filterjoin": {"c_custkey": {"indices": ["customer"]}}},
        "odd_key": {"filterjoin": {"c_custkey": {"path": "c_custkey", "odd": 1}}},
        "no_cache_key": {"fielddata_terms": {"c_custkey": {"value": [1]}}},
        "no_value": {"termsenum_terms": {"c_custkey": {"_cache_key": 1}}},
        "unknown": {"nothing": {}},
        "fine": _term("c_custkey", 1),
    }
    return spark.createDataFrame([(n, _refused(lambda q=q: eng.search({"query": q}, index="customer"))) for n, q in bad.items()], "request string, refused boolean")


def actions_order(spark, d):
    """Nested joins are reported innermost first."""
    eng = engine(spark, d, "orders", "customer", "nation")
    q = fj("o_custkey", "customer", "c_custkey", fj("c_nationkey", "nation", "n_nationkey", _range("n_nationkey", lt=5)))
    got = eng.search({"query": q}, index="orders").actions
    return spark.createDataFrame([(i, a["relations"]["from"]["field"], a["size"]) for i, a in enumerate(got)], "place int, from_field string, size bigint")


def wrapper(spark, d):
    import base64
    import json

    body = base64.b64encode(json.dumps(BUILDING).encode()).decode()
    return engine(spark, d, "orders", "customer").search({"query": {"wrapper": {"query": body}}, "_source": ["o_orderkey"]}, index="orders").df


def uri(spark, d):
    return engine(spark, d, "orders").search(q='o_orderstatus:F AND o_orderpriority:"1-URGENT"', index="orders").df.select("o_orderkey")


def template(spark, d):
    source = '{"query": {"filterjoin": {"o_custkey": {"indices": ["customer"], "path": "c_custkey", "query": {"term": {"c_mktsegment": "{{segment}}"}}}}}, "_source": ["o_orderkey"]}'
    return engine(spark, d, "orders", "customer").search_template(source, {"segment": "FURNITURE"}, index="orders").df


def builders(spark, d):
    from .plans.builders import QueryBuilders as Q

    q = Q.filter_join("o_custkey").indices("customer").path("c_custkey").query(_range("c_acctbal", lt=0)).build()
    return engine(spark, d, "orders", "customer").search({"query": q, "_source": ["o_orderkey"]}, index="orders").df


def text_score(spark, d):
    hits = engine(spark, d, "documents").search({"query": _term("text", "hein")}, index="documents", score=True).df
    return hits.select("doc_id", F.round("_score", 4).alias("score"))


def constant(spark, d):
    hits = engine(spark, d, "customer").search({"query": {"constant_score": {"filter": _range("c_acctbal", gt=9000), "boost": 2.0}}}, index="customer", score=True).df
    return hits.select("c_custkey", "_score")


def join_score(spark, d):
    """A filter join scores a constant."""
    return engine(spark, d, "orders", "customer").search({"query": BUILDING}, index="orders", score=True).df.select("o_orderkey", "_score")


def metric_aggs(spark, d):
    aggs = {"n": {"terms": {"field": "c_mktsegment"}, "aggs": {"top": {"max": {"field": "c_acctbal"}}, "low": {"min": {"field": "c_acctbal"}}, "many": {"value_count": {"field": "c_custkey"}}}}}
    return engine(spark, d, "customer").search({"aggs": aggs}, index="customer").aggs["n"]


def bloom_sketch(spark, d):
    """No false negative, few false positives, and an estimate near the exact count."""
    from .functions.bloom import DEFAULT_FPP, Bloom

    keys = spark.read.parquet(os.path.join(d, "orders.parquet")).select(F.col("o_orderkey").cast("long").alias("k"))
    n = keys.distinct().count()
    b = Bloom.of(keys.filter("k % 2 = 0"), "k", n).merge(Bloom.of(keys.filter("k % 2 <> 0"), "k", n))
    inside = [r[0] for r in keys.limit(500).collect()]
    false = sum(b.might_contain(-1 - i) for i in range(2000)) / 2000
    return spark.createDataFrame([(all(b.might_contain(k) for k in inside), false <= 2 * DEFAULT_FPP, abs(b.estimate() - n) <= 0.05 * n)], "none_missed boolean, few_false boolean, estimate_near boolean")


def filters_agg(spark, d):
    """Joins as the tests of named buckets, with a metric in each."""
    buckets = {"building": BUILDING, "urgent": _term("o_orderpriority", "1-URGENT"), "none": _term("o_orderstatus", "X")}
    body = {"aggs": {"b": {"filters": {"filters": buckets}, "aggs": {"top": {"max": {"field": "o_totalprice"}}}}}}
    return engine(spark, d, "orders", "customer").search(body, index="orders").aggs["b"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fj_basic": _search(["orders", "customer"], "orders", {"query": BUILDING, "_source": ["o_orderkey", "o_custkey", "o_totalprice"]}),
    "fj_reverse": _search(["orders", "customer"], "customer", {"query": fj("c_custkey", "orders", "o_custkey", _range("o_totalprice", gt=400000)), "_source": ["c_custkey", "c_name"]}),
    "fj_string_key": _search(["orders", "lineitem"], "orders", {"query": fj("o_orderstatus", "lineitem", "l_linestatus", _range("l_quantity", gte=50)), "_source": ["o_orderkey"]}),
    "fj_date_key": _search(["orders", "lineitem"], "orders", {"query": fj("o_orderdate", "lineitem", "l_shipdate", {"bool": {"must": [_term("l_returnflag", "R"), _range("l_quantity", gte=50)]}}), "_source": ["o_orderkey", "o_orderdate"]}),
    "fj_multivalued_target": multivalued_target,
    "fj_multivalued_source": multivalued_source,
    "fj_must_not": _search(["orders", "customer"], "customer", {"query": {"bool": {"must_not": [fj("c_custkey", "orders", "o_custkey", _term("o_orderstatus", "F"))]}}, "_source": ["c_custkey"]}),
    "fj_and": _search(["orders", "customer", "lineitem"], "orders", {"query": {"bool": {"filter": [fj("o_custkey", "customer", "c_custkey", _range("c_acctbal", gt=9000)), fj("o_orderkey", "lineitem", "l_orderkey", _range("l_quantity", gte=45))]}}, "_source": ["o_orderkey"]}),
    "fj_or": _search(["orders", "customer", "lineitem"], "orders", {"query": {"bool": {"should": [fj("o_custkey", "customer", "c_custkey", _range("c_acctbal", gt=9500)), fj("o_orderkey", "lineitem", "l_orderkey", _range("l_quantity", gte=50))]}}, "_source": ["o_orderkey"]}),
    "fj_nested": _search(["lineitem", "orders", "customer", "nation", "region"], "lineitem", {"query": fj("l_orderkey", "orders", "o_orderkey", fj("o_custkey", "customer", "c_custkey", fj("c_nationkey", "nation", "n_nationkey", fj("n_regionkey", "region", "r_regionkey", _term("r_name", "AFRICA"))))), "_source": ["l_orderkey", "l_linenumber"]}),
    "fj_indirect_self": _search(["orders", "customer"], "orders", {"query": fj("o_custkey", "customer", "c_custkey", fj("c_custkey", "orders", "o_custkey", _range("o_totalprice", gt=450000))), "_source": ["o_orderkey"]}),
    "fj_multi_index": multi_index,
    "fj_types": _search(["customer", "events"], "customer", {"query": fj("c_custkey", "events", "user_id", _range("value", gt=50), types=["purchase", "error"]), "_source": ["c_custkey"]}),
    "fj_null_query": _search(["customer", "orders"], "customer", {"query": fj("c_custkey", "orders", "o_custkey", None), "_source": ["c_custkey"]}),
    "fj_in_filter_agg": filter_agg,
    "fj_integer_encoding": _search(["lineitem", "part"], "lineitem", {"query": fj("l_partkey", "part", "p_partkey", _term("p_size", 11), termsEncoding="integer"), "_source": ["l_orderkey", "l_linenumber"]}),
    "fj_bloom_verified": _search(["lineitem", "supplier"], "lineitem", {"query": fj("l_suppkey", "supplier", "s_suppkey", _range("s_acctbal", lt=0), termsEncoding="bloom"), "_source": ["l_orderkey", "l_linenumber"]}),
    "fj_bytes": _search(["part"], "part", {"query": fj("p_name", "part", "p_name", _range("p_partkey", lt=5), termsEncoding="bytes", maxTermsPerShard=1000), "_source": ["p_partkey", "p_name"]}),
    "terms_literal": _search(["orders"], "orders", {"query": {"fielddata_terms": {"o_orderkey": {"value": [3, 9, 27, 32, 33, 64, 96, 100, 5000], "_cache_key": 1}}}, "_source": ["o_orderkey"]}),
    "terms_by_query": lambda s, d: engine(s, d, "orders").terms_by_query("o_custkey", _term("o_orderstatus", "F"), "orders").df,
    "terms_limit_default": terms_limit,
    "terms_top_score": terms_top,
    "terms_pruned_flag": terms_pruned,
    "cardinality_exact": cardinality_exact,
    "q_range": _search(["orders"], "orders", {"query": _range("o_totalprice", gte=100000, lte=100500), "_source": ["o_orderkey", "o_totalprice"]}),
    "q_bool": _search(["orders"], "orders", {"query": {"bool": {"must": [_term("o_orderstatus", "F"), {"bool": {"should": [_term("o_orderpriority", "1-URGENT"), _range("o_totalprice", gt=400000)]}}], "must_not": [_range("o_orderdate", lt="1995-01-01")]}}, "_source": ["o_orderkey"]}),
    "q_text_term": _search(["documents"], "documents", {"query": _term("text", "hein"), "_source": ["doc_id"]}),
    "fj_sorted_page": _search(["orders", "customer"], "orders", {"query": BUILDING, "sort": [{"o_totalprice": "desc"}, "o_orderkey"], "size": 10, "_source": ["o_orderkey", "o_totalprice"]}),
    "msearch": msearch,
    "search_exists": exists_query,
    "actions_metadata": actions_metadata,
    "cardinality_approx": cardinality_approx,
    "cache_stats": cache_stats,
    "index_version": index_version,
    "cache_staleness": cache_staleness,
    "fj_all_indices": all_indices,
    "fj_post_filter": _search(["orders", "customer"], "orders", {"query": _term("o_orderstatus", "F"), "post_filter": BUILDING, "_source": ["o_orderkey"]}),
    "terms_literal_enum": _search(["customer"], "customer", {"query": {"termsenum_terms": {"c_name": {"value": ["Customer#000000007", "Customer#000000011", "nobody"], "_cache_key": 2}}}, "_source": ["c_custkey"]}),
    "terms_alias": alias_terms,
    "terms_guard": guard,
    "terms_validation": terms_validation,
    "parser_validation": parser_validation,
    "actions_order": actions_order,
    "q_terms": _search(["orders"], "orders", {"query": {"terms": {"o_orderpriority": ["1-URGENT", "5-LOW"]}}, "_source": ["o_orderkey"]}),
    "q_filtered": _search(["orders", "customer"], "orders", {"query": {"filtered": {"query": _range("o_totalprice", gt=100000), "filter": BUILDING}}, "_source": ["o_orderkey"]}),
    "q_constant_score": constant,
    "q_wrapper": wrapper,
    "q_uri": uri,
    "q_text_score": text_score,
    "fj_score": join_score,
    "search_template": template,
    "search_builders": builders,
    "search_aggs": metric_aggs,
    "bloom_sketch": bloom_sketch,
    "fj_in_filters_agg": filters_agg,
}

ORACLE_SQL: dict[str, str] = {
    "fj_basic": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')",
    "fj_reverse": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "fj_string_key": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN (SELECT l_linestatus FROM lineitem WHERE l_quantity >= 50)",
    "fj_date_key": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (SELECT l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50)",
    "fj_multivalued_target": "WITH d AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS partkeys FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM d WHERE list_has_any(partkeys, (SELECT list(p_partkey) FROM part WHERE p_brand = 'Brand#2' AND p_size <= 5))",
    "fj_multivalued_source": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT unnest(partkeys) FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS partkeys FROM lineitem GROUP BY l_orderkey) d WHERE l_orderkey < 50)",
    "fj_must_not": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "fj_and": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 9000) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 45)",
    "fj_or": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 9500) OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 50)",
    "fj_nested": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA'))))",
    "fj_indirect_self": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))",
    "fj_multi_index": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)",
    "fj_types": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'error') AND value > 50)",
    "fj_null_query": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "fj_in_filter_agg": "SELECT o_orderpriority, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) AS joined_docs, count(*) AS doc_count FROM orders GROUP BY o_orderpriority",
    "fj_integer_encoding": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 11)",
    "fj_bloom_verified": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
    "fj_bytes": "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey < 5)",
    "terms_literal": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 9, 27, 32, 33, 64, 96, 100, 5000)",
    "terms_by_query": "SELECT DISTINCT o_custkey AS term FROM orders WHERE o_orderstatus = 'F'",
    "terms_limit_default": "WITH t AS (SELECT c_custkey % 3 AS shard, c_nationkey AS term, min(c_custkey) AS first_doc FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2), r AS (SELECT term, row_number() OVER (PARTITION BY shard ORDER BY first_doc, term) AS rn FROM t) SELECT DISTINCT term FROM r WHERE rn <= 5",
    "terms_top_score": "WITH d AS (SELECT o_custkey AS term, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT DISTINCT term FROM d WHERE rn <= 50",
    "terms_pruned_flag": "SELECT bool_or(hits > 5) AS is_pruned, bool_or(hits > 10000000) AS wide_is_pruned, sum(hits) AS total_hits FROM (SELECT c_custkey % 3 AS shard, count(*) AS hits FROM customer WHERE c_acctbal > 0 GROUP BY 1) s",
    "cardinality_exact": "SELECT count(DISTINCT o_custkey) AS cardinality FROM orders",
    "q_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 100500",
    "q_bool": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 400000) AND NOT (o_orderdate < TIMESTAMP '1995-01-01')",
    "q_text_term": r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])hein([^\p{L}\p{N}_]|$)')",
    "fj_sorted_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "msearch": "SELECT 0 AS response, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900) UNION ALL SELECT 1 AS response, o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)",
    "search_exists": "SELECT count(*) > 0 AS exists_flag FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "actions_metadata": "SELECT 'o_custkey' AS to_field, 'customer' AS from_index, 'c_custkey' AS from_field, count(DISTINCT c_custkey) AS size, false AS is_pruned, false AS cache_hit, 'long' AS terms_encoding FROM customer WHERE c_mktsegment = 'BUILDING'",
    "cardinality_approx": "SELECT count(DISTINCT o_custkey) AS exact, true AS near FROM orders",
    "cache_stats": "SELECT 1 AS size, 9 + 8 * count(DISTINCT c_custkey) AS size_in_bytes, 1 AS hit_count, 1 AS miss_count, 0 AS eviction_count FROM customer WHERE c_mktsegment = 'BUILDING'",
    "index_version": "SELECT * FROM (VALUES ('orders', true), ('customer', false)) v(index, stable)",
    "cache_staleness": "SELECT 0 AS write, count(*) AS total, 0 AS hit_count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5 UNION ALL SELECT 1, count(*), 0 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    "fj_all_indices": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9950)",
    "fj_post_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "terms_literal_enum": "SELECT c_custkey FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000011', 'nobody')",
    "terms_alias": "SELECT DISTINCT c_nationkey AS term FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000",
    "terms_guard": "SELECT m AS max_terms, n <= m AS passes FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer) c, (VALUES (1000000), (2)) v(m)",
    "terms_validation": "SELECT * FROM (VALUES ('bytes_unlimited', true), ('score_unlimited', true), ('unknown_encoding', true), ('negative', true), ('fine', false)) v(request, refused)",
    "parser_validation": "SELECT * FROM (VALUES ('no_path', true), ('odd_key', true), ('no_cache_key', true), ('no_value', true), ('unknown', true), ('fine', false)) v(request, refused)",
    "actions_order": "SELECT 0 AS place, 'n_nationkey' AS from_field, count(*) AS size FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 1, 'c_custkey', count(DISTINCT c_custkey) FROM customer WHERE c_nationkey < 5",
    "q_terms": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "q_filtered": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "q_constant_score": "SELECT c_custkey, CAST(2 AS DOUBLE) AS _score FROM customer WHERE c_acctbal > 9000",
    "q_wrapper": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "q_uri": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "q_text_score": r"WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'hein')) AS tf FROM t), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE tf > 0) AS df FROM d) SELECT doc_id, round(sqrt(tf) * pow(1 + ln(s.n / (s.df + 1)), 2) / sqrt(d.n), 4) AS score FROM d, s WHERE tf > 0",
    "fj_score": "SELECT o_orderkey, CAST(1 AS DOUBLE) AS _score FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "search_template": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')",
    "search_builders": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "search_aggs": "SELECT c_mktsegment, count(*) AS doc_count, max(c_acctbal) AS top, min(c_acctbal) AS low, count(c_custkey) AS many FROM customer GROUP BY 1",
    "fj_in_filters_agg": "SELECT 'building' AS bucket, count(*) AS doc_count, max(o_totalprice) AS top FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'urgent', count(*), max(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'none', count(*), max(o_totalprice) FROM orders WHERE o_orderstatus = 'X'",
    "bloom_sketch": "SELECT true AS none_missed, true AS few_false, true AS estimate_near",
}
