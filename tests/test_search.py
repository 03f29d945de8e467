"""Small fixtures with known answers: join semantics, pruning, metadata, cache, validation."""

import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from semifold import Catalog, Engine, EngineConfig, SearchError
from semifold.errors import QueryError, TermsLimitExceeded, UnsupportedTypeError
from semifold.functions.bloom import Bloom
from semifold.plans import QueryBuilders as Q
from semifold.plans.dsl import unwrap
from semifold.queries import fj

PAPERS = [("p10", 10, [21, 23]), ("p11", 11, []), ("p12", 12, None), ("p13", 13, [22]), ("p14", 14, [23, 24, 24]), ("p15", 15, [99])]
AUTHORS = [("a21", 21, "red"), ("a22", 22, "blue"), ("a23", 23, "red"), ("a24", 24, "green"), ("a25", 25, "red")]


def two(spark, key="int", **cfg) -> Engine:
    conv = str if key == "string" else int
    cat = Catalog(spark)
    papers = [(i, conv(a), None if b is None else [conv(x) for x in b]) for i, a, b in PAPERS]
    cat.register("papers", spark.createDataFrame(papers, f"_id string, id {key}, written_by array<{key}>"), id_col="_id")
    cat.register("authors", spark.createDataFrame([(i, conv(a), t) for i, a, t in AUTHORS], f"_id string, id {key}, team string"), id_col="_id", analyzed=["team"])
    return Engine(cat, EngineConfig(**(cfg or {"cache_enabled": False})))


def ids(result) -> list:
    return sorted(r["_id"] for r in result.df.select("_id").collect())


def team(v):
    return {"term": {"team": v}}


@pytest.mark.parametrize("key", ["string", "int", "bigint"])
@pytest.mark.parametrize("extra", [{}, {"termsEncoding": "integer"}, {"termsEncoding": "bloom"}, {"termsEncoding": "bytes", "maxTermsPerShard": 1000}])
def test_basic_empty_reverse(spark, key, extra):
    e = two(spark, key)
    assert ids(e.search({"query": fj("written_by", "authors", "id", team("red"), **extra)}, "papers")) == ["p10", "p14"]
    assert ids(e.search({"query": fj("written_by", "authors", "id", team("nobody"), **extra)}, "papers")) == []
    assert ids(e.search({"query": fj("id", "papers", "written_by", {"term": {"id": 14}}, **extra)}, "authors")) == ["a23", "a24"]
    for none in (11, 12, 15):
        assert ids(e.search({"query": fj("id", "papers", "written_by", {"term": {"id": none}}, **extra)}, "authors")) == []


def test_boolean_composition(spark):
    e = two(spark)
    j = fj("written_by", "authors", "id", team("red"))
    late = {"range": {"id": {"gte": 13}}}
    assert ids(e.search({"query": {"bool": {"must_not": [j]}}}, "papers")) == ["p11", "p12", "p13", "p15"]
    assert ids(e.search({"query": {"bool": {"should": [j, {"term": {"id": 12}}]}}}, "papers")) == ["p10", "p12", "p14"]
    assert ids(e.search({"query": {"bool": {"must_not": [{"bool": {"should": [j, late]}}]}}}, "papers")) == ["p11", "p12"]
    assert ids(e.search({"query": {"bool": {"filter": [j, late]}}}, "papers")) == ["p14"]
    assert ids(e.search({"query": {"filtered": {"query": {"match_all": {}}, "filter": j}}}, "papers")) == ["p10", "p14"]
    assert ids(e.search({"query": {"constant_score": {"filter": j}}}, "papers")) == ["p10", "p14"]
    assert ids(e.search({"query": {"match_all": {}}, "post_filter": j}, "papers")) == ["p10", "p14"]


def test_wrapper_uri_template_builder(spark):
    e = two(spark)
    j = Q.filter_join("written_by").indices("authors").types("t").path("id").query(team("red")).routing("x").filter_name("n").boost(2).build()
    w = {"wrapper": {"query": base64.b64encode(json.dumps(j).encode()).decode()}}
    assert unwrap(w) == j
    assert ids(e.search({"query": w}, "papers")) == ["p10", "p14"]
    r = e.search(q="team:red", index="authors")
    assert ids(r) == ["a21", "a23", "a25"] and r.actions == []
    t = '{"query": {"filterjoin": {"written_by": {"indices": ["authors"], "path": "id", "query": {"term": {"team": "{{v}}"}}}}}}'
    assert ids(e.search_template(t, {"v": "blue"}, index="papers")) == ["p13"]
    with pytest.raises(QueryError):
        e.search_template(t, {}, index="papers")


def test_unknown_fields_join_nothing(spark):
    e = two(spark)
    assert ids(e.search({"query": fj("no_field", "authors", "id")}, "papers")) == []
    assert ids(e.search({"query": fj("written_by", "authors", "no_field")}, "papers")) == []
    assert len(ids(e.search({"query": {"bool": {"must_not": [fj("no_field", "authors", "id")]}}}, "papers"))) == len(PAPERS)


def test_range_lookups(spark):
    e = two(spark, cache_enabled=True)
    for lo, hi, want in ((22, 24, ["p10", "p13", "p14"]), (26, 98, []), (21, 21, ["p10"])):
        r = e.search({"query": fj("written_by", "authors", "id", {"range": {"id": {"gte": lo, "lte": hi}}})}, "papers")
        assert ids(r) == want and r.actions[0]["cache_hit"] is False
    e.clear_cache()


def test_nested_and_self(spark):
    e = two(spark)
    e.catalog.register("leaders", spark.createDataFrame([(21, [7]), (22, [8, 9]), (23, None), (24, [9])], "id int, leads array<int>"))
    e.catalog.register("groups", spark.createDataFrame([(7, "bio"), (8, "law"), (9, "bio")], "gid int, topic string"), id_col="gid")
    e.catalog["leaders"].id_col = "id"
    q = {"bool": {"filter": [fj("written_by", "leaders", "id", fj("leads", "groups", "gid", {"term": {"topic": "bio"}})), {"range": {"id": {"lt": 14}}}]}}
    r = e.search({"query": q}, "papers")
    assert ids(r) == ["p10", "p13"]
    a, b = r.actions
    assert (a["relations"]["from"]["field"], a["relations"]["to"]["field"], a["size"]) == ("gid", "leads", 2)
    assert (b["relations"]["from"]["indices"], b["relations"]["to"]["indices"], b["size"]) == (["leaders"], None, 3)
    two_hops = fj("written_by", "authors", "id", fj("id", "papers", "written_by", {"term": {"id": 14}}))
    assert ids(e.search({"query": two_hops}, "papers")) == ["p10", "p14"]


def test_types_and_many_indices(spark):
    cat = Catalog(spark)
    cat.register("papers", spark.createDataFrame(PAPERS, "_id string, id int, written_by array<int>"), id_col="_id")
    staff = [("writer", 21, "red"), ("writer", 22, "blue"), ("editor", 23, "red"), ("guest", 24, "red")]
    cat.register("staff", spark.createDataFrame(staff, "role string, id int, team string"), type_col="role")
    e = Engine(cat, EngineConfig(cache_enabled=False))
    assert ids(e.search({"query": fj("written_by", "staff", "id", team("red"), types=["editor"])}, "papers")) == ["p10", "p14"]
    assert ids(e.search({"query": fj("written_by", "staff", "id", team("blue"), types=["writer", "guest"])}, "papers")) == ["p13"]
    assert ids(e.search({"query": fj("written_by", "staff", "id", team("blue"), types=["guest"])}, "papers")) == []
    cat.register("extern", spark.createDataFrame([(99, "red")], "id int, team string"))
    assert ids(e.search({"query": fj("written_by", ["staff", "extern"], "id", team("red"))}, "papers")) == ["p10", "p14", "p15"]
    assert ids(e.search({"query": fj("written_by", None, "id", team("red"))}, "papers")) == ["p10", "p14", "p15"]


def test_score_order_pruning_and_metadata(spark):
    e = two(spark, cache_enabled=True)
    bios = [(22, "tea tea milk"), (21, "tea"), (23, "milk"), (24, "tea and cake with more words")]
    e.catalog.register("bios", spark.createDataFrame(bios, "id int, bio string"), id_col="id", analyzed=["bio"])
    q = {"query": fj("written_by", "bios", "id", {"term": {"bio": "tea"}}, orderBy="doc_score", maxTermsPerShard=1)}
    r = e.search(q, "papers")
    assert ids(r) == ["p10"] and r.actions[0]["is_pruned"] and r.actions[0]["size"] == 1 and r.actions[0]["order_by"] == "doc_score"
    again = e.search(q, "papers")
    assert again.actions[0]["cache_hit"] and again.actions[0]["is_pruned"]
    m = two(spark).search({"query": fj("written_by", "authors", "id", team("red"), maxTermsPerShard=42)}, "papers").actions[0]
    assert (m["size"], m["is_pruned"], m["max_terms_per_shard"], m["size_in_bytes"]) == (3, False, 42, 33)
    e.clear_cache()


def test_terms_by_query(spark):
    cat = Catalog(spark)
    n = 260
    cat.register("t", spark.range(n).selectExpr("id", "cast(id as string) str", "if(id % 4 = 1, 'rain', 'rain rain wind over the sea') txt"), id_col="id", analyzed=["txt"], num_shards=4)
    e = Engine(cat)
    assert e.terms_by_query("str").size == e.terms_by_query("id").size == n
    limited = e.terms_by_query("id", max_terms_per_shard=30)
    assert limited.size <= 120 and limited.is_pruned and not e.terms_by_query("id", max_terms_per_shard=n).is_pruned
    top = e.terms_by_query("id", {"term": {"txt": "rain"}}, order_by="doc_score", max_terms_per_shard=5).df.collect()
    assert {r[0] % 4 for r in top} == {0, 1, 2, 3} and sorted(r[0] for r in top if r[0] % 4 == 1) == [1, 5, 9, 13, 17]
    for bad in ({"encoding": "bytes"}, {"order_by": "doc_score"}, {"encoding": "nope"}):
        with pytest.raises(QueryError):
            e.terms_by_query("id", **bad)
    with pytest.raises(TermsLimitExceeded, match="Data too large"):
        e.terms_by_query("id", max_terms=10)


def test_literal_terms_and_validation(spark):
    cat = Catalog(spark)
    cat.register("t", spark.createDataFrame([(2,), (5,), (40,)], "id int"), id_col="id")
    e = Engine(cat)
    assert e.search({"query": Q.fielddata_terms("id", [0, 5, 9, 40, 41], 1)}, "t").total == 2
    assert e.search({"query": Q.termsenum_terms("id", list(range(3, 20_000)), 1)}, "t").total == 2
    for bad in ({"fielddata_terms": {"id": {"value": [1]}}}, {"fielddata_terms": {"id": {"_cache_key": 1}}}, {"fielddata_terms": {"id": {"value": [1], "_cache_key": 1, "x": 1}}}, {"fielddata_terms": {}}, {"nope": {}}, {"filterjoin": {"id": {}}}, {"filterjoin": {"id": {"path": "id", "odd": 1}}}):
        with pytest.raises(QueryError):
            e.search({"query": bad}, "t")
    assert e.search({"query": {"term": {"id": "no number"}}}, "t").total == 0


def test_kinds_must_agree(spark):
    cat = Catalog(spark)
    cat.register("a", spark.createDataFrame([(1, "1", 1.0)], "i int, s string, d double"))
    e = Engine(cat)
    for target, path in (("i", "s"), ("s", "i"), ("d", "d")):
        with pytest.raises(UnsupportedTypeError):
            e.search({"query": fj(target, "a", path)}, "a")


def test_msearch_isolates_failures_and_shares_the_cache(spark):
    e = two(spark, cache_enabled=True)
    good = {"query": fj("written_by", "authors", "id", team("red"))}
    a, bad, b = e.msearch([({"index": "papers"}, good), ({"index": "none"}, good), ({"index": "papers"}, good)])
    assert isinstance(bad, SearchError) and ids(a) == ids(b) == ["p10", "p14"]
    assert not a.actions[0]["cache_hit"] and b.actions[0]["cache_hit"]
    nd = "\n".join([json.dumps({"index": "papers"}), json.dumps(good)]) + "\n"
    assert ids(e.msearch_ndjson(nd)[0]) == ["p10", "p14"]
    assert e.cache_stats()["hit_count"] == 2
    e.clear_cache()
    assert e.cache_stats()["size"] == 0


def test_writes_make_nested_entries_stale(spark):
    e = two(spark, cache_enabled=True)
    for name in ("shelf", "copy"):
        e.catalog.register(name, spark.createDataFrame([(f"s{i}", i) for i in (31, 32, 33)], "_id string, k int"), id_col="_id")
    q = {"query": {"bool": {"must_not": [fj("k", "copy", "k", fj("k", "shelf", "k"))]}}}
    assert ids(e.search(q, "shelf")) == []
    before = e.index_version("shelf")
    e.catalog.register("shelf", spark.createDataFrame([("s77", 77), ("s31", 31)], "_id string, k int"), id_col="_id")
    assert e.index_version("shelf") != before
    assert ids(e.search(q, "shelf")) == ["s77"]
    e.clear_cache()


def test_cache_evicts_and_can_be_off(spark):
    e = two(spark, cache_enabled=True, cache_size=30)
    for v in ("green", "blue", "nobody"):
        e.search({"query": fj("written_by", "authors", "id", team(v))}, "papers")
    s = e.cache_stats()
    assert s["eviction_count"] >= 1 and s["size_in_bytes"] <= 30
    e.search({"query": fj("written_by", "authors", "id", team("red"))}, "papers")
    assert e.cache_stats()["size_in_bytes"] <= 30
    off = two(spark)
    off.search({"query": fj("written_by", "authors", "id", team("red"))}, "papers")
    assert off.cache_stats()["request_count"] == 0


def test_planning_starts_no_job(spark):
    e = two(spark, cache_enabled=True)
    sc = spark.sparkContext
    sc.setJobGroup("planning", "none expected")
    r = e.search({"query": {"bool": {"should": [fj("written_by", "authors", "id", team("red")), {"term": {"id": 12}}]}}, "sort": ["id"], "size": 5}, "papers")
    again = e.search({"query": fj("written_by", "authors", "id", team("red"))}, "papers")
    assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    assert ids(r) == ["p10", "p12", "p14"] and ids(again) == ["p10", "p14"]
    assert len(sc.statusTracker().getJobIdsForGroup("planning")) > 0
    sc.setLocalProperty("spark.jobGroup.id", None)
    e.clear_cache()


def test_versions_of_files(spark, tmp_path):
    cat = Catalog(spark)
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    cat.register_parquet("t", path)
    before = cat.versions("t")
    assert cat.versions("t") == before
    spark.range(3).write.mode("append").parquet(path)
    assert cat.versions("t") != before


def test_other_file_formats(spark, tmp_path):
    spark.createDataFrame([(21, "x"), (99, "y")], "id int, word string").write.json(str(tmp_path / "j"))
    spark.createDataFrame([(22, "x"), (24, "y")], "id int, word string").write.option("header", True).csv(str(tmp_path / "c"))
    e = two(spark)
    e.catalog.register_json("j", str(tmp_path / "j"), schema="id int, word string", id_col="id")
    e.catalog.register_csv("c", str(tmp_path / "c"), schema="id int, word string", id_col="id")
    assert ids(e.search({"query": fj("written_by", "j", "id", {"term": {"word": "y"}})}, "papers")) == ["p15"]
    assert ids(e.search({"query": fj("written_by", "c", "id")}, "papers")) == ["p13", "p14"]


def test_alias_aggregations_sort(spark):
    e = two(spark)
    from pyspark.sql import functions as F

    e.catalog.alias("reds", "authors", F.col("team") == "red")
    assert e.terms_by_query("id", index="reds").size == 3
    r = e.search({"aggs": {"by": {"terms": {"field": "team"}, "aggs": {"m": {"max": {"field": "id"}}}}, "n": {"filter": fj("id", "papers", "written_by"), "aggs": {"s": {"sum": {"field": "id"}}}}}}, "authors")
    assert {(x["team"], x["doc_count"], x["m"]) for x in r.aggs["by"].collect()} == {("red", 3, 25), ("blue", 1, 22), ("green", 1, 24)}
    assert [tuple(x) for x in r.aggs["n"].collect()] == [(4, 90)]
    page = e.search({"sort": [{"id": "desc"}], "from": 1, "size": 2, "_source": ["id"]}, "authors").df.collect()
    assert [x["id"] for x in page] == [24, 23]
    scored = e.search({"query": fj("written_by", "authors", "id", team("red"))}, "papers", score=True).df.collect()
    assert {x["_score"] for x in scored} == {1.0}
    assert e.exists({"query": team("blue")}, "authors") and not e.exists({"query": team("nobody")}, "authors")


def test_bloom(spark):
    df = spark.range(10_000)
    b = Bloom.of(df, "id", 100_000)
    assert all(b.might_contain(i) for i in range(0, 10_000, 97))
    false = sum(b.might_contain(i) for i in range(10_000, 20_000))
    assert false < 500
    other = Bloom.of(spark.range(10_000, 10_010), "id", 100_000)
    assert abs(b.estimate() - 10_000) < 300
    assert b.merge(other).might_contain(10_005)
    assert Bloom.empty(spark, 10).estimate() == 0


def test_stream_against_static(spark, tmp_path):
    from semifold.streaming import stream_semi

    spark.createDataFrame([(21,), (22,), (25,)], "id int").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int").parquet(str(tmp_path / "in"))
    out = stream_semi(two(spark), s, fj("id", "authors", "id", team("red")))
    q = out.writeStream.format("memory").queryName("semi_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("semi_out").collect()) == [21, 25]


key_sets = st.lists(st.one_of(st.none(), st.lists(st.integers(0, 5), max_size=3)), min_size=1, max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=key_sets, right=key_sets)
def test_array_joins_equal_brute_force(spark, left, right):
    cat = Catalog(spark)
    for n, rows in (("l", left), ("r", right)):
        cat.register(n, spark.createDataFrame([(str(i), v) for i, v in enumerate(rows)], "_id string, k array<int>"), id_col="_id")
    e = Engine(cat, EngineConfig(cache_enabled=False))
    terms = {x for v in right for x in v or ()}
    hit = sorted(str(i) for i, v in enumerate(left) if terms & set(v or ()))
    assert ids(e.search({"query": fj("k", "r", "k")}, "l")) == hit
    assert ids(e.search({"query": {"bool": {"must_not": [fj("k", "r", "k")]}}}, "l")) == sorted({str(i) for i in range(len(left))} - set(hit))


def test_a_join_fails_when_it_runs_if_its_keys_are_too_many(spark):
    q = {"query": fj("written_by", "authors", "id", team("red"))}
    assert ids(two(spark, max_join_terms=3).search(q, "papers")) == ["p10", "p14"]
    for cache in (True, False):
        r = two(spark, cache_enabled=cache, max_join_terms=2).search(q, "papers")
        with pytest.raises(Exception, match="Data too large"):
            r.df.collect()
