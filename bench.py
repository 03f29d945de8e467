"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from semifold.queries import QUERIES, engine, fj

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def scenarios(spark):
    """The four parent/child scenarios: orders are parents, line items children."""
    eng = engine(spark, SF, "orders", "lineitem")
    child = lambda q: eng.search({"query": fj("o_orderkey", "lineitem", "l_orderkey", q)}, index="orders").df
    parent = lambda q: eng.search({"query": fj("l_orderkey", "orders", "o_orderkey", q)}, index="lineitem").df
    return {
        "has_child_single_term": lambda: child({"term": {"l_linenumber": 3}}),
        "has_child_match_all": lambda: child(None),
        "has_parent_single_term": lambda: parent({"term": {"o_orderkey": 7}}),
        "has_parent_match_all": lambda: parent(None),
        "terms_by_query": lambda: eng.terms_by_query("l_orderkey", {"range": {"l_quantity": {"gte": 25}}}, "lineitem").df,
    } | {n: (lambda n=n: QUERIES[n](spark, SF)) for n in ("fj_basic", "fj_nested", "fj_or", "fj_must_not", "fj_multivalued_target", "terms_top_score", "fj_in_filter_agg", "q_text_term")}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out, p95 = {}, {}
    for name, make in scenarios(spark).items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make().agg(F.count("*")).collect()
            took.append(time.perf_counter() - began)
        warm = sorted(took[1:])
        out[name], p95[name] = round(statistics.median(warm), 4), round(warm[min(len(warm) - 1, int(0.95 * len(warm)))], 4)
    print(json.dumps({"metric": "median_warm_total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "p95": p95, "sf": SF, "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
