import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from semifold.llm import common, mixing
from tests.oracle import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def targets(sizes, share=1.5, weights=(5, 2, 1)):
    """Caps and resharing, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]
        free -= over
    return fixed


def check(docs, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, biggest, took = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
        biggest[d["source"]] = max(biggest[d["source"]], words(d["text"]))
    want = targets(sizes)
    assert len(got) == len(docs)
    for r in got:
        took[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(took[s] - want[s]) <= biggest[s] + 1e-6, s


def test_targets_are_met_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.per_row(mixing.mix(docs))
    check(docs.collect(), got.collect())
    again = mixing.taken(docs.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.taken(docs).collect()))


def test_several_levels_and_a_hot_source(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.collect(), mixing.per_row(mixing.mix(df)).collect())


def test_joins_beyond_the_broadcast_size(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 7919 % 50), "en", None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mix_size", F.lit("clash")).withColumn("occurrence", F.lit("clash"))
    want = sorted(map(tuple, mixing.taken(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, mixing.taken(df).collect())) == want
    kept = mixing.apply_mix(df)
    assert kept.columns == [*df.drop("mix_size").columns, "mix_size", "mix_copies"] and kept.filter("occurrence != 'clash'").count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, "a", None), (1, None, None, "a", None), (None, "x y z", "en", None, 5), (2, "one", "en", "b", 3), (2, "one", "en", "b", 3), (2, "one", "en", "b", 3), (3, " \t\n", "en", "é", 3), (4, "w " * 30000, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash"))
    got = mixing.per_row(mixing.mix(df)).collect()
    check(df.collect(), got)
    assert mixing.taken(df).columns == ["doc_id", "size", "source_size", "target", "taken"]
    kept = mixing.apply_mix(df)
    assert kept.columns[:6] == df.columns and sum(r["mix_copies"] * r["mix_size"] for r in kept.collect()) == sum(r["copies"] * r["size"] for r in got)
    assert mixing.taken(df.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds, a unit is taken as often as its probability says."""
    n = 400
    units = spark.range(n).select((F.col("id") % 20).alias("grp"), F.col("id").alias("key"), F.lit(10.0).alias("size"), F.lit(3.0).alias("mass"), F.lit(20).cast("long").alias("n"))
    r = mixing.pivotal_round(units, 20, chunk=4).collect()
    assert len(r) == n and len({x["key"] for x in r}) == n
    per = defaultdict(int)
    for x in r:
        per[x["grp"]] += x["taken"]
    assert all(v == 6 for v in per.values())
