import zlib

import numpy as np
import pytest

from semifold.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF1 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    got = quality.digest(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r["held_out"]]
    pos, neg = [r["score"] for r in test if r["quality"]], [r["score"] for r in test if not r["quality"]]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.97 and np.mean([r["predicted"] == r["quality"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, quality.STATS))
    df = spark.createDataFrame([(r.tolist(), int(r[0] > 0)) for r in x], "stats array<double>, label int").repartition(7)
    m = quality.Model(np.zeros(quality.STATS), np.ones(quality.STATS), rng.normal(size=(quality.STATS, 10)), rng.uniform(size=10), np.zeros(1))
    gram, rhs = quality._normal_equations(df, m)
    z = m.expand(x)
    assert np.allclose(gram, z.T @ z) and np.allclose(rhs, z.T @ (x[:, 0] > 0))


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert list(y) == [0, 0.5, 1] and list(x) == [0, 1.5, 3]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 40000), (4, "\x00퟿"), (5, "A. B? C!")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).withColumnRenamed("lang", "label")
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 0), (3, 1, 0), (5, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = quality.digest(df, lab).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == pytest.approx(0.5) for r in got)
    assert quality.digest(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns
