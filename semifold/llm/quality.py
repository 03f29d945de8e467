"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

1. One pass over the texts computes a small vector of statistics per document
   (Arrow batches); everything after reads only those vectors.
2. Statistics are standardised with moments of the training rows.  A fixed
   random projection and a cosine approximate a Gaussian kernel over them.
3. Each partition sums its part of the normal equations; the parts are summed
   row by row in two shuffle steps, and one (D+1)-square system is solved.
4. A fifth of the training rows is left out of the regression and calibrates
   it: raw scores are counted in a fixed number of bins (a map-side-combined
   aggregate), and pool-adjacent-violators makes the bin rates monotone.

Labels are the only thing learned from; language, source and id are no inputs.

Defined cases: null text is empty and scored like any text; repeated rows are
scored alike and count as often as they occur; several labels of one id count
as the largest; without training labels every score is 0.5; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, text_of

THRESHOLD = 0.3
FOLDS, TEST_FOLD, CALIBRATION_FOLD = 5, 0, 1
FEATURES = 160
BANDWIDTH = 4.0
RIDGE = 1e-2
BINS = 2048
SEED = 11
#: Ids up to which labels (8 bytes each) are broadcast.
BROADCAST_LABELS = 1_000_000

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_MARKS = [np.array([ord(c) for c in s]) for s in (".", ",", "!", "?", "#$%&*", "|/\\", "<>{}[]", "=+_~^", "\"'()-:;", "\n")]
STATS = 25


def statistics(text: str) -> list[float]:
    """Numbers that describe a text, whatever its language."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    h = np.bincount(raw, minlength=256)
    words = text.split()
    nw = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per = 1.0 / max(1, n)
    out = [math.log1p(n), math.log1p(nw), n / max(1, nw) if nw else 0.0, math.log1p(len(lines))]
    out += [h[_UPPER].sum() * per, h[_LOWER].sum() * per, h[_DIGIT].sum() * per, h[128:].sum() * per]
    out += [math.sqrt(h[m].sum() * per) for m in _MARKS]
    if nw:
        c = Counter(words)
        top = c.most_common(1)[0][1]
        out += [len(c) / nw, top / nw, len(set(zip(words, words[1:], strict=False))) / max(1, nw - 1) if nw > 1 else 1.0, sum(len(w) <= 3 for w in words) / nw, math.log1p(max(map(len, c))), sum(w.isupper() for w in words) / nw]
    else:
        out += [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    out.append(len(set(lines)) / len(lines) if lines else 1.0)
    return [float(x) for x in out]


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``stats``."""
    import pyarrow as pa

    cols = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(docs).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            stats = pa.array([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], stats], names=[*b.schema.names[:-1], "stats"])

    return cols.mapInArrow(run, f"{schema}, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray | None = None
    rates: np.ndarray | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.hstack([np.ones((len(x), 1)), x / 8, z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.knots, self.rates)


def _stack(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()) if len(col) else np.zeros((0, STATS))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and right-hand side, summed over partitions without gathering them in one task."""
    d = 1 + STATS + len(model.b)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((d, d + 1))
        for pdf in batches:
            z = model.expand(_stack(pdf["stats"]))
            acc[:, :d] += z.T @ z
            acc[:, d] += z.T @ pdf["label"].to_numpy(float)
        # The same in each attempt at a task, so a repeated one sends its rows to the same reducers.
        yield pd.DataFrame({"i": np.arange(d), "part": TaskContext.get().partitionId(), "v": list(acc)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "part": [pdf["part"].iloc[0]], "v": [np.sum(pdf["v"].to_numpy(), axis=0)]})

    schema = "i int, part bigint, v array<double>"
    parts = rows.select("stats", "label").mapInPandas(part, schema)
    some = parts.withColumn("part", F.col("part") % 32).groupBy("i", "part").applyInPandas(add, schema)
    sums = some.withColumn("part", F.lit(0).cast("bigint")).groupBy("i").applyInPandas(add, schema).collect()
    m = np.zeros((d, d + 1))
    for r in sums:
        m[r["i"]] = r["v"]
    return m[:, :d], m[:, d]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and non-decreasing rates of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, y, strict=True):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    centre = np.array([s / b for s, b, _ in blocks])
    rate = np.array([c / b for _, b, c in blocks])
    return centre, np.clip(rate, 0.0, 1.0)


def fit(training: DataFrame) -> Model:
    """training: stats, label (0/1), calibrate (boolean)."""
    moments = training.agg(F.count("*").alias("n"), F.count_if("calibrate").alias("c"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / BANDWIDTH, (STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    if not moments["n"]:
        return Model(np.zeros(STATS), np.ones(STATS), w, b, np.zeros(1 + STATS + FEATURES))
    mean = np.array([moments[f"m{i}"] for i in range(STATS)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(STATS)])
    model = Model(mean, np.maximum(scale, 1e-6), w, b, np.zeros(1 + STATS + FEATURES))
    apart = 0 < moments["c"] < moments["n"]
    gram, rhs = _normal_equations(training.filter("not calibrate") if apart else training, model)
    reg = np.full(len(rhs), RIDGE * max(1.0, gram[0, 0]) / 100)
    reg[0] = 1e-9
    model = Model(mean, model.scale, w, b, np.linalg.solve(gram + np.diag(reg), rhs))
    return calibrate(model, training.filter("calibrate") if apart else training)


def calibrate(model: Model, rows: DataFrame) -> Model:
    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = np.clip(model.raw(_stack(pdf["stats"])), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.minimum(((r + 0.5) / 2 * BINS).astype(np.int32), BINS - 1), "label": pdf["label"]})

    bins = rows.select("stats", "label").mapInPandas(raw, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()
    bins = sorted(bins, key=lambda r: r["bin"])
    x = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in bins])
    knots, rates = isotonic(x, np.array([r["n"] for r in bins], float), np.array([r["y"] for r in bins], float))
    return Model(model.mean, model.scale, model.w, model.b, model.beta, knots, rates)


def score_column(model: Model):
    @F.pandas_udf("double")
    def run(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(stats)))

    return run


def score(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """The kept columns (doc_id among them), held_out and score."""
    keep = keep or ("doc_id",)
    stats = materialize(features(docs, *keep), "quality-stats")
    lab = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("int").alias("label"))
    r = fold(F.col("doc_id"), FOLDS)
    training = stats.select("doc_id", "stats").filter(r != TEST_FOLD).join(lab, F.col("doc_id") == F.col("l_id")).select("stats", "label", (fold(F.col("doc_id"), FOLDS) == CALIBRATION_FOLD).alias("calibrate"))
    model = fit(materialize(training, "quality-training"))
    return stats.select(*keep, (r == TEST_FOLD).alias("held_out"), score_column(model)("stats").alias("score"))


def digest(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, labels).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, all columns as they came.

    The model is fitted first; then one pass scores and filters every document,
    so that texts are neither shuffled nor written again.
    """
    lab = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("int").alias("label"))
    r = fold(F.col("doc_id"), FOLDS)
    few = lab.filter(fold(F.col("l_id"), FOLDS) != TEST_FOLD)
    if few.count() <= BROADCAST_LABELS:
        # Only texts that have a label to learn from are counted for the fit.
        own = features(docs.join(F.broadcast(few.select("l_id")), F.col("doc_id") == F.col("l_id"), "left_semi"), "doc_id")
    else:
        own = features(docs, "doc_id")
    training = materialize(own, "quality-stats").filter(r != TEST_FOLD).join(lab, F.col("doc_id") == F.col("l_id")).select("stats", "label", (r == CALIBRATION_FOLD).alias("calibrate"))
    model = fit(materialize(training, "quality-training"))

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(len(text), STATS)))

    return docs.filter(run(text_of(docs)) >= threshold)
