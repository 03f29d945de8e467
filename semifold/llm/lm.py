"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Counts: every training document is tokenised once; tasks pre-count tokens, and
one aggregate keyed by the token's 64-bit hash gives c, N and V exactly.  Counts
of at least ``COMMON`` of all tokens are broadcast (there are at most 1/COMMON
of those); occurrences of rarer tokens are joined with their counts by hash.

Outputs: each of the ``WORDS`` commonest tokens is one; all other tokens, seen
or not, are in classes by their last bytes, the ``ENDINGS`` commonest of which
are outputs of their own, and one output stands for the rest.  So the model
covers every token of the corpus: P(token) = P(class | context) * (c+1) / (the
class's tokens + its kinds + 1), which sums to 1 with one unseen token a class.

Model: P(class | two before) is log-bilinear: the context is a per-position
weighted sum of embeddings, scored against output embeddings plus a bias.  Every
training token is used once, against noise shared within a minibatch.  Documents
are dealt to shards by a hash of their tokens, the number of shards growing with
the root of the corpus; each shard trains its own parameters and the sums are
averaged, weighted by tokens, so the model does not depend on how a table is
partitioned.  For scoring, the bilinear form is tabulated and all normalisers
follow from one product of two square matrices, so probabilities sum to 1.

A second pass turns the texts into class ids once; training and scoring read
those.

Defined cases: null text is empty (its only token is the end); repeated rows
are scored alike; a text of any length is one sequence, held as one array; with
no training rows, counts are 0 and the model uniform; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, text_of

FOLDS, TEST_FOLD = 7, 2
WORDS, ENDINGS = 1280, 767
TAIL = 3
DIM, NOISE, RATE = 16, 32, 0.15
#: Minibatches grow from the one to the other.
SMALLEST, LARGEST = 128, 2048
#: Square root of the training tokens for each shard.
PER_SHARD = 512
#: Rows of the parameters that are summed together.
BLOCK = 128
COMMON = 2e-6
END = b"\n"
FLUSH = 400_000


def tokens(text: str) -> list[bytes]:
    out = text.encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def _hash(token: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def ending(token: bytes) -> int:
    """The last bytes as a number."""
    return int.from_bytes(token[-TAIL:], "big")


def token_counts(texts: DataFrame) -> DataFrame:
    """texts: one column.  Returns h, s (the ending), c."""
    import pyarrow as pa

    def rows(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in c], pa.int64()), pa.array([ending(t) for t in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["h", "s", "c"])

    def run(batches: Iterator) -> Iterator:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(tokens(t))
                if len(c) > FLUSH:
                    yield rows(c)
                    c = Counter()
        if c:
            yield rows(c)

    return texts.mapInArrow(run, "h bigint, s int, c bigint").groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Common tokens by hash, sorted, with counts and words' outputs (0: in a class), and the outputs of endings.

    A token is looked up once and then kept in a bounded memo, as slot * 2^16 + output (slot 0: not common).
    """

    h: np.ndarray
    c: np.ndarray
    word: np.ndarray
    endings: dict[int, int]
    memo: dict = field(default_factory=dict)

    def codes(self, toks: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 1_000_000:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, toks), np.int64, len(toks))
        except KeyError:
            fresh = [t for t in set(toks) if t not in memo]
            hs = np.array([_hash(t) for t in fresh], np.int64)
            at = np.searchsorted(self.h, hs)
            at[at == len(self.h)] = 0
            ok = self.h[at] == hs if len(self.h) else np.zeros(len(hs), bool)
            word = np.where(ok, self.word[at], 0) if len(self.h) else np.zeros(len(hs), np.int64)
            get = self.endings.get
            out = [w or get(ending(t), 0) for w, t in zip(word.tolist(), fresh, strict=True)]
            memo.update(zip(fresh, (np.where(ok, at + 1, 0) * 65536 + np.array(out, np.int64)).tolist(), strict=True))
            return np.fromiter(map(memo.__getitem__, toks), np.int64, len(toks))


@dataclass
class Params:
    r: np.ndarray  # context embeddings
    q: np.ndarray  # output embeddings
    b: np.ndarray  # output biases
    c: np.ndarray  # weights of the two positions

    @classmethod
    def start(cls, prior: np.ndarray) -> Params:
        rng = np.random.default_rng(7)
        v = len(prior)
        return cls(rng.normal(0, 0.1, (v, DIM)), rng.normal(0, 0.1, (v, DIM)), np.log(prior), np.ones((2, DIM)))

    def flat(self) -> np.ndarray:
        return np.hstack([self.r, self.q, self.b[:, None]])

    @classmethod
    def unflat(cls, rows: np.ndarray, c: np.ndarray) -> Params:
        return cls(rows[:, :DIM], rows[:, DIM : 2 * DIM], rows[:, 2 * DIM], c)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a[w1, w], b[w2, w] and log Z[w1, w2]; log P(w) = a + b - log Z."""
        r, q, c = (x.astype(np.float32) for x in (self.r, self.q, self.c))
        a = (r * c[0]) @ q.T
        b = (r * c[1]) @ q.T + self.b.astype(np.float32)
        ma, mb = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.exp(a - ma) @ np.exp(b - mb).T
        return a, b, np.log(np.maximum(z, 1e-30)) + ma + mb.T


def _scatter(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, with repeats summed: sorted by row, then reduced in runs."""
    order = np.argsort(at, kind="stable")
    k = at[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    out[k[first]] += np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad on minibatches, in single precision."""

    def __init__(self, p: Params, prior: np.ndarray, seed: int):
        self.p = Params(*(np.ascontiguousarray(x, np.float32) for x in (p.r, p.q, p.b, p.c)))
        self.prior, self.rng, self.n = prior, np.random.default_rng(seed), 0
        self.log_noise = np.log(NOISE * prior).astype(np.float32)
        self.cum = np.cumsum(prior)
        self.g = [np.full_like(x, 0.05) for x in (self.p.r, self.p.q, self.p.b, self.p.c)]

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, len(w)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), len(self.prior) - 1)
        r1, r2, qw, qn = p.r[w1], p.r[w2], p.q[w], p.q[noise]
        ctx = r1 * p.c[0] + r2 * p.c[1]
        sig = lambda x: 0.5 + 0.5 * np.tanh(0.5 * x)
        dt = sig(np.einsum("ij,ij->i", ctx, qw) + p.b[w] - self.log_noise[w]) - 1
        dn = sig(ctx @ qn.T + (p.b[noise] - self.log_noise[noise]))
        gctx = dt[:, None] * qw + dn @ qn
        gq, gb, gr = np.zeros_like(p.q), np.zeros_like(p.b), np.zeros_like(p.r)
        _scatter(gq, w, dt[:, None] * ctx)
        np.add.at(gq, noise, dn.T @ ctx)
        gb += np.bincount(w, dt, len(gb)).astype(np.float32)
        np.add.at(gb, noise, dn.sum(0))
        _scatter(gr, w1, gctx * p.c[0])
        _scatter(gr, w2, gctx * p.c[1])
        gc = np.stack([np.einsum("ij,ij->j", gctx, r1), np.einsum("ij,ij->j", gctx, r2)])
        for x, grad, acc in zip((p.r, p.q, p.b, p.c), (gr, gq, gb, gc), self.g, strict=True):
            grad /= n
            acc += grad * grad * 1e4
            x -= RATE * grad * 100 / np.sqrt(acc)
        self.n += n

    def feed(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        """All of the tokens, in an order drawn anew."""
        order = self.rng.permutation(len(w))
        at = 0
        while at < len(w):
            k = order[at : at + min(LARGEST, max(SMALLEST, self.n // 64))]
            self.step(w1[k], w2[k], w[k])
            at += len(k)


def contexts(words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each, with the end word before the text."""
    before = np.concatenate((np.array([end, end], words.dtype), words))
    return before[:-2], before[1:-1]


@dataclass
class Outputs:
    """What the counts say: N, V, tokens and kinds of each output's class (0 for words), and its prior."""

    n: int
    v: int
    tokens: np.ndarray
    kinds: np.ndarray
    prior: np.ndarray
    end: int


def outputs(counts: DataFrame) -> tuple[Lexicon, Outputs, int]:
    """The lexicon, the outputs, and the count from which a token is common."""
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    floor = max(1, math.ceil(n * COMMON))
    common = counts.filter(F.col("c") >= floor).toPandas().sort_values("h")  # 1/COMMON rows at most
    h, c = common["h"].to_numpy(np.int64), common["c"].to_numpy(np.int64)
    top = np.lexsort((h, -c))[:WORDS]
    word = np.zeros(len(h), np.int64)
    word[top] = np.arange(1, len(top) + 1)
    last = int(c[top].min()) if len(top) == WORDS else 0
    # Ties at the last word: some are words, the others in a class.
    in_class = counts.filter((F.col("c") < floor) | ((F.col("c") <= last) & ~F.col("h").isin(h[top][c[top] == last].tolist())))
    by = in_class.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("k"))
    ends = by.orderBy(F.desc("c"), "s").limit(ENDINGS).collect()
    rest = in_class.agg(F.sum("c"), F.count("*")).first()
    size = len(top) + 1 + len(ends)
    tok, kinds = np.zeros(size), np.zeros(size)
    for i, r in enumerate(ends):
        tok[len(top) + 1 + i], kinds[len(top) + 1 + i] = r["c"], r["k"]
    tok[0], kinds[0] = (rest[0] or 0) - tok.sum(), rest[1] - kinds.sum()
    prior = tok.copy()
    prior[1 : len(top) + 1] = c[top]
    prior = np.maximum(prior, 1) / np.maximum(prior, 1).sum()
    lex = Lexicon(h, c, word, {r["s"]: len(top) + 1 + i for i, r in enumerate(ends)})
    return lex, Outputs(n, v, tok, kinds, prior, int(lex.codes([END])[0]) & 65535), floor


ROWS = "rid bigint, doc_id bigint, n_tokens bigint, known bigint, base double, share double, rare array<bigint>, ids binary"


def encode(docs: DataFrame, lexicon, out: Outputs) -> DataFrame:
    """docs: rid, doc_id, text.  ROWS: counts, sums over common tokens, the hashes of the others, and the outputs of all.

    share: log10 of the tokens' shares in their classes, without the counts of tokens that are not common.
    """
    import pyarrow as pa

    in_class = (out.kinds > 0) | (np.arange(len(out.kinds)) == 0)
    den = np.where(in_class, np.log10(out.tokens + out.kinds + 1), 0.0)

    def run(batches: Iterator) -> Iterator:
        lex = lexicon.value
        log_c = np.concatenate(([0.0], np.log10(lex.c + 1.0)))
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "known", "base", "share", "rare", "ids")}
            for text in batch.column(2).to_pylist():
                toks = tokens(text)
                code = lex.codes(toks)
                slot, w = code >> 16, code & 65535
                logs = log_c[slot]
                cls = in_class[w]
                cols["n_tokens"].append(len(toks))
                cols["known"].append(int((slot > 0).sum()))
                cols["base"].append(float(logs.sum()))
                cols["share"].append(float(logs[cls].sum() - den[w].sum()))
                cols["rare"].append([_hash(toks[i]) for i in np.flatnonzero(slot == 0)])
                cols["ids"].append(w.astype(np.uint16).tobytes())
            kinds = {"n_tokens": pa.int64(), "known": pa.int64(), "rare": pa.list_(pa.int64()), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, kinds.get(k, pa.float64())) for k, x in cols.items()]], ["rid", "doc_id", *cols])

    return docs.mapInArrow(run, ROWS)


def train(ids: DataFrame, out: Outputs) -> Params:
    """ids: one column.  Each shard trains on its documents; parameters are averaged in blocks of rows."""
    import pyarrow as pa

    v, end, prior = len(out.prior), out.end, out.prior
    shards = max(1, math.ceil(math.sqrt(out.n) / PER_SHARD))

    def parts(batches: Iterator) -> Iterator:
        t, shard, held, size = None, None, [], 0

        def flush() -> None:
            if held:
                t.feed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def rows():
            all_rows = np.vstack([t.p.flat(), np.hstack([t.p.c.ravel(), [0.0]])[None, :]]).astype(np.float64) * t.n
            blocks = [all_rows[i : i + BLOCK].tobytes() for i in range(0, v + 1, BLOCK)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([shard % 64] * len(blocks), pa.int32()), pa.array([float(t.n)] * len(blocks)), pa.array(blocks, pa.binary())], ["block", "part", "n", "v"])

        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if at != shard:
                    if t is not None:
                        flush()
                        yield rows()
                    t, shard, held, size = Trainer(Params.start(prior), prior, 1), at, [], 0
                w = np.frombuffer(x, np.uint16).astype(np.int32)
                held.append((w, *contexts(w, end)))
                size += len(w)
                if size >= 1 << 18:
                    flush()
                    held, size = [], 0
        if t is not None:
            flush()
            yield rows()

    def add(key, table):
        total, n = 0.0, 0.0
        for x, y in zip(table["n"].to_pylist(), table["v"].to_pylist(), strict=True):
            n, total = n + x, total + np.frombuffer(y)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "n": pa.array([n]), "v": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part int, n double, v binary"
    dealt = ids.select(F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("ids", F.lit(1)).alias("place"), "ids")
    made = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place").mapInArrow(parts, schema)
    sums = made.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).orderBy("block").collect()
    start = Params.start(prior)
    if not sums:
        return start
    rows = np.vstack([np.frombuffer(r["v"]).reshape(-1, 2 * DIM + 1) / r["n"] for r in sums])
    return Params.unflat(rows[:v], rows[v, : 2 * DIM].reshape(2, DIM))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    held_out = fold(F.col("doc_id"), FOLDS) == TEST_FOLD
    counts = materialize(token_counts(docs.filter(~held_out).select(text_of(docs).alias("text"))), "lm-counts")
    lex, out, floor = outputs(counts)
    # Numbered once, as the rows are written.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = materialize(encode(rows, sc.broadcast(lex), out), "lm-rows")
    params = train(made.filter(~held_out).select("ids"), out)
    model = sc.broadcast((uuid.uuid4().hex, params, out.end))
    keep = ["rid", "doc_id", "n_tokens", "known", "base", "share"]

    def run(batches: Iterator) -> Iterator:
        a, b, logz = _tables(model.value)
        last = model.value[2]
        for batch in batches:
            lbl = []
            for x in batch.column(len(keep)).to_pylist():
                w = np.frombuffer(x, np.uint16).astype(np.int64)
                w1, w2 = contexts(w, last)
                lbl.append(float((a[w1, w] + b[w2, w] - logz[w1, w2]).sum(dtype=np.float64) / math.log(10)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lbl, pa.float64())], [*keep, "lbl"])

    scored = made.select(*keep, "ids").mapInArrow(run, "rid bigint, doc_id bigint, n_tokens bigint, known bigint, base double, share double, lbl double")
    rare = counts.filter(F.col("c") < floor).select(F.col("h").alias("rh"), F.col("c").alias("rc"))
    pairs = made.select("rid", F.explode("rare").alias("h")).join(rare, F.col("h") == F.col("rh"))
    sums = pairs.groupBy(F.col("rid").alias("r2")).agg(F.count("*").alias("rk"), F.sum(F.log10(F.col("rc") + 1.0)).alias("rs"))
    rs, rk = F.coalesce("rs", F.lit(0.0)), F.coalesce("rk", F.lit(0))
    return scored.join(sums, F.col("rid") == F.col("r2"), "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + rk).alias("n_known"),
        F.lit(int(out.n)).cast("long").alias("train_tokens"),
        (F.col("base") + rs - F.col("n_tokens") * math.log10(out.n + out.v + 1)).alias("base_score"),
        (F.col("lbl") + F.col("share") + rs).alias("score"),
    )


_made: dict[str, tuple] = {}


def _tables(model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's tables, made once in each worker."""
    key, params, _ = model
    if key not in _made:
        _made.clear()
        _made[key] = params.table()
    return _made[key]
