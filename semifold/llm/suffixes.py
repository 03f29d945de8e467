"""Repeated-passage removal with a logarithmic family of sparse suffix indexes.

A passage is 200 bytes.  Of the 101 strings of 100 bytes in it, the one with
the smallest hash (the leftmost of equals) is its anchor, so equal passages
have their anchors at equal offsets.  Only suffixes that begin at anchors are
indexed, about one in fifty.

Family: each batch of documents becomes a run, its suffixes' 100-byte prefixes
hashed, sorted and counted.  The run is merge-scanned against every level;
prefixes met twice are long matches.  Two levels of one size merge into the
next, so an entry is rewritten a logarithmic number of times.

Matches: the anchors with matched prefixes give their surroundings (100 bytes
before to 200 after).  Equal surroundings are counted as one before anything
else, so copies crowd no task.  Surroundings of one prefix are then sorted as
suffixes, and the passages in them that occur twice are marked; a prefix with
very many distinct surroundings is instead dealt out passage by passage.

Decisions return to the documents without moving texts: they are written per
scan partition, and each task of the second and third scan reads its own part
from the shared folder.  A task that finds another text than the one decided on
(by a prefix hash, then by a hash of the text), or misses one, fails the job.

Defined cases: null text is empty; texts under 200 bytes keep everything;
repeats overlap freely and inside one text; repeated rows count as separate
documents; columns other than doc_id and text are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, materialize, text_of

PASSAGE = 200
GRAM = 100
WINDOW = PASSAGE - GRAM + 1
#: Bytes of a text handled at once.
PIECE = 1 << 18
#: Surroundings that a task holds before it passes them on.
HELD = 4096
BATCHES = 4
#: Distinct surroundings of one prefix from which its passages are dealt out.
HOT = 4096
#: Repeated prefixes (8 bytes each) up to which they are broadcast.
BROADCAST_PREFIXES = 1_000_000
_POS = (1 << 21) - 1
_B = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = np.uint64((int(out[i - 1]) * _B) & (1 << 64) - 1)
    return out


_POW = _powers(PASSAGE + 1)
_SUBST = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of the width, by doubling: hash(xy) = hash(x) * B^|y| + hash(y)."""
    h, size = _SUBST[data], 1
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = h
            else:  # the strings so far, then the next `size` bytes
                n = len(h) - done
                out = out[:n] * _POW[size] + h[done:]
            done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        h = h[:-half] * _POW[half] + h[half:]
    out = out[: len(data) - width + 1].copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all passages, and the prefix hash at each."""
    pos, keys = [], []
    n = len(data)
    for at in range(0, max(0, n - PASSAGE + 1), PIECE):
        piece = data[at : at + PIECE + PASSAGE - 1]
        h = rolling(piece, GRAM)
        m = len(h)
        k = (h & np.uint64(~_POS & (1 << 64) - 1)) | np.arange(m, dtype=np.uint64)
        pad = -m % WINDOW
        blocks = np.append(k, np.full(pad, np.uint64((1 << 64) - 1))).reshape(-1, WINDOW)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = m - WINDOW + 1
        least = np.minimum(right[:count], left[WINDOW - 1 : WINDOW - 1 + count])
        p = (least & np.uint64(_POS)).astype(np.int64)
        p = p[np.append(True, p[1:] != p[:-1])]
        pos.append(p + at)
        keys.append(h[p])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, i = np.unique(np.concatenate(pos), return_index=True)
    return p, np.concatenate(keys)[i].view(np.int64)


class SuffixIndex:
    """The index family: sorted runs of (h, c) in the shared folder, a level for each power of two of batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        return materialize(run.sortWithinPartitions("h"), "suffix-level")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """suffixes: h per anchor of a new batch.  Returns h: prefixes of which the index now knows that they repeat."""
        run = self._write(suffixes.groupBy("h").agg(F.count("*").alias("c")))
        found = run.filter("c > 1").select("h")
        for _, level in self.levels:
            found = found.unionByName(run.join(level.select("h"), "h", "left_semi").select("h"))
        found = materialize(found.distinct(), "suffix-found")
        size, cur = 1, run
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = self._write(other.unionByName(cur).groupBy("h").agg(F.sum("c").alias("c")))
            for old in (other, cur):
                _remove(self.spark, old)
            size, cur = size * 2, merged
        self.levels.append((size, cur))
        return found


def _remove(spark: SparkSession, table: DataFrame) -> None:
    """Deletes a scratch table that nothing reads any more."""
    for d in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _data(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _with_rid(docs: DataFrame) -> DataFrame:
    """The rows as every scan of this frame numbers them."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def _aligned(side: DataFrame, name: str) -> str:
    """Writes rows (rid, ...) by the scan partition that their rid names."""
    path = fresh_dir(side.sparkSession, name)
    side.withColumn("pid", F.shiftright("rid", 33)).repartition("pid").sortWithinPartitions("pid", "rid").write.partitionBy("pid").option("compression", "zstd").parquet(path)
    return path


def _own_part(path: str) -> dict[int, tuple]:
    """In a task: the side rows of its partition, by rid."""
    import pyarrow.dataset as ds
    from pyarrow import fs
    from pyspark import TaskContext

    store, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    own = f"{root}/pid={TaskContext.get().partitionId()}"
    if store.get_file_info(own).type == fs.FileType.NotFound:
        return {}
    t = ds.dataset(own, filesystem=store, format="parquet").to_table().to_pydict()
    cols = [c for c in t if c not in ("rid", "pid")]
    return dict(zip(t["rid"], zip(*(t[c] for c in cols), strict=True), strict=True))


def _same(yes: bool) -> None:
    if not yes:
        raise RuntimeError("the documents were read in another order than before; write them to a table first")


def _check(data: np.ndarray, want: int) -> None:
    _same(_text_hash(data) == want)


def _text_hash(data: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(data.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _around(data: np.ndarray, p: int) -> bytes:
    """Surroundings of an anchor; 255 (never in UTF-8) stands for what lies outside the text."""
    a, b = p - (WINDOW - 1), p + PASSAGE
    body = data[max(0, a) : min(len(data), b)].tobytes()
    return b"\xff" * max(0, -a) + body + b"\xff" * max(0, b - len(data))


def _hashes(ctx: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings in each row."""
    n, size = ctx.shape
    flat = np.append(rolling(ctx.ravel(), width), np.zeros(width - 1, np.uint64))
    return flat.reshape(n, size)[:, : size - width + 1]


def _passages(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ctx: rows of surroundings.  Row, start and hash of each passage that lies in the text and has its anchor in the middle."""
    ok = (ctx != 255).astype(np.int32).cumsum(1)
    full = np.concatenate([ok[:, PASSAGE - 1 : PASSAGE], ok[:, PASSAGE:] - ok[:, :-PASSAGE]], axis=1)[:, :WINDOW] == PASSAGE
    h = _hashes(ctx, GRAM) & np.uint64(~_POS & (1 << 64) - 1)
    mid = h[:, WINDOW - 1 : WINDOW]
    # The anchor must be the leftmost least: nothing before it in the passage as small, nothing after it smaller.
    before = np.minimum.accumulate(h[:, : WINDOW - 1][:, ::-1], axis=1)[:, ::-1] > mid
    after = np.minimum.accumulate(h[:, WINDOW:], axis=1) >= mid
    yes = np.ones((len(ctx), 1), bool)
    left = np.concatenate([before, yes], axis=1)  # start i: positions i .. middle
    right = np.concatenate([yes, after], axis=1)[:, :WINDOW]  # start i: middle .. i + WINDOW - 1
    row, start = np.nonzero(full & left & right)
    return row, start, _hashes(ctx, PASSAGE)[row, start]


MARKS = "ch binary, first int, last int"


def _find(ch: list, ctx: np.ndarray, n: np.ndarray):
    """First and last passage that occurs twice, for each of the distinct surroundings that has any; n: how often each occurs."""
    import pyarrow as pa

    row, start, h = _passages(ctx)
    _, inv = np.unique(h, return_inverse=True)
    twice = np.bincount(inv, n[row])[inv] > 1 if len(h) else np.zeros(0, bool)
    row, start = row[twice], start[twice]
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    first, last = start[at], start[np.append(at[1:], len(row)) - 1] if len(row) else start
    return pa.RecordBatch.from_arrays([pa.array([ch[i] for i in row[at]], pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["ch", "first", "last"])


def _scan_sorted(batches: Iterator) -> Iterator:
    """Surroundings sorted by prefix, then as suffixes: whole prefixes at a time, some thousand rows together."""
    held: list[tuple] = []

    def out(rows: list[tuple]):
        return _find([r[1] for r in rows], np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), np.array([r[3] for r in rows], np.int64))

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= 2048 and r[0] != held[-1][0]:
                yield out(held)
                held = []
            held.append(r)
    if held:
        yield out(held)


def repeated(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """rid, th, spans (from, to): the covered bytes at each anchor of each row."""
    import pyarrow as pa

    spark = docs.sparkSession
    rows = _with_rid(docs)

    def index(bs: Iterator) -> Iterator:
        for b in bs:
            rid, pos, key = [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                p, k = anchors(_data(t))
                rid.append(np.full(len(p), r, np.int64))
                pos.append(p)
                key.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (rid, pos, key)], ["rid", "pos", "h"])

    suffixes = materialize(rows.mapInArrow(index, "rid bigint, pos bigint, h bigint"), "suffixes")
    family, found, found_in = SuffixIndex(spark), None, []
    for i in range(batches):
        got = family.add(suffixes.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == i).select("h"))
        found_in.append(got)
        found = got if found is None else found.unionByName(got)
    known = materialize(found.distinct(), "suffix-known")
    # A prefix may have any share of the suffixes: they stay where they are if its like are few enough to broadcast.
    few = F.broadcast(known) if known.count() <= BROADCAST_PREFIXES else known
    hits = suffixes.join(few, "h", "left_semi").groupBy("rid").agg(F.collect_list("pos").alias("pos"), F.bit_xor("h").alias("x"))
    side = _aligned(hits, "suffix-hits")
    # From here on the texts and the side tables are all that is read.
    for table in (suffixes, known, *found_in, *(level for _, level in family.levels)):
        _remove(spark, table)

    def surround(bs: Iterator) -> Iterator:
        mine = _own_part(side)
        kinds = {"rid": pa.int64(), "th": pa.int64(), "pos": pa.int64()}
        names = ("rid", "th", "pos", "ch", "h", "ctx")
        out: dict[str, list] = {k: [] for k in names}
        met = 0

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], list(out))
            for v in out.values():
                v.clear()
            return batch

        for b in bs:
            for r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if r not in mine:
                    continue
                data = _data(t)
                th = _text_hash(data)
                positions, want = mine[r]
                met += 1
                _same(max(positions) + GRAM <= len(data))
                prefixes = np.concatenate([data[p : p + GRAM] for p in positions])
                _same(int(np.bitwise_xor.reduce(rolling(prefixes, GRAM)[::GRAM]).view(np.int64)) == want)
                for p in positions:
                    c = _around(data, p)
                    out["rid"].append(r)
                    out["th"].append(th)
                    out["pos"].append(p)
                    out["ch"].append(hashlib.blake2b(c, digest_size=16).digest())
                    out["h"].append(hashlib.blake2b(c[WINDOW - 1 : WINDOW - 1 + GRAM], digest_size=8).digest())
                    out["ctx"].append(c)
                if len(out["rid"]) >= HELD:
                    yield made()
        yield made()
        _same(met == len(mine))

    around = materialize(rows.mapInArrow(surround, "rid bigint, th bigint, pos bigint, ch binary, h binary, ctx binary"), "suffix-around")
    distinct = around.groupBy("h", "ch", "ctx").agg(F.count("*").alias("n"))
    sizes = around.select("h", "ch").distinct().groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("h")
    crowded = materialize(sizes, "suffix-crowded")
    some_hot = not crowded.limit(1).isEmpty()
    calm = distinct.join(crowded, "h", "left_anti") if some_hot else distinct
    # Passages of one prefix start within 100 bytes of each other, so those that repeat cover one run of bytes.
    marks = calm.repartition("h").sortWithinPartitions("h", "ctx").select("h", "ch", "ctx", "n").mapInArrow(_scan_sorted, MARKS)
    if some_hot:
        marks = marks.unionByName(_dealt(distinct.join(crowded, "h", "left_semi")))
    marks = marks.withColumnRenamed("ch", "m_ch")
    lo = F.col("pos") - (WINDOW - 1)
    return around.select("rid", "th", "pos", "ch").join(marks, F.col("ch") == F.col("m_ch")).select("rid", "th", F.array(lo + F.col("first"), lo + F.col("last") + PASSAGE).alias("spans"))


def _dealt(ctx: DataFrame) -> DataFrame:
    """The same marks for crowded prefixes: a row per passage, counted by its hash, wherever that is dealt to."""
    import pyarrow as pa

    def explode(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                ch, body, n = (c.to_pylist() for c in b.slice(i, 512).columns)
                row, start, h = _passages(np.frombuffer(b"".join(body), np.uint8).reshape(len(body), -1))
                yield pa.RecordBatch.from_arrays([pa.array([ch[r] for r in row], pa.binary()), pa.array(start, pa.int32()), pa.array(h.view(np.int64)), pa.array(np.array(n, np.int64)[row])], ["ch", "start", "ph", "n"])

    each = materialize(ctx.select("ch", "ctx", "n").mapInArrow(explode, "ch binary, start int, ph bigint, n bigint"), "suffix-passages")
    twice = each.groupBy("ph").agg(F.sum("n").alias("total")).filter("total > 1").select(F.col("ph").alias("p2"))
    return each.join(twice, F.col("ph") == F.col("p2"), "left_semi").groupBy("ch").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text that is left) for each row."""
    import pyarrow as pa

    found = repeated(docs).groupBy("rid").agg(F.any_value("th").alias("th"), F.flatten(F.collect_list("spans")).alias("spans"))
    side = _aligned(found, "suffix-spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def apply(bs: Iterator) -> Iterator:
        mine = _own_part(side)
        met = 0
        for b in bs:
            out = []
            for r, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _data(t)
                kept, removed, runs = data.tobytes(), 0, 0
                if r in mine:
                    th, spans = mine[r]
                    met += 1
                    _check(data, th)
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, spans[0::2], 1)
                    np.add.at(edge, spans[1::2], -1)
                    gone = edge.cumsum()[:-1] > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
                out.append((d, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        _same(met == len(mine))

    return _with_rid(docs).mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove(docs).drop("kept")
