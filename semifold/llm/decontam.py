"""Benchmark decontamination by the q-gram lemma.

An item of L bytes that occurs in a document with at most e edits leaves at
least L - q + 1 - q*e of its q-grams intact, all of them on diagonals (document
position minus item position) that lie within e of each other.  So the
document's q-grams are looked up in the items' (a bit table, then a sorted
array), hits are counted per document, item and diagonal band, bands overlap by
half so that any such run of diagonals lies in one of them whole, and bands
that meet the bound are verified by banded alignment.

The item index is broadcast after its size has been checked; a larger benchmark
is cut into blocks of at most that size, each of which sees all documents.
Documents are read whole, in pieces that overlap by the longest region.

Text is compared as lower-cased (A-Z) UTF-8 with white space runs as one space.

Defined cases: null texts are empty; items shorter than q bytes match nowhere;
an item's edit budget is the smaller of rate * L and what keeps the bound at 1;
repeated items and repeated rows are reported each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

Q = 8
RATE = 0.1
#: Most bytes of item text in a broadcast index.
BLOCK_BYTES = 16 << 20
#: Bytes of document text looked up at once.
PIECE = 1 << 21
TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def budget(length: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in an item: the q-gram bound stays at least 1."""
    return max(0, min(int(rate * length), (length - q) // q))


def grams(data: bytes | np.ndarray, q: int = Q) -> np.ndarray:
    """All q-grams of eight bytes as integers, without copying."""
    n = len(data) - q + 1
    return np.ndarray((max(0, n),), np.dtype("<u8"), data, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Index:
    ids: list
    texts: list[bytes]
    table: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    length: np.ndarray


def build(items: list[tuple[object, bytes]], rate: float = RATE) -> Index:
    items = [(i, t) for i, t in items if len(t) >= Q]
    g = [grams(t) for _, t in items]
    key = np.concatenate(g) if g else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(x) for x in g])
    pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
    order = np.lexsort((pos, item, key))
    key, item, pos = key[order], item[order], pos[order]
    keys, first = np.unique(key, return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(keys)] = True
    length = np.array([len(t) for _, t in items], np.int64)
    e = np.array([budget(n, rate=rate) for n in length], np.int64)
    return Index([i for i, _ in items], [t for _, t in items], table, keys, np.append(first, len(key)), item, pos, e, length - Q + 1 - Q * e, length)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * _MIX) >> np.uint64(64 - TABLE_BITS)


def banded(item: bytes, text: bytes, base: int, width: int, e: int) -> tuple[int, int, int] | None:
    """The fewest edits, at most e, with which the item occurs in the text on the diagonals base to base + width - 1.

    Returns (edits, start, end), of equals the first end.  Row k holds the cells
    (k, base + k + d); start and end in the text are free, so this is a search.
    """
    lo, hi = max(0, base), max(0, base + width + len(item))
    if (i := text.find(item, lo, hi)) >= 0:
        return 0, i, i + len(item)
    pad = b"\xff" * max(0, -base) + text[lo:hi]
    t = np.frombuffer(pad + b"\xff" * (width + len(item) - len(pad)), np.uint8)
    d, big = np.arange(width), e + 1
    cost, start = np.zeros(width, np.int64), d.copy()
    for k, c in enumerate(item):
        diag = cost + (t[k : k + width] != c)
        up = np.append(cost[1:] + 1, big)
        take = up < diag
        new, src = np.where(take, up, diag), np.where(take, np.append(start[1:], 0), start)
        # A run of insertions: the least of cost - position so far.
        low = np.minimum.accumulate(new - d)
        arg = np.maximum.accumulate(np.where(new - d == low, d, 0))
        cost, start = np.minimum(low + d, big), src[arg]
        if cost.min() >= big:
            return None
    best = int(cost.argmin())
    size = len(text)
    return int(cost[best]), min(size, max(0, base + int(start[best]))), min(size, max(0, base + len(item) + best))


def search(texts: list[bytes], ix: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) for each item in each text: its best region, the first of equals."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    over = int((ix.length + 2 * ix.budget).max()) + Q if len(ix.length) else 0
    buf = bytearray()
    if not len(ix.length):
        return []

    def flush() -> None:
        data = bytes(buf)
        g = grams(data)
        at = np.flatnonzero(ix.table[_slot(g)])
        if len(at):
            key = g[at]
            k = np.searchsorted(ix.keys, key)
            k[k == len(ix.keys)] = 0
            ok = ix.keys[k] == key
            at, k = at[ok], k[ok]
        if not len(at):
            return
        base = np.array([o for _, o, _ in places], np.int64)
        reps = ix.first[k + 1] - ix.first[k]
        post = np.repeat(ix.first[k], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        p, item, ipos = np.repeat(at, reps), ix.item[post], ix.pos[post]
        doc = np.searchsorted(base, p, "right") - 1
        width = ix.budget[item] + 1
        band = (p - ipos + (1 << 20)) // width
        rows = np.concatenate([np.stack([doc, item, band, ipos]), np.stack([doc, item, band - 1, ipos])], axis=1)
        code = ((rows[0] * len(ix.ids) + rows[1]) << 24) + rows[2]
        order = np.lexsort((rows[3], code))
        code, ipos = code[order], rows[3][order]
        new = np.append(True, (code[1:] != code[:-1]) | (ipos[1:] != ipos[:-1]))
        bands, counts = np.unique(code[new], return_counts=True)
        pair = bands >> 24
        it = pair % len(ix.ids)
        for c in np.flatnonzero(counts >= ix.need[it]):
            i, d = int(it[c]), int(pair[c]) // len(ix.ids)
            e = int(ix.budget[i])
            text, off, piece = places[d]
            lo = (int(bands[c]) & (1 << 24) - 1) * (e + 1) - (1 << 20) - off - e
            if (hit := banded(ix.texts[i], piece, lo, 4 * e + 2, e)) is not None:
                best = (hit[0], hit[1] + starts[d], hit[2] + starts[d])
                if best < out.get((text, i), (1 << 30, 0, 0)):
                    out[text, i] = best

    places: list[tuple[int, int, bytes]] = []
    starts: list[int] = []
    for n, t in enumerate(texts):
        for s in range(0, max(1, len(t) - over if len(t) > PIECE else 1), PIECE):
            piece = t[s : s + PIECE + over] if len(t) > PIECE else t
            if buf and len(buf) + len(piece) > PIECE + over:
                flush()
                buf.clear()
                places.clear()
                starts.clear()
            places.append((n, len(buf), piece))
            starts.append(s)
            buf += piece + b"\x00" * Q
    if buf:
        flush()
    return [(n, i, *v) for (n, i), v in out.items()]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size; rows come to the driver a partition at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        t = normalise(r[1])
        if block and size + len(t) > limit:
            yield block
            block, size = [], 0
        block.append((r[0], t))
        size += len(t)
    if block:
        yield block


SCHEMA = "doc_id bigint, item_id bigint, edits int, region_start bigint, region_end bigint, item_bytes bigint"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, limit: int = BLOCK_BYTES) -> DataFrame:
    """A row per document row and item that occurs in it: its best region, in bytes of the normalised text."""
    import pyarrow as pa

    spark = docs.sparkSession
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") and not c.endswith("bigint") else pa.int64()) for c in SCHEMA.split(", ")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))), limit):
        shared = spark.sparkContext.broadcast(build(block, rate))

        def run(batches: Iterator, shared=shared) -> Iterator:
            ix = shared.value
            for b in batches:
                ids = b.column(0)
                hits = search([normalise(t) for t in b.column(1).to_pylist()], ix)
                hits.sort()
                yield pa.RecordBatch.from_pydict({"doc_id": [ids[h[0]].as_py() for h in hits], "item_id": [ix.ids[h[1]] for h in hits], "edits": [h[2] for h in hits], "region_start": [h[3] for h in hits], "region_end": [h[4] for h in hits], "item_bytes": [int(ix.length[h[1]]) for h in hits]}, schema=schema)

        out = out.unionByName(rows.mapInArrow(run, SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item occurs, all columns as they came; no shuffle."""
    spark = docs.sparkSession
    for block in _blocks(benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))), limit):
        shared = spark.sparkContext.broadcast(build(block, rate))

        docs = docs.filter(_clean(shared)(text_of(docs)))
    return docs


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        hit = {h[0] for h in search([normalise(t) for t in text], shared.value)}
        return pd.Series([i not in hit for i in range(len(text))], dtype=bool)

    return clean
