"""SimHash near-duplicates through a grid over segment popcounts.

Fingerprints: XXH64 of word shingles, bit by bit majority (Arrow batches).

Links: a fingerprint is embedded as the bit counts of its 32 two-bit segments.
Two fingerprints that differ in d bits are at Manhattan distance <= d in that
embedding, and the differing segments lie in at most d of B blocks.  So a
linked pair has equal counts in some B-d blocks, that is, meets in a cell of
the grid over those coordinates; cells are equi-joined, the Manhattan distance
over all segments is tested as a lower bound, and the bits are compared last.

A crowded cell is not joined with itself.  A linked pair that meets there has
equal bits in the kept blocks and differs only in the dropped ones, so each
fingerprint is keyed by every way to clear d bits of the dropped blocks; those
with one key all link to each other, and a star to the smallest has the same
components.  That costs a fixed number of rows per fingerprint, not the square.

Equal fingerprints are one node from the start: copies are never paired.

Defined cases: null text is empty; no words give fingerprint 0, which links
like any other; a null doc_id is never the smallest unless all are null;
repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, materialize, text_of

SHINGLE, BITS_APART, BLOCKS, SEED = 3, 2, 6, 42
#: Above this many fingerprints, a cell is linked by stars.
CROWDED = 512
#: Shingles hashed at once.
STEP = 1 << 16


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, some at a time; a shorter text is one shingle, no words give none."""
    from xxhash import xxh64_intdigest as h64

    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if n == 0:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(width, n)
    a, b = starts[: n - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    for i in range(0, len(a), STEP):
        yield np.array([h64(joined[x:y], SEED) for x, y in zip(a[i : i + STEP], b[i : i + STEP], strict=True)], np.uint64)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of another family, from XXH64 by multiplication and shifts; family 0 is XXH64 itself."""
    if lane == 0:
        return h
    h = h * np.uint64(0x9E3779B97F4A7C15 * (2 * lane + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct hashes, in order."""
    found = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (bigint with the fingerprint's bits)."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    text = text_of(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def majority(shingles: np.ndarray, lanes: int) -> list[int]:
    """The fingerprints of a set of shingles, one for each hash family."""
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(shingles), STEP):
        for i in range(lanes):
            counts[i] += np.unpackbits(_lane(shingles[at : at + STEP], i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(n: int) -> list[list[int]]:
    """Bit positions of each block; a block holds whole two-bit segments."""
    return [[2 * s + k for s in seg.tolist() for k in (0, 1)] for seg in np.array_split(np.arange(32), n)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def segment_counts(fp: Column) -> Column:
    """All 32 segment counts at once, each in its two bits."""
    m = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(m), F.shiftrightunsigned(fp, 1).bitwiseAND(m)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of the counts of the eight byte segments: at most that of the two-bit ones, at most the bits apart."""
    out = F.lit(0)
    for i in range(8):
        m = F.lit(_signed(0xFF << (8 * i)))
        out = out + F.abs(F.bit_count(a.bitwiseAND(m)) - F.bit_count(b.bitwiseAND(m)))
    return out


def links(fps: DataFrame, apart: int = BITS_APART, blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """fps: distinct fp.  Returns a, b: edges with the components that all links of at most ``apart`` bits have."""
    bits = _blocks(blocks)
    drops = list(itertools.combinations(range(blocks), apart))
    v = segment_counts(F.col("fp"))
    cells = [F.struct(F.lit(i).cast("short").alias("t"), v.bitwiseAND(F.lit(_signed(_mask(x for j in range(blocks) if j not in d for x in bits[j])))).alias("cell")) for i, d in enumerate(drops)]
    grid = materialize(fps.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.t", "c.cell"), "simhash-grid")
    sizes = grid.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(grid.join(sizes, ["t", "cell"]), "simhash-cells")
    a = shared.filter(F.col("n") <= crowded).select("t", "cell", F.col("fp").alias("a"))
    b = a.select(F.col("t").alias("t2"), F.col("cell").alias("cell2"), F.col("a").alias("b"))
    near = (F.col("a") < F.col("b")) & (manhattan(F.col("a"), F.col("b")) <= apart) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart)
    out = a.join(b, (F.col("t") == F.col("t2")) & (F.col("cell") == F.col("cell2")) & near).select("a", "b").distinct()
    hot = shared.filter(F.col("n") > crowded)
    if not hot.limit(1).isEmpty():
        for i, d in enumerate(drops):
            free = [x for j in d for x in bits[j]]
            clear = F.transform(F.array(*[F.lit(_signed(~_mask(c) & (1 << 64) - 1)) for c in itertools.combinations(free, apart)]), lambda m: F.col("fp").bitwiseAND(m))
            keyed = hot.filter(F.col("t") == i).select("fp", F.posexplode(clear).alias("p", "key"))
            least = keyed.groupBy("p", "key").agg(F.min("fp").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
            out = out.unionByName(keyed.join(least, ["p", "key"]).filter("a < fp").select("a", F.col("fp").alias("b")))
        out = out.distinct()
    return materialize(out, "simhash-links")


#: Edges up to which the rest of a graph is joined up in one task.
FEW_EDGES = 10_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  Returns node, root: the smallest node that it reaches.

    Each round every node hooks to the neighbour (or itself) whose hash is least
    in that round, two steps at once; edges are renamed to where their ends went
    and those inside one node go.  A constant share of the nodes goes in each
    round, whatever their order, until FEW_EDGES are left, which one task joins
    up.  Names are composed from the smallest round back, so all rounds together
    cost little more than the first.
    """
    cur = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while cur.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        rank = lambda c, i=len(steps): F.struct(F.xxhash64(F.lit(i), c).alias("r"), F.col(c).alias("c"))
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["c"].alias("up")), "cc-hook")
        step = materialize(hook.join(hook.select(F.col("node").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid")).select("node", F.col("top").alias("up")), "cc-step")
        steps.append(step)
        x, y = step.select(F.col("node").alias("a"), F.col("up").alias("ua")), step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        cur = materialize(cur.join(x, "a").join(y, "b").filter("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-edges")
    total = materialize(cur.repartition(1).mapInArrow(_union, "node bigint, up bigint"), "cc-rest")
    if not steps:
        return total.select("node", F.col("up").alias("root"))
    for step in steps[::-1]:
        later = total.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        total = step.join(later, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("top", "up").alias("up"))
    total = materialize(total, "cc-total")
    names = total.groupBy("up").agg(F.min("node").alias("root"))
    return materialize(total.join(names, "up").select("node", "root"), "cc")


def _union(batches: Iterator) -> Iterator:
    """Edges of one task: each node with the smallest that it reaches."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], ["node", "up"])


def near_duplicates(docs: DataFrame, width: int = SHINGLE, apart: int = BITS_APART, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, th, fp, component_id for each row."""
    rows = materialize(fingerprints(docs, width), "simhash-fp")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    cc = components(links(reps.select("fp"), apart, blocks))
    roots = reps.join(cc, reps["fp"] == cc["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    named = roots.join(ids, roots["root"] == ids["r"]).select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, rows["fp"] == named["f"]).select("doc_id", "th", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Similar texts: five-word shingles, Jaccard similarity of their sets.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Hash families (64 bits each), grid cells of each text in each round, and two-bit segments whose counts a cell keeps.
LANES, ROUNDS, KEPT = 4, (8, 16), 16
#: Bits of the first family in which the texts of a cell may differ; what differs in more is left to the prefix filter.
WIDE_APART = 24
#: Fingerprints of a cell between which one spanning forest is taken.
SPAN = 1024
#: Shingles whose hash has this many leading zeros are counted for every text: a quarter, more than a prefix has.
ZEROS = 2


def prefix_size(n, similarity: float):
    """How many shingles of a set of n, in an order common to all sets, similar sets must share one of."""
    return n - np.ceil(similarity * n - 1e-6).astype(int) + 1 if isinstance(n, np.ndarray) else n - F.ceil(similarity * n - 1e-6) + 1


def text_nodes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """th, n (distinct shingles), fp, l1 ..., first (shingles with the smallest hashes: all with ZEROS, and no fewer than a prefix) of each text."""
    import pyarrow as pa

    lanes = ["fp", *[f"l{i}" for i in range(1, LANES)]]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle_set(text, width)
                many = max(int(np.searchsorted(s, np.uint64(1 << 64 - ZEROS))), min(len(s), int(prefix_size(np.array(len(s)), similarity))))
                # All texts without shingles share this one.
                first = s[:many].view(np.int64) if len(s) else np.zeros(1, np.int64)
                fps = np.array(majority(s, LANES), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([th]), pa.array([len(s)]), *[pa.array(fps[i : i + 1]) for i in range(LANES)], pa.array([first], pa.list_(pa.int64()))], ["th", "n", *lanes, "first"])

    texts = docs.select(F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("text"))
    made = texts.mapInArrow(run, "th bigint, n bigint, " + ", ".join(f"{c} bigint" for c in lanes) + ", first array<bigint>")
    return made


def _tables() -> list[list[int]]:
    """For each cell: the segments, of all families, whose counts it keeps; fixed by a seed."""
    draw = random.Random(SEED)
    return [draw.sample(range(32 * LANES), KEPT) for _ in range(sum(ROUNDS))]


def unary(fp: np.ndarray) -> np.ndarray:
    """All 32 segment counts at once, each in unary in its two bits: the bits apart of two are their Manhattan distance."""
    x, m = fp.view(np.uint64), np.uint64(0x5555555555555555)
    low, high = x & m, x >> np.uint64(1) & m
    return (low & high) << np.uint64(1) | low | high


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """nodes: th, fp.  Returns a, b (a < b): pairs to verify, of texts that op9's grid links.

    Each fingerprint goes with one of those linked to it, chosen by a hash so
    that no text is in most pairs; each text with one of its own fingerprint, in
    SALTS stars whose centres make another.
    """
    rows = nodes.select("th", "fp", F.pmod(F.xxhash64("th"), F.lit(SALTS)).alias("salt"))
    hubs = materialize(rows.groupBy("fp", "salt").agg(F.min("th").alias("hub")), "simhash-hubs")
    reps = hubs.groupBy("fp").agg(F.min("hub").alias("rep"))
    near = links(reps.select("fp"))
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.col("b"))).alias("m")).select("a", "m.b")
    x, y = (reps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
    pairs = [hook.join(x, "a").join(y, "b").select("ra", "rb"), hubs.join(reps, "fp").select("rep", "hub"), rows.join(hubs, ["fp", "salt"]).select("hub", "th")]
    return pairs[0].union(pairs[1]).union(pairs[2]).toDF("x", "y").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def wide_candidates(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """nodes: th, root, fp, l1 ...  Returns a, b (a < b): pairs to verify, of different roots.

    Texts whose kept segments have equal bit counts meet in a cell of the grid
    over those coordinates.  Of each SPAN of a cell come the edges of the minimum
    spanning forest between roots under the bits apart, of at most WIDE_APART,
    with the Manhattan distance of all counts as a lower bound; so never more
    than its fingerprints.
    """
    import pyarrow as pa

    kept = np.array(tables)
    many = len(kept)

    def cells(batches: Iterator) -> Iterator:
        for batch in batches:
            th, root, *lanes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            lanes = np.column_stack(lanes)
            for i in range(0, len(lanes), STEP // many):
                fps = np.ascontiguousarray(lanes[i : i + STEP // many])
                counts = (unary(fps)[:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(np.int64).reshape(len(fps), -1)
                cell = (np.arange(many) << 2 * KEPT) + (counts[:, kept] << 2 * np.arange(KEPT)).sum(axis=2)
                each = [np.repeat(x[i : i + STEP // many], many) for x in (lanes[:, 0], th, root)]
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), *map(pa.array, each)], ["cell", "fp", "th", "root"])

    def run(batches: Iterator) -> Iterator:
        held = [np.empty(0, np.int64)] * 4
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, b.columns, strict=True)]
            # Of a cell that goes on in the next batch, all but the last SPAN are done now.
            n = len(held[0])
            end = n if b is None else max(int(np.searchsorted(held[0], held[0][-1])), n - SPAN) if n else 0
            if end:
                pairs = _forests(*(c[:end] for c in held))
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])
                held = [c[end:] for c in held]

    grid = nodes.select("th", "root", "fp", *[f"l{i}" for i in range(1, LANES)]).mapInArrow(cells, "cell bigint, fp bigint, th bigint, root bigint")
    return grid.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def _bits(x: np.ndarray) -> np.ndarray:
    """One-bits of each; of a signed number numpy would count those of its magnitude."""
    return np.bitwise_count(x.view(np.uint64))


def _forests(cell: np.ndarray, fp: np.ndarray, th: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Sorted cells: edges (th, th) of the spanning forests of their spans; neighbouring spans have one row in common."""
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(first, len(cell)))
    two = first[size == 2]
    two = two[root[two] != root[two + 1]]
    two = two[_bits(unary(fp[two]) ^ unary(fp[two + 1])) <= WIDE_APART]
    two = two[_bits(fp[two] ^ fp[two + 1]) <= WIDE_APART]
    out = [np.column_stack((th[two], th[two + 1]))]
    for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        for j in range(i, i + n - 1, SPAN - 1):
            k = slice(j, min(j + SPAN, i + n))
            if (root[k] != root[j]).any():
                out.append(_forest(fp[k], th[k], root[k], WIDE_APART))
    return np.concatenate(out)


def _forest(fp: np.ndarray, th: np.ndarray, root: np.ndarray, apart: int = 64) -> np.ndarray:
    """Prim's algorithm; rows of one root lie together from the start, and no edge is longer than ``apart``."""
    fp, th, root, edges = fp.copy(), th.copy(), root.copy(), []
    u = unary(fp)
    x, xu, xt, xr, rest = fp[0], u[0], th[0], root[0], len(fp) - 1
    fp, u, th, root = fp[1:], u[1:], th[1:], root[1:]
    near, by = np.full(rest, 127, np.int16), np.zeros(rest, np.int64)
    while rest:
        d = _bits(u ^ xu).astype(np.int16)
        close = d <= apart
        d[close] = _bits(fp[close] ^ x)
        d[root == xr] = -1
        closer = d < near
        near[closer], by[closer] = d[closer], xt
        k = int(near.argmin())
        x, xu, xt, xr = fp[k], u[k], th[k], root[k]
        if 0 <= near[k] <= apart:
            edges.append((xt, by[k]))
        rest -= 1
        for c in (fp, u, th, root, near, by):
            c[k] = c[rest]
        fp, u, th, root, near, by = (c[:rest] for c in (fp, u, th, root, near, by))
    return np.array(edges, np.int64).reshape(-1, 2)


#: Up to this many texts of pairs, their hashes (8 bytes each) are broadcast, so that no other text is shuffled.
BROADCAST_ENDS = 1_000_000
#: Longs of a text's parity.
PARITY_WORDS = 4


def parity(s: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """For each of 64 * words buckets, whether an odd number of the hashes fall in it.

    Two sets' parities differ in no more bits than there are hashes in just one of them.
    """
    at = np.bincount((s >> np.uint64(8)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """th, s, p: the shingle sets of those texts whose hashes are in ends (th, distinct), and their parities."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, width)
                yield pa.RecordBatch.from_arrays([pa.array([th], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64())), pa.array([parity(s)], pa.list_(pa.int64()))], ["th", "s", "p"])

    if ends.count() <= BROADCAST_ENDS:
        ends = F.broadcast(ends)
    texts = docs.select(F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("text")).join(ends, "th", "left_semi")
    return materialize(texts.mapInArrow(run, "th bigint, s array<bigint>, p array<bigint>").dropDuplicates(["th"]), "simhash-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: a, b, hashes of texts.  Those whose shingle sets are similar enough; two empty sets are."""
    x, y = sets.select(F.col("th").alias("a"), F.col("s").alias("sa")), sets.select(F.col("th").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").filter(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def ends_of(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), "simhash-ends")


def _across(tokens: DataFrame) -> DataFrame:
    """tokens: token, th, root and others.  Those rows whose token texts of several roots have, with df: how many texts."""
    w = Window.partitionBy("token")
    spread = tokens.withColumns({"lo": F.min("root").over(w), "hi": F.max("root").over(w), "df": F.count("*").over(w)})
    return spread.filter("lo < hi").drop("lo", "hi")


def alone_dropped(nodes: DataFrame, cc: DataFrame, similarity: float) -> DataFrame:
    """th, n, root of the texts that may be similar to one of another root, by their first shingles alone.

    In the order (counted shingles by their texts, then the others by hash) the
    prefix of a text starts with those that no other root has.  If there is
    nothing else in it, the text has no partner.
    """
    rows = nodes.join(cc, nodes["th"] == cc["node"]).select("th", "root", F.explode("first").alias("token"))
    counted = (F.shiftrightunsigned("token", 64 - ZEROS) == 0).cast("int")
    seen = _across(rows).groupBy("th", "root").agg(F.sum(counted).alias("s"), F.sum(1 - counted).alias("other"))
    sized = nodes.select(F.col("th").alias("t2"), "n", F.size(F.filter("first", lambda t: F.shiftrightunsigned(t, 64 - ZEROS) == 0)).alias("all"))
    may = ((F.col("s") > 0) & (F.col("all") - F.col("s") < prefix_size(F.col("n"), similarity))) | (F.col("other") > 0)
    return materialize(seen.join(sized, F.col("th") == F.col("t2")).filter(may).select("th", "n", "root"), "simhash-may")


def missing_pairs(may: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """may: th, n, root; sets: their shingles.  Returns a, b: among them all similar pairs of texts with different roots.

    Prefix filter in the order (shingles by the number of their texts, hash),
    where shingles of one root count as of one text: sets of the similarity share
    one of their prefixes; at the first that they share, sizes and positions
    leave room for the overlap, and the parities of the whole sets differ in no
    more bits than similar sets may differ in shingles.  Texts of the root that
    is largest at a shingle are not matched with each other.
    """
    rows = sets.withColumn("token", F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit(0).cast("long"))))).select("th", "token")
    met = _across(rows.join(may.select("th", "root"), "th")).join(may.select("th", "n"), "th")
    w = Window.partitionBy("th")
    ranked = met.withColumns({"rank": F.row_number().over(w.orderBy("df", "token")), "m": F.count("*").over(w)})
    ranked = ranked.withColumn("pos", F.greatest(F.col("n"), F.lit(1)) - F.col("m") + F.col("rank") - 1)
    left = materialize(ranked.filter(F.col("pos") < prefix_size(F.col("n"), similarity)).select("token", "th", "n", "pos", "root"), "simhash-prefixes")
    marks = sets.select("th", *[F.col("p")[i].alias(f"p{i}_") for i in range(PARITY_WORDS)])
    sizes = left.groupBy("token", "root").agg(F.count("*").alias("m"))
    big = sizes.groupBy("token").agg(F.max(F.struct("m", "root"))["root"].alias("big"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    sides = materialize(left.join(big, "token").join(marks, "th"), "simhash-sides")
    x, y = (sides.select("token", "big", *[F.col(c).alias(f"{c}{i}") for c in ("th", "n", "pos", "root", *[f"p{j}_" for j in range(PARITY_WORDS)])]) for i in (1, 2))
    x = x.filter("root1 != big").drop("big")
    need = similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-6
    fits = (F.least("n1", "n2") >= similarity * F.greatest("n1", "n2") - 1e-6) & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need)
    differ = sum((F.bit_count(F.col(f"p{j}_1").bitwiseXOR(F.col(f"p{j}_2"))) for j in range(PARITY_WORDS)), F.lit(0))
    fits = fits & (differ <= F.col("n1") + F.col("n2") - 2 * need)
    once = ((F.col("root2") == F.col("big")) & (F.col("root1") != F.col("big"))) | ((F.col("root2") != F.col("big")) & (F.col("root1") < F.col("root2")))
    return x.join(y, (x["token"] == y["token"]) & fits & once).select(F.least("th1", "th2").alias("a"), F.greatest("th1", "th2").alias("b")).distinct()


def text_groups(docs: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, root for each distinct text (by hash): root is one for those joined by chains of similar pairs.

    Candidates come from op9's grid on the first family's fingerprints, then from
    rounds of wider cells over the segment counts of all families, each verified
    on the shingle sets of whole texts; what is joined in one round is one group
    in the next, so large groups yield few pairs.  Wide cells are drawn at random; then a
    prefix filter gives every similar pair that still lies in two groups,
    verified likewise, so no link is lost.  Most texts drop out of it by a
    quarter of their shingles, and only the others' are all counted.  Copies are
    one node, so a group of copies is never paired.
    """
    nodes = text_nodes(docs, width, similarity)
    nodes = materialize(nodes.groupBy("th").agg(*[F.first(c).alias(c) for c in nodes.columns[1:]]), "simhash-nodes")
    cc = nodes.select(F.col("th").alias("node"), F.col("th").alias("root"))

    def join_up(pairs: DataFrame, sets: DataFrame, cc: DataFrame) -> DataFrame:
        """cc after the groups of those pairs that pass verification are joined."""
        found = verified(pairs, sets, similarity)
        a, b = cc.select(F.col("node").alias("a"), F.col("root").alias("ra")), cc.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = components(found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moved = joined.select(F.col("node").alias("was"), F.col("root").alias("now"))
        return materialize(cc.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")), "simhash-roots")

    pairs = materialize(grid_pairs(nodes), "simhash-pairs")
    cc, done = join_up(pairs, shingle_sets(docs, ends_of(pairs), width), cc), 0
    for many in ROUNDS:
        pairs = materialize(wide_candidates(nodes.drop("first", "n").join(cc, nodes["th"] == cc["node"]), _tables()[done : done + many]), "simhash-pairs")
        cc = join_up(pairs, shingle_sets(docs, ends_of(pairs), width), cc)
        done += many
    may = alone_dropped(nodes, cc, similarity)
    sets = shingle_sets(docs, may.select("th"), width)
    return join_up(materialize(missing_pairs(may, sets, similarity), "simhash-pairs"), sets, cc)


def similar_groups(docs: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th, root for each row."""
    cc = text_groups(docs, width, similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("th"))
    return rows.join(cc, rows["th"] == cc["node"]).select("doc_id", "th", "root")


def keep_one(docs: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id (then text hash), all columns as they came."""
    cc = text_groups(docs, width, similarity)
    cols = docs.columns
    rows = docs.withColumn("__th", F.xxhash64(text_of(docs)))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__th").alias("th"))
    # The least row of each text first, so copies meet in partial aggregates and not in one task.
    least = rows.groupBy("__th").agg(F.min(key).alias("k"))
    kept = least.join(cc, F.col("__th") == F.col("node")).groupBy(F.col("root").alias("r")).agg(F.min("k").alias("k"))
    kept = materialize(kept.select(F.col("k.id").alias("k_id"), F.col("k.th").alias("k_th")), "simhash-kept")
    hit = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("__th") == F.col("k_th")), "left_semi")
    w = Window.partitionBy("doc_id", "__th").orderBy(F.lit(1))
    return hit.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(*[F.col(f"`{c}`") for c in cols])
