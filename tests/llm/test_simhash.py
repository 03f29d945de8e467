import random

import numpy as np
import pytest
import xxhash

from semifold.llm import simhash
from tests.oracle import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expect(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, format(f, "016x"), least.get(c)) for (d, _), f, c in zip(rows, fps, comp, strict=True)), key=repr)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in simhash.digest(df).collect()), key=repr) == expect(rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "One"), (8, "one"), (None, "a b"), (1, "a b"), (1, "a b"), (7, "w " * 20000), (6, "É b c\x0bd"), (2, "é b c d")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in simhash.digest(df).collect()), key=repr) == expect(rows)
    assert simhash.digest(df.limit(0)).count() == 0


def test_links_with_and_without_crowded_cells(spark, monkeypatch):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds[:6]:
        for _ in range(40):
            fps.add(s ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64) if rnd.random() < 0.3 else 0))
    fps = sorted(fps)
    comp = brute_components(fps)
    want = {frozenset(f for f, c in zip(fps, comp, strict=True) if c == k) for k in set(comp) if comp.count(k) > 1}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    for crowded, few in ((10_000, 10_000), (3, 0)):
        monkeypatch.setattr(simhash, "FEW_EDGES", few)
        groups = {}
        for r in simhash.components(simhash.links(df, crowded=crowded)).collect():
            groups.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
        assert {frozenset(g) for g in groups.values()} == want


@pytest.mark.parametrize("few", [40, 10_000])
def test_long_chains_converge(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_EDGES", few)
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a bigint, b bigint")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y)


def test_similar_groups_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted({r["text"] or "" for r in df.collect()})
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s or {b""}:
            holders.setdefault(x, []).append(i)
    shared = {(i, j) for h in holders.values() for j in h for i in h if i < j}
    pairs = {(i, j) for i, j in shared if similar(sets[i], sets[j])}
    root = {r["text"] or "": r["root"] for r in simhash.similar_groups(df).join(df.select("doc_id", "text"), "doc_id").collect()}
    found = sum(root[texts[i]] == root[texts[j]] for i, j in pairs)
    assert len(root) == len(texts) and pairs and found == len(pairs)
    # Nothing joins that a chain of similar pairs does not.
    near = {i: {i} for i in range(len(texts))}
    for i, j in pairs:
        both = near[i] | near[j]
        near.update(dict.fromkeys(both, both))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(root[t], []).append(i)
    assert all(set(g) <= near[g[0]] for g in groups.values())


def test_a_large_group_of_near_copies_keeps_one(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = []
    for d in range(1200):
        words = list(base)
        for _ in range(rnd.randrange(1, 5)):
            words[rnd.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(words), "en", "s", 1))
    assert [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_forest_is_a_least_spanning_forest_between_roots():
    rnd = np.random.default_rng(4)
    fps = np.unique(rnd.integers(-(2**63), 2**63 - 1, 40))
    th, root = np.arange(len(fps)) + 100, np.where(np.arange(len(fps)) < 10, 7, np.arange(len(fps)))

    up = {int(r): int(r) for r in root}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    least = 0
    for d, i, j in sorted((int(simhash._bits(fps[i : i + 1] ^ fps[j : j + 1])[0]), i, j) for i in range(len(fps)) for j in range(i)):
        if find(int(root[i])) != find(int(root[j])):
            up[find(int(root[i]))] = find(int(root[j]))
            least += d
    edges = simhash._forest(fps, th, root) - 100
    assert len(edges) == len(set(root.tolist())) - 1 and all(root[i] != root[j] for i, j in edges.tolist())
    assert sum(int(simhash._bits(fps[i : i + 1] ^ fps[j : j + 1])[0]) for i, j in edges.tolist()) == least
    # Cells are apart, and long ones are spanned in overlapping pieces.
    cell, n = np.array([1, 1, 2, 3, 3, 3]), np.arange(6)
    assert sorted(map(sorted, simhash._forests(cell, n, n, n).tolist())) == [[0, 1], [3, 5], [4, 5]]
    many = np.arange(3 * simhash.SPAN)
    assert len(simhash._forests(many * 0, many, many, many)) == len(many) - 1


def test_one_of_each_group_stays(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    long = " ".join(words[:400])
    rows = [(3, long), (1, long + " tail"), (9, long), (9, long), (2, " ".join(words[400:700])), (7, " ".join(words[600:900])), (None, long), (5, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2, 5, 7]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (5, "A B"), (6, "a c")], "doc_id bigint, text string").selectExpr("*", "1 as th", "2 as root", "3 as fp")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 4, 6]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_parities_never_differ_in_more_bits_than_sets_in_hashes():
    rnd = np.random.default_rng(5)
    for n, own in ((0, 0), (0, 3), (30, 1), (30, 6), (400, 40), (3000, 500)):
        both, a, b = (np.unique(rnd.integers(0, 2**64, k, np.uint64)) for k in (n, own, own))
        p, q = (simhash.parity(np.unique(np.concatenate((both, x)))) for x in (a, b))
        assert len(p) == simhash.PARITY_WORDS and int(simhash._bits(p ^ q).sum()) <= len(a) + len(b)
    assert simhash.parity(np.empty(0, np.uint64)).tolist() == [0] * simhash.PARITY_WORDS


def test_no_link_is_lost(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(30)]
    more = [" ".join(base[: 30 - i] + [f"x{j}" for j in range(i)]) for i in range(1, 10)]
    docs = df.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    texts = sorted({r["text"] or "" for r in docs.collect()})
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s or {b""}:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for i, j in {(i, j) for h in holders.values() for j in h for i in h if i < j} if similar(sets[i], sets[j])}

    # All of them where the cells find none, and few shingles are counted for every text.
    monkeypatch.setattr(simhash, "wide_candidates", lambda nodes, tables: nodes.sparkSession.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(simhash, "ZEROS", 4)
    root = {r["text"] or "": r["root"] for r in simhash.similar_groups(docs).join(docs, "doc_id").collect()}
    assert pairs and [(i, j) for i, j in pairs if root[texts[i]] != root[texts[j]]] == []


def test_wide_cells_are_a_grid_over_segment_counts(spark):
    # Equal counts in all segments, but in no byte equal bits: one of two bits here, the other there.
    rnd = random.Random(6)
    two = [sum(2 << 2 * rnd.randrange(4 * b, 4 * b + 4) for b in range(8)) for _ in range(simhash.LANES)]
    one = [x >> 1 for x in two]
    far = [simhash._signed(x ^ (1 << 64) - 1) for x in one]
    cols = "th bigint, root bigint, fp bigint, " + ", ".join(f"l{i} bigint" for i in range(1, simhash.LANES))
    nodes = spark.createDataFrame([(1, 1, *one), (2, 2, *[simhash._signed(x) for x in two]), (3, 3, *far)], cols)
    assert [tuple(r) for r in simhash.wide_candidates(nodes, simhash._tables()).collect()] == [(1, 2)]


def test_distance_of_counts_is_a_lower_bound_of_the_bits():
    rnd = np.random.default_rng(7)
    x, y = (rnd.integers(-(2**63), 2**63 - 1, 200) for _ in range(2))
    y[:100] = x[:100] ^ (1 << rnd.integers(0, 62, 100))
    count = lambda f, s: (int(f) >> 2 * s & 1) + (int(f) >> 2 * s + 1 & 1)
    apart = [sum(abs(count(a, s) - count(b, s)) for s in range(32)) for a, b in zip(x, y, strict=True)]
    got = simhash._bits(simhash.unary(x) ^ simhash.unary(y))
    assert got.tolist() == apart and (got <= simhash._bits(x ^ y)).all()


def test_pairs_of_a_cell_are_near_in_counts_and_bits():
    n = 50
    fp = np.array([0, 1, -1, -2] + [0] * (n - 4))
    cell = np.array([1] * 4 + [2, 2] + [3] * (n - 6))
    fp[4], fp[5] = 5, ~5
    ids = np.arange(n)
    edges = {tuple(sorted(e)) for e in simhash._forests(cell, fp, ids, ids).tolist()}
    assert {e for e in edges if e[1] < 6} == {(0, 1), (2, 3)} and len(edges) == 2 + (n - 6) - 1
    # Far in bits, though equal in all counts.
    a = np.array([0x1111111111111111 * 5, 0x1111111111111111 * 10 - (1 << 64)], np.int64)
    assert simhash._bits(simhash.unary(a[:1]) ^ simhash.unary(a[1:]))[0] == 0
    assert len(simhash._forests(np.zeros(2), a, ids[:2], ids[:2])) == 0 == len(simhash._forest(a, ids[:2], ids[:2], 24))


def test_the_stage_goes_through_op9s_grid(spark, monkeypatch):
    """Alone it joins the similar texts whose fingerprints it links, and none that are not similar."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "tail"]), " ".join(["head", *base[1:]]), " ".join(f"v{rnd.randrange(10**6)}" for _ in range(300)), "", " ", "\n"]
    fps = [simhash.majority(simhash.shingle_set(t, 5), 1)[0] if t.split() else 0 for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and (fps[0] ^ fps[2]).bit_count() <= 2
    none = lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(simhash, "wide_candidates", none)
    monkeypatch.setattr(simhash, "missing_pairs", none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 3, 4]
    # Texts of one fingerprint that are not similar stay apart.
    monkeypatch.setattr(simhash, "majority", lambda s, lanes: [0] * lanes)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs.filter("doc_id in (0, 3, 4)")).collect()) == [0, 3, 4]


def test_grid_pairs_of_many_texts_have_no_centre(spark):
    nodes = spark.range(3000).selectExpr("id as th", "if(id < 2000, 0, 1) as fp").union(spark.createDataFrame([(9000, 255), (9001, -1)], "th bigint, fp bigint"))
    pairs = [tuple(r) for r in simhash.grid_pairs(nodes).collect()]
    root = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert len(root) == 3000 and set(root.values()) == {0} and len(pairs) <= 3000
    assert max(np.unique(np.array(pairs).ravel(), return_counts=True)[1]) < 300
