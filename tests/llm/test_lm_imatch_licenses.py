import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from semifold.llm import imatch, licenses, lm
from tests.oracle import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [(1, None), (2, ""), (5, "The cat sat on The mat"), (5, "The cat sat on The mat"), (None, "É zz"), (7, "the dog sat\n\non a mat " * 40), (9, "unseen words here"), (12, "w " * 5000)] + [(20 + i, f"the cat {i} and the dog {i % 3} sat on a mat number {i % 5}") for i in range(40)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)


def test_language_model(spark):
    toks = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(x for d, t in ROWS if not out(d) for x in toks(t))
    n, v = sum(c.values()), len(c)
    got = sorted(lm.score(frame(spark)).collect(), key=lambda r: repr((r["doc_id"], r["n_tokens"])))
    want = sorted(((d, out(d), len(toks(t)), sum(c[x] > 0 for x in toks(t)), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for d, t in ROWS), key=lambda r: repr((r[0], r[2])))
    for r, w in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (*w[:4], n)
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] <= 0
    assert lm.score(frame(spark).limit(0)).count() == 0


def test_probabilities_sum_to_one():
    p = lm.Params.start(np.full(20, 0.05))
    a, b, z = p.table()
    assert np.allclose(np.exp(a[:, None, :] + b[None, :, :] - z[:, :, None]).sum(2), 1, atol=1e-5)


@pytest.mark.parametrize("words", [6, 1280])
def test_score_is_the_model_applied_token_by_token(spark, monkeypatch, words):
    """One token after the other in plain Python, from the counts and the trained parameters."""
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "ENDINGS", 4)
    made = []
    monkeypatch.setattr(lm, "train", lambda ids, out, train=lm.train: made.append((train(ids, out), out)) or made[-1][0])
    outputs = lm.outputs
    monkeypatch.setattr(lm, "outputs", lambda counts: made.append(outputs(counts)) or made[-1])
    got = lm.score(frame(spark)).collect()
    (lex, out, _), (p, _) = made
    toks = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(x for d, t in ROWS if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for x in toks(t))
    of_hash = {int(h): int(w) for h, w in zip(lex.h, lex.word, strict=True)}
    place = lambda x: of_hash.get(lm._hash(x), 0) or lex.endings.get(lm.ending(x), 0)
    is_word = lambda x: bool(of_hash.get(lm._hash(x), 0))
    inside = {}
    for x, n in c.items():
        if not is_word(x):
            inside.setdefault(place(x), []).append(n)
    assert sum(map(is_word, c)) == min(words, len(c)) and len(lex.endings) == (4 if words == 6 else 0)

    def log_p(w1, w2, x):
        logits = p.q @ (p.c[0] * p.r[w1] + p.c[1] * p.r[w2]) + p.b
        out = (logits[place(x)] - np.log(np.exp(logits).sum())) / math.log(10)
        ns = inside.get(place(x), [])
        return out if is_word(x) else out + math.log10((c[x] + 1) / (sum(ns) + len(ns) + 1))

    def total(t):
        w, out = [place(b"\n")] * 2, 0.0
        for x in toks(t):
            out += log_p(*w[-2:], x)
            w.append(place(x))
        return out

    want = sorted((repr(d), len(toks(t)), total(t)) for d, t in ROWS)
    for r, w in zip(sorted(got, key=lambda r: (repr(r["doc_id"]), r["n_tokens"])), want, strict=True):
        assert r["n_tokens"] == w[1] and r["score"] == pytest.approx(w[2], abs=1e-3 * w[1])
    # Over all tokens that can follow, with one unseen of each class, probabilities sum to 1.
    unseen = [i for i in range(len(out.prior)) if i == 0 or i in lex.endings.values()]
    logits = p.q @ (p.c[0] * p.r[1] + p.c[1] * p.r[2]) + p.b
    share = sum(math.exp(logits[i]) / np.exp(logits).sum() / (sum(inside.get(i, [])) + len(inside.get(i, [])) + 1) for i in unseen)
    assert sum(10 ** log_p(1, 2, x) for x in c) + share == pytest.approx(1, abs=1e-6)


def test_the_model_beats_the_counts_and_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r for r in lm.score(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r for r in lm.score(docs.repartition(13)).collect()}
    assert one.keys() == many.keys() and all(r["score"] == pytest.approx(many[d]["score"], abs=1e-6 * r["n_tokens"]) for d, r in one.items())
    out = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out) > 0.2


def test_extra_columns_of_the_model(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "k")], "doc_id bigint, text string, rid int, score string")
    assert lm.score(df).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert lm.score(df).first()["n_tokens"] == 4


def x64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)


def chain(longs, seed=42):
    for x in longs:
        seed = x64((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_fingerprints(rows):
    """All of the contract's columns, row by row in plain Python."""
    text = {i: t or "" for i, (_, t) in enumerate(rows)}
    order = sorted(text, key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), -signed(x64(text[i].encode()))))
    terms = lambda t: {signed(x64(w.encode())) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}
    df = Counter(h for t in text.values() for h in terms(t))
    n = len(rows)
    lex = {h for h, c in df.items() if max(2, math.ceil(imatch.LOW * n)) <= c <= max(2, math.floor(imatch.HIGH * n))}

    def depth(h, family):
        g = chain([h])
        g = x64(family.to_bytes(4, "little"), g) & (1 << imatch.DEEPEST) - 1 | 1 << imatch.DEEPEST
        return g & -g

    def signature(t):
        every = sorted(terms(t))
        arr = [h for h in every if h in lex]
        if not arr:
            return ["~" + format(chain(every), "016x") if every else "empty"] + [""] * imatch.FAMILIES
        out = [format(chain(arr), "016x")]
        for f in range(imatch.FAMILIES):
            top = max(depth(h, f) for h in arr)
            out.append(format(chain([top, *[h for h in arr if depth(h, f) == top]]), "016x"))
        return out

    def likeness(a, b):
        return 1.0 if a[0] == b[0] else sum(x == y != "" for x, y in zip(a[1:], b[1:], strict=True)) / imatch.FAMILIES

    out = []
    for at, i in enumerate(order):
        t, k = text[i], len(text[i]) // 3
        other = text[order[(at + 1) % n]]
        edited = t[: len(t) - k] + other[:k]
        a, b, c = signature(t), signature(edited), signature(other)
        out.append((rows[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), "-".join(a), "-".join(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_fingerprints(spark):
    """Two rows of one id are ordered by their texts' hashes; ids may be null; one row is its own neighbour."""
    rows = [*ROWS, (100, "alone"), (101, "é" * 9), (102, "the  cat\tand\x0bdog " * 3000)]
    rows += [(500 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect())]
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in imatch.digest(df).collect()), key=repr)
    assert got == brute_fingerprints(rows)
    assert sorted((tuple(r) for r in imatch.digest(df.repartition(9)).collect()), key=repr) == got
    near = [r[5] for r in got if r[1] > 300]
    assert sum(near) / len(near) > 0.25 and sum(r[6] for r in got if r[1] > 300) / len(near) < 0.05
    assert [tuple(r) for r in imatch.digest(frame(spark, [(1, "abcdef")])).collect()] == brute_fingerprints([(1, "abcdef")])
    assert imatch.digest(frame(spark).limit(0)).count() == 0


def test_fingerprints_beside_other_columns(spark):
    df = frame(spark, ROWS).selectExpr("*", "'old' as fingerprint", "1 as h")
    got = imatch.fingerprints(df)
    assert got.columns == [c for c in df.columns if c != "fingerprint"] + ["fingerprint"]
    want = {(d, t): f for d, t, f in ((r[0], r[1], r[3]) for r in brute_fingerprints(ROWS))}
    assert sorted(repr((r["doc_id"], len(r["text"] or ""), r["fingerprint"])) for r in got.collect()) == sorted(repr((d, n, f)) for (d, n), f in want.items() for _ in range(sum(x == d and len(t or "") == n for x, t in ROWS)))


def test_licences_are_found_and_inherited(spark):
    files = [(0, "a/LICENSE", "Released under the MIT License."), (1, "a/b/x.py", "no word of it"), (2, "a/b/y.py", "code\nLicensed under the Apache License, Version 2.0.\nmore code follows here and there, and then some more of it"), (3, "c/z", "plain"), (4, None, None), (5, "a/b/c/d", ""), (6, "c/e", "the license of a poem")]
    df = spark.createDataFrame(files, "rid bigint, path string, text string")
    got = {r["rid"]: (r["license"], r["scope"], r["declared_by"]) for r in licenses.licences(df).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "own", None), 3: (None, None, None), 4: (None, None, None), 5: ("MIT", "inherited", "a"), 6: (None, None, None)}
    assert licenses.licences(df.limit(0)).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2021 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
CODE = "\n\nint main(int argc, char **argv) {\n  return run(argc, argv);\n}\n" * 60


def commented(text, mark, width=11):
    w = text.split()
    return "\n".join(f"{mark} {' '.join(w[i : i + width])}" for i in range(0, len(w), width)) + CODE


def test_real_licence_files_and_headers(spark):
    t = {}
    for name, text in licenses.TEXTS:
        t.setdefault(name, text)
    files = [
        ("mit/LICENSE", MIT_FILE, ("MIT", "own", None)),
        ("mit/src/deep/a.c", CODE, ("MIT", "inherited", "mit")),
        ("mit/src/b.c", commented(t["BSD-3-Clause"], "//"), ("BSD-3-Clause", "own", None)),
        ("two/b.c", commented(t["BSD-2-Clause"], " *"), ("BSD-2-Clause", "own", None)),
        ("gpl/x.py", commented(t["GPL-3.0"], "#"), ("GPL-3.0", "own", None)),
        ("gpl/y.py", commented(t["GPL-2.0"], "#"), ("GPL-2.0", "own", None)),
        ("gpl/z.py", commented(t["AGPL-3.0"], "#"), ("AGPL-3.0", "own", None)),
        ("gpl/w.py", CODE, (None, None, None)),
        ("ap/COPYING", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", ("Apache-2.0", "own", None)),
        ("ap/k", "", ("Apache-2.0", "inherited", "ap")),
        ("ap/h.js", commented(t["Apache-2.0"], "//", 9), ("Apache-2.0", "own", None)),
        ("mpl/h.js", commented(t["MPL-2.0"], "*", 13), ("MPL-2.0", "own", None)),
        ("spdx/h.js", "// SPDX-License-Identifier: ISC" + CODE, ("ISC", "own", None)),
        ("spdx/g.js", "# SPDX-License-Identifier: GPL-2.0\n" + CODE, ("GPL-2.0", "own", None)),
        ("no/a", "Permission to park here is granted to any person, free of charge.", (None, None, None)),
        ("no/b", "the general public was free to read the notice above", (None, None, None)),
        ("no/long", "word " * 200_000, (None, None, None)),
    ]
    df = spark.createDataFrame([(p, x, "kept", "gone") for p, x, _ in files], "path string, text string, rid string, license string")
    got = licenses.licences(df)
    assert got.columns == ["path", "rid", "license", "similarity", "scope", "declared_by"]
    rows = {r["path"]: (r["license"], r["scope"], r["declared_by"]) for r in got.collect()}
    assert rows == {p: w for p, _, w in files}


@pytest.mark.parametrize("few", [0, 100_000])
def test_similarities_equal_plain_tf_idf(spark, monkeypatch, few):
    """All lines and sentences of a table against all notices; joins broadcast or salted."""
    monkeypatch.setattr(licenses, "BROADCAST_KEYS", few)
    templates = licenses.NOTICES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    extra = [(10**6, "Released under the MIT Licence, the MIT License.", None), (10**6 + 1, "Licensed under the Mozilla Public License, Version 2.0. And under CC BY 4.0.", "x")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    vocab = {w for _, t in templates for w in licenses._terms(t)}
    df = Counter(w for t in texts.values() for w in vocab & set(re.split(r"[^a-z0-9.-]+|[.-](?![a-z0-9])", t.lower())))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocab}

    def vector(terms):
        v = {w: n * idf.get(w, 1.0) for w, n in Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    made = [(name, vector(licenses._terms(t))) for name, t in templates]
    want = {}
    for d, t in texts.items():
        for piece in re.split(licenses.PIECES, t):
            v = vector(licenses._terms(piece)) if licenses._terms(piece) else {}
            for name, m in made:
                cos = round(sum(x * m.get(w, 0.0) for w, x in v.items()), 6)
                if cos >= licenses.THRESHOLD:
                    want.setdefault(d, set()).add((-cos, name))
    path = "concat(coalesce(source, '_'), '/', doc_id)"
    got = {r["doc_id"]: (r["similarity"], r["license"]) for r in licenses.licences(docs.selectExpr("doc_id", f"{path} as path", "text"), templates=templates).collect() if r["scope"] == "own"}
    only_lines = {d: min(x) for d, x in want.items()}
    assert len(want) > 1 and want.keys() <= got.keys()
    assert all(got[d][0] >= -s - 2e-6 and (got[d][1] == name or got[d][0] > -s) for d, (s, name) in only_lines.items())


def test_ties_of_licences(spark):
    files = [("d/LICENSE", "Released under the MIT License."), ("d/COPYING", "Released under the ISC License."), ("d/x", "code"), ("d/x", "code")]
    got = sorted((r["path"], r["license"]) for r in licenses.licences(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == [("d/COPYING", "ISC"), ("d/LICENSE", "MIT"), ("d/x", "ISC"), ("d/x", "ISC")]
