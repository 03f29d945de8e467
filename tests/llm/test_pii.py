import hashlib
import itertools
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from semifold.llm import pii
from tests.oracle import SF


def of(text):
    return pii.nodes(text, pii.base_spans(text))


SEEN = ["pay 4111111111111111 or call +1 (555) 555-0100 now", "mail anna.b@mail.example.com today", "from 10.0.0.1 on, 1234567890123 times and 5550100200 more", "und 7986512 am 2024-01-31", "x +49 30 5550 1234 y", "jo.doe@host.org 192.168.7.20"]
W = pii.fit_weights([of(t) for t in SEEN] * 5)


def brute(t):
    """The contract's patterns as they stand."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pat, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pat, t):
            d = re.sub("[^0-9]", "", m.group())
            odd = [int(x) for x in d[::-1]]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
            if lo <= len(d) <= hi and (kind == "phone" or luhn):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "1", "4111111111111111", "0", "255", "256", " ", "-", "+", "(", ")", "x.com", "555", "1.2.3.4", "é", "\n"]), max_size=25).map("".join))
def test_base_equals_the_patterns(t):
    base, spans = pii.all_spans(t, W)
    assert base == brute(t) and set(base) <= set(spans)


def test_twins_follow_and_strangers_do_not():
    t = "call +1 (415) 555-0132 now. " + "word " * 80 + "again 1 415 555 0132 and 9 876 543 2109, mail jo@x.org or jo [at] x [dot] org"
    base, spans = pii.all_spans(t, W)
    more = [t[s:e] for s, e, _ in spans if (s, e) not in {(a, b) for a, b, _ in base}]
    assert len(base) == 2 and any("0132" in m for m in more) and not any("2109" in m for m in more)
    assert pii.redact_text("mail jo@x.org!", W) == "mail [EMAIL]!"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "a@b.co"), (2, "a@b.co"), (None, "1.2.3.4"), (3, "9" * 50_000), (4, "a" * 100_000 + "@"), (5, "1." * 20_000)]
    df = spark.createDataFrame([(d, t, None, None, 7) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pii.digest(df, W).collect()
    want = sorted(((d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in (pii.base_spans(t or ""))).encode()).hexdigest()) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=repr) == want
    red = pii.redact(df, W)
    assert red.columns == df.columns and {r["text"] for r in red.collect()} >= {None, "", "[EMAIL]", "[IP]"}
    assert pii.digest(df.limit(0)).count() == 0


def test_a_candidate_is_judged_with_or_without_pattern_spans():
    token = "4111.1111.1111.1111"
    far = " word" * 60 + " jo@x.org"
    for t in (f"no {token} here", f"no {token} here" + far):
        assert [x[:2] for x in pii.all_spans(t, W)[1] if x[2] == "card"] == [(3, 3 + len(token))]
    assert pii.redact_text(f"no {token} here", W) == "no [CARD] here"
    assert pii.all_spans("in 20240101 none", W) == ([], [])


HIDDEN = [
    ("reach jo [at] example [dot] org soon", "jo [at] example [dot] org", "email"),
    ("it is ann.lee (at) mail (dot) example (dot) net ok", "ann.lee (at) mail (dot) example (dot) net", "email"),
    ("write to bob at example dot com please", "bob at example dot com", "email"),
    ("ring (415) 555-0132 tonight", "(415) 555-0132", "phone"),
    ("or 212-555-0187 then", "212-555-0187", "phone"),
    ("fax: 4155550132 always", "4155550132", "phone"),
    ("seen at 203[.]0[.]113[.]77 before", "203[.]0[.]113[.]77", "ip"),
    ("seen at 198 . 51 . 100 . 7 before", "198 . 51 . 100 . 7", "ip"),
    ("with 4000/0000/0000/0002 paid", "4000/0000/0000/0002", "card"),
    ("with 5105.1051.0510.5100 paid", "5105.1051.0510.5100", "card"),
]
CLEAN = ["on 2024-05-17 we met", "at 17.05.2024 10:30:00 there", "some 12,345,678 people", "ISBN 978-3-16-148410-0 it is", "id 93847561 in", "number 4111111111111112 fails", "4111.1111.1111.1112 fails", "from 12345678 to 23456789", "we were at home", "v 300[.]400[.]500[.]600", 'token = "ede43f42c939b6405768150e041159052"', "9 876 543 210"]


def test_planted_variants_and_clean_numbers(spark):
    """With weights of the corpus itself: all disguised spans are found, of clean numbers none."""
    w = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    zero = pii.Weights.untrained()
    for t, token, kind in HIDDEN:
        at = t.index(token)
        assert pii.all_spans(t, w)[1] == [(at, at + len(token), kind)], t
        assert pii.all_spans(t, zero)[1] == []
    for t in CLEAN:
        assert pii.all_spans(t, w)[1] == [], t


def test_distant_twins_share_a_label():
    """A bare number, alone none, follows a phone number far away, and so does what is like it."""
    far = "word " * 300
    assert pii.all_spans("about 4155550132 or so", W)[1] == []
    t = f"+1 415 555 0132 {far} about 4155550132 or so {far} and 14155550132"
    assert [k for _, _, k in pii.all_spans(t, W)[1]] == ["phone"] * 3
    assert W.skip.min() > 1 and np.allclose(pii.Weights.untrained().skip, 0)


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    w = pii.Weights(rng.normal(0, 0.7, (pii.N_FEATURES, k)), rng.normal(0, 0.4, (k, k)), np.array([1.2, 0.8]))
    tree = "4155550132 then 7986512 " + "word " * 40 + "4155550132"
    loop = "4155550132 and 7986512 or 4155550132 so 4155550132"
    for text, tolerance in ((tree, 1e-3), (loop, 0.06)):
        ns = of(text)
        links = pii.edges(ns)
        phi = np.array([pii.local_features(n) for n in ns]) @ w.local
        want = np.zeros((len(ns), k))
        for ys in itertools.product(range(k), repeat=len(ns)):
            p = math.exp(sum(phi[i, y] for i, y in enumerate(ys)) + sum(w.pair(t)[ys[a], ys[b]] for a, b, t in links))
            for i, y in enumerate(ys):
                want[i, y] += p
        want /= want.sum(1, keepdims=True)
        got = np.exp(pii.marginals(ns, w) - pii.marginals(ns, w).max(1, keepdims=True))
        got /= got.sum(1, keepdims=True)
        assert len(links) >= len(ns) - 1 and np.abs(got - want).max() < tolerance


def test_extra_columns_and_none(spark):
    df = spark.createDataFrame([(1, "a@b.co", "k", 1)], "doc_id bigint, text string, __redacted2 string, n_email int")
    red = pii.redact(df, W)
    assert red.columns == df.columns and red.first()["text"] == "[EMAIL]" and pii.digest(df, W).first()["n_email"] == 1
    assert pii.redact(df.drop("text")).columns == ["doc_id", "__redacted2", "n_email"]
    assert pii.digest(df.filter("doc_id > 5")).count() == 0
