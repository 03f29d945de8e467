"""Personal data: pattern spans, extended by a skip-chain conditional random field.

Pattern spans (e-mail, IP, card, phone) are found in one linear pass each.  The
CRF's nodes are those spans, with their labels observed, and looser candidates
that no pattern took: digit groups, spelled-out addresses (``jo [at] host [dot]
org``) and IPs with bracketed dots.  Neighbours in the text are joined by chain
potentials; nodes whose digits or names are equal or similar, however far
apart, by skip potentials.  Loopy message passing gives every candidate of every
text a label; one whose label is a kind becomes a span too, by an observed twin
or by its own features and context.  Each twin is linked to the one before it,
so edges grow with the nodes.

All potentials (local, chain, and the strengths of both skip links) are fitted
together by pseudo-likelihood.  The label of a pattern span is known, that of a
candidate is "none" unless shown otherwise; so that the model learns what
disguised personal data looks like, each sampled text is also shown with its
pattern spans rewritten (separators changed, at and dot spelled out, country
code left out) under their labels, and with numbers that are none (dates,
thousands, failed checksums).  The sample has ``SAMPLE`` documents (the smallest
hashes of those with digits or an @) and of each at most ``NODES`` consecutive
nodes; patterns and message passing cover every text whole.

Defined cases: null text is empty and has no spans; repeated rows are treated
alike; offsets are code points; an empty table gives no rows; a number part of
any length is compared as a number; of ``redact``'s input without a text column
nothing changes; other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE, NODES = 4000, 64
#: Rounds of messages, and code points between chain neighbours.
ROUNDS, NEAR = 12, 60
#: Code points before a node in which cue words are looked for.
BEFORE = 24

# Words that announce a kind of personal data.
CUES = {
    "email": ["mail", "email", "e-mail", "correo", "courriel", "contact"],
    "ip": ["ip", "ipv4", "host", "server", "addr"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"],
    "phone": ["phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone"],
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The pattern from inside a run of digits fails where it fails from the run's start, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"\(?(?<![0-9])[0-9]++(?:[\x20\u00a0().,/_:-]{1,2}[0-9]++)*+")
_DOT = r"(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| \. | dot )"
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_NAME = r"[A-Za-z0-9._%+-]++"
_AT = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?: ?[\[({{] ?(?:at|@) ?[\])}}] ?[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)+| at (?![0-9]+[^A-Za-z0-9-])[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)", re.I)
_AT_HINT = re.compile(r"[\[({ ](?:at|@)[\])} ]", re.I)
_QUAD_HINT = re.compile(rf"[0-9]{_DOT}[0-9]", re.I)
_CUES = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])", re.I) for k, words in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group(0).split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group(0))) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group(0))) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    text: str
    label: int | None  # observed
    before: str = ""  # what stands before it
    after: str = ""  # the code point after it


def nodes(text: str, base: list[tuple[int, int, str]]) -> list[Node]:
    """Observed spans and the candidates that overlap none of them, by start."""
    cand = [m.span() for m in _LOOSE.finditer(text) if m.end() - m.start() >= 7 and sum("0" <= c <= "9" for c in m.group(0)) >= 7]
    if _AT_HINT.search(text):
        cand += [m.span() for m in _AT.finditer(text)]
    if _QUAD_HINT.search(text):
        cand += [m.span() for m in _QUAD.finditer(text)]
    taken = sorted((s, e) for s, e, _ in base)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    starts = np.array([s for s, _ in taken])
    out = [(s, e, LABELS.index(k)) for s, e, k in base]
    last = 0
    for s, e in sorted(cand, key=lambda c: (c[0], -c[1])):
        i = int(np.searchsorted(starts, e)) if taken else 0
        if s >= last and not (i and ends[i - 1] > s):
            out.append((s, e, None))
            last = e
    out.sort(key=lambda n: (n[0], n[1], n[2] or 0))
    return [Node(s, e, text[s:e], y, text[max(0, s - BEFORE) : s], text[e : e + 1]) for s, e, y in out]


def local_features(n: Node) -> np.ndarray:
    s, d = n.text, _digits(n.text)
    k = len(d)
    at = bool(re.search(r"@|[\[({ ]at[\])} ]", s, re.I))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    quad = not at and len(groups) == 4 and bool(re.fullmatch(rf"[0-9]+(?:(?:{_DOT}|\.)[0-9]+){{3}}", s, re.I)) and all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0")[:3] or 0) <= 255 for g in re.findall("[0-9]+", s))
    numeric = not at and not quad
    glued = bool(n.before[-1:].isalnum() or n.before[-1:] in tuple("_#$=\"'/.") or n.after.isalnum() or n.after == "_")
    cues = [bool(c.search(n.before)) for c in _CUES.values()]
    checked = numeric and 12 <= k <= 19 and luhn(d)
    local = numeric and len(groups) > 1 and groups[-1] == 4 and groups[-2] == 3 and 7 <= k <= 15
    area = local and len(groups) > 2 and groups[-3] == 3
    return np.array(
        [1.0, at, quad, numeric, "+" in s and numeric, "(" in s and numeric, checked and not glued, numeric and 12 <= k <= 19 and not checked, local and not glued, area and not glued, area and not re.search(r"[().-]", s), numeric and len(groups) == 1]
        + [numeric and 9 <= k <= 15, numeric and k < 9, numeric and k > 19, numeric and len(groups) > 2 and all(g == 3 for g in groups[1:]), numeric and groups in ([4, 2, 2], [2, 2, 4], [4, 2, 2, 2, 2], [4, 2, 2, 2, 2, 2]), glued]
        + cues
        + [c and numeric for c in cues]
        + [cues[3] and numeric and 7 <= k <= 15 and not glued, cues[2] and checked],
        float,
    )


N_FEATURES = len(local_features(Node(0, 0, "", None)))


def skip_keys(s: str) -> tuple[list[str], list[str]]:
    """Keys under which a token meets its equals and its likes."""
    if m := re.match(r"(.+?)(?:@| ?[\[({] ?(?:at|@) ?[\])}] ?| at )(.+)", s, re.I | re.S):
        host = re.sub(rf"{_DOT}| ?\. ?", ".", m.group(2).lower(), flags=re.I)
        return [f"e:{m.group(1).lower().strip()}@{host}"], []
    d = _digits(s)
    like = [f"t:{d[-9:]}"] if len(d) >= 9 else []
    like += [f"w{len(d)}:{i}:{d[:i]}.{d[i + 1 :]}" for i in range(len(d))] if 12 <= len(d) <= 19 else []
    return [f"d:{d}"], like


#: Kinds of links: equal tokens, similar tokens, neighbours in the text.
EQUAL, SIMILAR, CHAIN = range(3)


def edges(ns: list[Node]) -> list[tuple[int, int, int]]:
    """Skip and chain edges (node, node, kind of link); each key links a node to the one that had it before."""
    seen: dict[str, int] = {}
    out: dict[tuple[int, int], int] = {}
    for i, n in enumerate(ns):
        same, like = skip_keys(n.text)
        for keys, kind in ((same, EQUAL), (like, SIMILAR)):
            for k in keys:
                if k in seen:
                    out.setdefault((seen[k], i), kind)
                if k not in seen or ns[seen[k]].label is None or n.label is not None:
                    seen[k] = i
    chain = [(i, i + 1, CHAIN) for i in range(len(ns) - 1) if 0 <= ns[i + 1].start - ns[i].end <= NEAR]
    return [(a, b, kind) for (a, b), kind in out.items()] + chain


@dataclass(frozen=True)
class Weights:
    local: np.ndarray  # features x labels
    chain: np.ndarray  # label x label
    skip: np.ndarray  # gain of agreement: between equal tokens, between similar ones

    @classmethod
    def untrained(cls) -> Weights:
        k = len(LABELS)
        local = np.zeros((N_FEATURES, k))
        local[0, 0] = 2.0
        return cls(local, np.zeros((k, k)), np.zeros(2))

    def pair(self, kind: int) -> np.ndarray:
        return self.chain if kind == CHAIN else self.skip[kind] * np.eye(len(LABELS))


def marginals(ns: list[Node], w: Weights) -> np.ndarray:
    """Log beliefs, a row per node and not normalised, by loopy sum-product."""
    k = len(LABELS)
    phi = np.array([local_features(n) for n in ns]).reshape(-1, N_FEATURES) @ w.local
    for i, n in enumerate(ns):
        if n.label is not None:
            phi[i] = -60.0
            phi[i, n.label] = 0.0
    links = edges(ns)
    if not links:
        return phi
    psi = np.stack([w.pair(kind) for _, _, kind in links])
    src = np.array([a for a, _, _ in links] + [b for _, b, _ in links])
    dst = np.array([b for _, b, _ in links] + [a for a, _, _ in links])
    psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    msg = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = phi.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + psi
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
    belief = phi.copy()
    np.add.at(belief, dst, msg)
    return belief


def infer(ns: list[Node], w: Weights) -> list[int]:
    return marginals(ns, w).argmax(1).tolist()


def all_spans(text: str, w: Weights) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    ns = nodes(text, base)
    if len(ns) == len(base):  # no candidates
        return base, base
    got = infer(ns, w)
    more = [(n.start, n.end, LABELS[y]) for n, y in zip(ns, got, strict=True) if n.label is None and y]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def disguise(n: Node, rnd: random.Random) -> Node:
    """An observed node as it might stand where no pattern finds it."""
    kind, d = LABELS[n.label], _digits(n.text)
    before, text = n.before, n.text
    if kind == "email":
        name, host = n.text.split("@", 1)
        at, dot = rnd.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "), ("(at)", "(dot)"), (" {at} ", ".")])
        text = name + at + host.replace(".", dot)
    elif kind == "ip":
        text = n.text.replace(".", rnd.choice(["[.]", "(.)", "[dot]", " . ", " dot "]))
    elif kind == "card":
        sep = rnd.choice([".", "/", "_", "--", "\u00a0"])
        text = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        area, a, b = d[-10:-7], d[-7:-4], d[-4:]
        form = rnd.randrange(5)
        text = [f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{d[:-10]} ({area}) {a} {b}".strip(), area + a + b][form] if len(d) >= 10 else d
        if form == 4 or len(d) < 10 or rnd.random() < 0.3:  # bare digits are a phone number only where something says so
            before = before[-8:] + rnd.choice(CUES["phone"]) + rnd.choice([" ", ": "])
    if before == n.before and rnd.random() < 0.3:
        before = before[-8:] + rnd.choice(CUES[kind]) + rnd.choice([" ", ": "])
    return Node(n.start, n.start + len(text), text, n.label, before, " ")


def twin(n: Node, rnd: random.Random) -> Node:
    """An observed node as it might stand again: bare digits that tell nothing by themselves, a card with a slip."""
    d = _digits(n.text)
    if LABELS[n.label] in ("email", "ip"):
        return disguise(n, rnd)
    if LABELS[n.label] == "phone":
        d = d[rnd.choice([0, -10, -9]) :]
    elif rnd.random() < 0.5:
        i = rnd.randrange(len(d))
        d = d[:i] + str((int(d[i]) + rnd.randrange(1, 10)) % 10) + d[i + 1 :]
    return Node(n.start, n.start + len(d), d, n.label, "", " ")


def decoy(at: int, before: str, rnd: random.Random) -> Node:
    """A number that is nobody's data."""
    r = rnd.randrange
    card = "".join(str(r(10)) for _ in range(16))
    card = card[:-1] + next(c for c in "0123456789" if not luhn(card[:-1] + c))
    text = rnd.choice(
        [f"{r(1900, 2040)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 29):02}.{r(1, 13):02}.{r(1900, 2040)}", f"{r(1, 900)},{r(1000):03},{r(1000):03}", f"{r(1, 900)} {r(1000):03} {r(1000):03}", f"{r(1, 10)} {r(100, 1000)} {r(100, 1000)} {r(10**4):04}"]
        + [card, ".".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4)), str(r(10**6, 10**9)), str(r(10**9, 10**12)), f"978-{r(1, 9)}-{r(10, 99)}-{r(10**5, 10**6)}-{r(10)}"]
        + [f"{r(256, 999)}[.]{r(999)}[.]{r(999)}[.]{r(256, 999)}", f"{r(1900, 2040)}-{r(1, 13):02}-{r(1, 29):02} {r(24):02}:{r(60):02}:{r(60):02}"]
    )
    return Node(at, at + len(text), text, 0, rnd.choice([before, before, "no. ", "#"]), " ")


def fit_weights(texts: list[list[Node]], rounds: int = 400) -> Weights:
    """texts: nodes of sampled texts.  Pseudo-likelihood of each node given its neighbours' labels, by gradient ascent."""
    rnd = random.Random(5)
    shown: list[list[Node]] = []
    for ns in texts:
        known = [Node(n.start, n.end, n.text, n.label or 0, n.before, n.after) for n in ns]
        spans = [n for n in known if n.label]
        shown.append(known)
        if spans:
            # Hidden twins of what stands in the text, and the disguised text without the pattern spans.
            end = max(n.end for n in known)
            more = [twin(n, rnd) for n in spans]
            shown.append(known + [Node(end + (i + 1) * (NEAR + 40), end + (i + 1) * (NEAR + 40) + len(m.text), m.text, m.label, m.before, m.after) for i, m in enumerate(more)])
            shown.append([disguise(n, rnd) if n.label else n for n in known])
            shown.append([disguise(rnd.choice(spans), rnd), decoy(10**9, spans[0].before, rnd)])
    k = len(LABELS)
    x, y, chain, skip = [], [], [], []
    for ns in shown:
        base = len(y)
        y += [n.label for n in ns]
        x += [local_features(n) for n in ns]
        for a, b, kind in edges(ns):
            (chain if kind == CHAIN else skip).append((base + a, base + b, kind))
    start = Weights.untrained()
    if not y:
        return start
    x, y = np.array(x), np.array(y)
    # skip[:, kind, label]: how many neighbours by such a link have the label
    near = np.zeros((len(y), 2, k))
    for a, b, kind in skip:
        near[a, kind, y[b]] += 1
        near[b, kind, y[a]] += 1
    left = np.zeros((len(y), k))  # label of the neighbour before, and of that after
    right = np.zeros((len(y), k))
    for a, b, _ in chain:
        left[b, y[a]] += 1
        right[a, y[b]] += 1
    local, pair, gain = start.local.copy(), start.chain.copy(), np.ones(2)
    share = 1.0 / np.bincount(y, minlength=k)[y]  # each label weighs alike, none as much as all kinds
    share = np.where(y == 0, share * (k - 1), share)
    share /= share.sum()
    moments = [np.zeros_like(z) + 1e-6 for z in (local, pair, gain)]
    for _ in range(rounds):
        s = x @ local + left @ pair + right @ pair.T + np.einsum("ijk,j->ik", near, gain)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        grads = [x.T @ p + 1e-4 * (local - start.local), left.T @ p + (right.T @ p).T + 1e-2 * pair, np.einsum("ijk,ik->j", near, p) + 1e-4 * gain]
        for z, g, m in zip((local, pair, gain), grads, moments, strict=True):
            m += g * g
            z -= 0.3 * g / np.sqrt(m)
    return Weights(local, pair, gain)


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = NODES) -> Weights:
    """Weights from at most ``sample`` documents that hold digits or an @, and ``most`` nodes of each."""
    text = text_of(docs)

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, [(n.start, n.end, n.text, n.label, n.before, n.after) for n in nodes(t, base_spans(t))[:most]]) for h, t in zip(pdf["h"], pdf["t"], strict=True)]
            rows = [r for r in rows if r[1]]
            yield pd.DataFrame({"h": [r[0] for r in rows], "ns": [[{"s": n[0], "e": n[1], "t": n[2], "y": n[3], "b": n[4], "a": n[5]} for n in r[1]] for r in rows]})

    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("t")).filter("t rlike '[0-9]{4}|@'")
    # The hash below which the sample lies, then the texts themselves; copies of a text are one.
    least = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return fit_weights([])
    rows = hashed.filter(F.col("h") <= least).mapInPandas(observe, "h bigint, ns array<struct<s:bigint,e:bigint,t:string,y:int,b:string,a:string>>").dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return fit_weights([[Node(*n) for n in r["ns"]] for r in rows])


def _join(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def digest(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The contract's columns; the counts are of base spans."""
    import pyarrow as pa

    w = weights or fit(docs)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = [all_spans(t, w) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([_join(x) for _, x in got], pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)


def redact_text(text: str | None, w: Weights) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s, e, k in all_spans(text, w)[1]:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows where the text changed."""
    if "text" not in docs.columns:
        return docs
    w = weights or fit(docs)

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, w) for t in text], dtype=object)

    cols = docs.columns
    out = docs.withColumn("__redacted", run("text"))
    pick = {"text": F.col("__redacted").alias("text")}
    if "n_chars" in cols:
        pick["n_chars"] = F.when(F.col("__redacted").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__redacted")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[pick.get(c, F.col(f"`{c}`")) for c in cols])
