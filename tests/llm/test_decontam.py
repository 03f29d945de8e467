import random

from semifold.llm import decontam
from tests.oracle import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string, edits string"


def fewest(item, text):
    """Edits of the best occurrence, by the textbook recurrence."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        prev, row = row, [k]
        for j, t in enumerate(text, 1):
            row.append(min(prev[j - 1] + (c != t), prev[j] + 1, row[j - 1] + 1))
    return min(row)


def expect(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            b, tt = decontam.normalise(x), decontam.normalise(t)
            if len(b) >= decontam.Q and (n := fewest(b, tt)) <= decontam.budget(len(b)):
                out.append((d, i, n))
    return sorted(out, key=repr)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(rnd, text, n):
    s = list(text)
    for _ in range(n):
        p = rnd.randrange(len(s))
        s[p : p + 1] = rnd.choice(([], ["z"], [s[p], "y"]))
    return "".join(s)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, words(rnd, rnd.randint(4, 20))) for i in range(8)] + [(8, "short"), (9, None), (10, "abcdefgh")]
    docs = [(i, words(rnd, 30)) for i in range(10)]
    for k in range(30):
        it = items[k % 8][1]
        n = rnd.randint(0, decontam.budget(len(decontam.normalise(it))) + 3)
        docs.append((100 + k, words(rnd, rnd.randint(0, 10)) + " " + edited(rnd, it, n).upper().replace(" ", " \n ") + (" " + words(rnd, 8) if k % 3 else "")))
    docs += [(None, items[0][1]), (7, None), (7, ""), (101, docs[11][1])]
    want = expect(docs, items)
    assert len(want) > 20 and any(w[2] for w in want)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    for limit in (1 << 20, 200):
        got = decontam.matches(df, bench, limit=limit).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got), key=repr) == want
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, t in docs if not expect([(d, t)], items)), key=repr)
    assert decontam.matches(df.limit(0), bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 1000)
    rnd = random.Random(9)
    item = decontam.normalise(words(rnd, 20))
    ix = decontam.build([(5, item)])
    for at in range(900, 1100, 7):
        text = (b"q " * 5000)[:at] + item + b" r" * 2000
        assert decontam.search([b"", text, item], ix) == [(1, 0, 0, at, at + len(item)), (2, 0, 0, 0, len(item))] or sorted(decontam.search([b"", text, item], ix)) == [(1, 0, 0, at, at + len(item)), (2, 0, 0, 0, len(item))]


def test_every_exact_passage_is_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).filter("edits = 0").collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if decontam.normalise(b["text"]) in decontam.normalise(d["text"])}
    assert got == want and want
