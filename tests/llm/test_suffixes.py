import hashlib
import random
from collections import Counter

from semifold.llm import suffixes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(i, text(rnd.randint(0, 80)) + rnd.choice(shared)[rnd.randint(0, 20) :] + text(rnd.randint(0, 60))) for i in range(25)]
    rows += [(100, "a" * 700), (101, "ab " * 150), (102, rows[0][1]), (102, rows[0][1]), (None, rows[3][1]), (103, None), (104, "x" * 199), (105, shared[0][:200])]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(3)
    df.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/suffix-in")
    df = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/suffix-in")
    assert sorted((tuple(r) for r in suffixes.digest(df).collect()), key=repr) == brute(rows)
    monkeypatch.setattr(suffixes.repeated, "__defaults__", (suffixes.BATCHES, 2))
    assert sorted((tuple(r) for r in suffixes.digest(df).collect()), key=repr) == brute(rows)
    assert suffixes.digest(df.limit(0)).count() == 0


def test_pieces_have_the_anchors_of_the_whole(monkeypatch):
    import numpy as np

    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    parts = suffixes.anchors(data)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
