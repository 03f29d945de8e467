"""The whole pipeline, stage by stage, against what each stage has to do with its own input."""

import corpus_pipeline
from semifold.llm import decontam, pii
from semifold.llm.common import WORD, load
from tests.llm.test_simhash import shingles, similar
from tests.oracle import SF


def test_each_stage_on_its_own_input(spark):
    import re

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = load(spark, SF, "documents").cache()
    good = stages["quality"](spark, docs, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in load(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    known = [d for d in labels if labels[d] is not None]
    assert good.columns == docs.columns and sum((d in kept) == bool(labels[d]) for d in known) > 0.95 * len(known)

    one = stages["near_duplicates"](spark, good, SF).cache()
    sets = {r["doc_id"]: shingles(r["text"]) for r in good.collect()}
    stay = {r["doc_id"] for r in one.collect()}
    holders = {}
    for d, s in sets.items():
        for x in s or {b""}:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in {(a, b) for h in holders.values() for b in h for a in h if a < b}:
        if similar(sets[a], sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert stay == {d for d in sets if find(d) == d} and one.columns == docs.columns

    clean = stages["decontamination"](spark, one, SF).cache()
    hit = {r["doc_id"] for r in decontam.matches(one, load(spark, SF, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == stay - hit and clean.columns == docs.columns

    safe = stages["pii"](spark, clean, SF).cache()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    after = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert before.keys() == after.keys() and safe.columns == docs.columns
    assert all((after[d] == t) == (not pii.base_spans(t or "")) or not pii.base_spans(after[d] or "") for d, t in before.items())
    assert not any(pii.base_spans(t or "") for t in after.values()) and before != after

    mixed = stages["mixing"](spark, safe, SF).collect()
    assert mixed and all(r["mix_size"] == len(re.findall(WORD, after[r["doc_id"]])) and 1 <= r["mix_copies"] <= 2 and r["text"] == after[r["doc_id"]] for r in mixed)
    total = sum(len(re.findall(WORD, t or "")) for t in after.values())
    assert sum(r["mix_size"] * r["mix_copies"] for r in mixed) <= 1.6 * total

    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, mixed))
