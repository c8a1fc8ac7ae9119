"""Fingerprints under digests of few bits: nulls, repeated ids and rows, edited texts."""

import hashlib
import random

from tidemark.llm import fingerprint


def test_clashes_of_documents_and_edited_texts(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ﬁne", "gamma", "DELTA", "ét"]
    rows = [(rng.choice([None, 1, 1, *range(2, 40)]), None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for _ in range(60)]
    rows += rows[:5] + [(100, "x"), (101, "X"), (102, "long " * 3000)]
    docs = spark.createDataFrame([(k, t, "other") for k, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    for bits in (4, 128):
        got = fingerprint.compared(docs, bits).collect()
        assert len(got) == len(rows)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
        # equal fingerprints exactly where canonical forms are equal: as many fingerprints as forms
        forms = {fingerprint.canonical(t) for _, t in rows}
        assert len({r.fingerprint for r in got}) == len(forms)
        by_id: dict = {}
        for k, t in rows:
            by_id.setdefault(k, set()).add(fingerprint.canonical(t))
        marks = {r.doc_id: r.fingerprint for r in got}
        single = [k for k, f in by_id.items() if len(f) == 1]
        for a in single:
            for b in single:
                assert (marks[a] == marks[b]) == (by_id[a] == by_id[b])
        for r in got:
            if r.near_edited:
                assert r.fingerprint == r.edited_fingerprint
            else:
                assert r.fingerprint != r.edited_fingerprint


def test_edited_texts_are_plain_python(spark):
    rows = [(i, "wörd %d, " % i * i) for i in range(30)]
    got = {r.doc_id: r for r in fingerprint.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    texts, order = dict(rows), sorted((k for k, _ in rows), reverse=True)
    for at, k in enumerate(order):
        own, following = texts[k], texts[order[(at + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(own)
        assert got[k].edited_fingerprint == fingerprint.digest(fingerprint.canonical(edited))
    assert fingerprint.compared(spark.createDataFrame([(1, "one")], "doc_id long, text string")).first().near_next == 1.0
