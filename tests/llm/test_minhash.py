import math
import random

import numpy as np
import pytest

from tidemark.llm import minhash


def naive_similarity(x, y):
    """The probability Jaccard similarity by its definition; x, y: dictionaries of weights."""
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())


def weights_of(text):
    keys, counts = minhash.shingles(minhash.words_of(text))
    return {k: 1 + math.log(n) for k, n in zip(keys.tolist(), counts.tolist())}


def linked(one, other):
    a, b = frozenset(one), frozenset(other)
    if a == b and one == other or 10 * len(a & b) >= 8 * len(a | b):
        return True
    share = min(sum(one[k] for k in a & b) / sum(one.values()), sum(other[k] for k in a & b) / sum(other.values())) if a and b else 0
    return share >= 0.8 and naive_similarity(one, other) >= 0.8 - 1e-12


def plain_classes(rows):
    sets = [weights_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return sorted((k, min(least[find(i)])) for i, (k, _) in enumerate(rows))


def corpus(seed, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if i % 5 == 0:
            w = w[:20] + passage
        if i % 7 == 0:
            w += w[-12:] * rng.choice([1, 3, 40])
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "one two"), (n + 4, "One, two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_brute_force(spark, seed):
    rows = corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows)


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = keys[:200], keys[50:250]
    got = np.mean(minhash.signature(a, np.ones(200), 4096) == minhash.signature(b, np.ones(200), 4096))
    assert got == pytest.approx(150 / 250, abs=0.04)
    weights = np.ones(200)
    weights[:50] = 5.0
    x, y = dict(zip(a.tolist(), weights)), dict(zip(b.tolist(), np.ones(200)))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())
    got = minhash.estimate(minhash.signature(a, weights, 4096), minhash.signature(b, np.ones(200), 4096))
    assert got == pytest.approx(exact, abs=0.04)
    assert minhash.probability_jaccard(a, weights, b, np.ones(200)) == pytest.approx(exact) == naive_similarity(x, y)
    for _ in range(50):
        i, j = rng.integers(0, 30, (2, 12))
        (i, n), (j, m) = np.unique(i, return_counts=True), np.unique(j, return_counts=True)
        want = naive_similarity(dict(zip(i.tolist(), n.tolist())), dict(zip(j.tolist(), m.tolist())))
        assert minhash.probability_jaccard(i, n, j, m) == pytest.approx(want)
    none = np.empty(0)
    assert (minhash.probability_jaccard(none, none, none, none), minhash.probability_jaccard(none, none, i, n)) == (1.0, 0.0)
    assert (minhash.signature(a[:1], np.ones(1), 64) == a[0]).all()


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "other words here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.class_id) for r in minhash.near_duplicates(rows).collect()) == [("3", 3), ("3", 3), ("4", 4), ("None", 3)]
    assert minhash.keep_first(rows).where("doc_id is not null").count() == 2


def test_prefix_pairs_lose_nothing(spark):
    rng = random.Random(5)
    sets = []
    for i in range(60):
        base = set(range(40)) if i % 2 else set(range(100, 130))
        for _ in range(rng.randint(0, 8)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(1001, 1100, 2))
        counts = [1] * len(base) if i % 3 else [rng.choice([1, 2]) if e % 2 else 40 for e in sorted(base)]
        sets.append((sorted(base), counts))
    rows = [(i, len(g), max(c) > 1, g, c if max(c) > 1 else None) for i, (g, c) in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, size int, repeats boolean, grams array<long>, counts array<long>")
    rest = frame.select("node", frame.node.alias("class"))
    got = {tuple(sorted(r)) for r in minhash.verified(minhash.prefix_pairs(rest, frame, 8), frame, 8).collect()}
    heavy = [dict(zip(g, (1 + math.log(n) for n in c))) for g, c in sets]
    want = {(i, j) for j in range(60) for i in range(j) if linked(heavy[i], heavy[j])}
    assert got == want and want
    assert any(10 * len(heavy[i].keys() & heavy[j].keys()) < 8 * len(heavy[i].keys() | heavy[j].keys()) for i, j in want)


def test_repeated_shingles_do_not_part_a_pair(spark):
    """Sets of Jaccard 0.8 and more whose own or common shingles are repeated in one text only."""
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows = []
    for i in range(40):
        common, own = line(200), [line(12) for _ in range(2)]
        rows += [(2 * i + j, " ".join([common, *[own[j]] * 30])) for j in range(2)]
    want = plain_classes(rows)
    assert sum(k != c for k, c in want) == 40
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == want


def test_keep_first_goes_by_row(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "quite another text"), (3, "one"), (3, "two"), (3, "two"), (None, "x y"), (None, "X y"), (None, "a b c d e f"), (9, "last of all")]
    got = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in got) == [("1", "a b c d e f"), ("2", "quite another text"), ("3", "one"), ("3", "two"), ("9", "last of all"), ("None", "x y")]


def test_repeated_common_phrases_lose_no_link(spark):
    """Pairs of set Jaccard 0.83 that share a phrase repeated 100 times, or that only one of the two repeats."""
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows = []
    for i in range(30):
        common, own, phrase = line(100), [line(8), line(8)], line(9)
        times = [(100, 100), (100, 1), (3, 1000)][i % 3]
        rows += [(2 * i + j, " ".join([common, *[phrase] * times[j], own[j]])) for j in range(2)]
    want = plain_classes(rows)
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and sum(k != c for k, c in want) >= 20


def test_one_large_group_is_joined_apart(spark):
    """Near copies that all share buckets, beside a phrase in every text: classes hold, and clashing columns take no part."""
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(80)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(600)] + [(1000 + i, " ".join([*base[:10], *(f"w{i}x{j}" for j in range(60))])) for i in range(40)]
    docs = spark.createDataFrame([(k, t, t, 1) for k, t in rows], "doc_id long, text string, key string, band int").repartition(3)
    got = dict(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert all(got[i] == 0 for i in range(600)) and all(got[1000 + i] == 1000 + i for i in range(40))
