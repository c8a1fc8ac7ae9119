"""Long streams and hot keys: the same results in small pieces, and plans that do not put one key in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, phrases, sampling, windows


def greedy(hops, skip):
    out = []
    for h in sorted(hops):
        if not out or h - out[-1] >= skip:
            out.append(h)
    return out


@pytest.mark.parametrize("skip, slice_hops", [(1, 4), (3, 4), (5, 5), (7, 64), (25, 30)])
def test_debounce_by_slices_is_greedy(spark, skip, slice_hops):
    rng = random.Random(skip)
    streams = {1: list(range(300)), 2: sorted(rng.sample(range(400), 120)), 3: sorted(rng.sample(range(4000), 60)), 4: [0], 5: [h for h in range(500) if h // 50 % 2], 6: list(range(97, 200, 2))}
    rows = spark.createDataFrame([(s, h) for s, hs in streams.items() for h in hs], "stream_id long, hop long")
    got: dict = {}
    for r in windows.debounced(rows, skip, hops=slice_hops).collect():
        got.setdefault(r.stream_id, []).append(r.hop)
    assert {s: sorted(h) for s, h in got.items()} == {s: greedy(hs, skip) for s, hs in streams.items()}


def test_windows_by_slices(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICE", 16)
    rng = random.Random(3)
    scores = [rng.choice([0.1, 0.9, 0.9, float("nan")]) for _ in range(200)]
    hops = spark.createDataFrame([(1, i, s, s == 0.9) for i, s in enumerate(scores)], "stream_id long, hop long, score double, loud boolean").repartition(3)
    assert sorted(r.hop for r in windows.stride_windows(hops, "score", 10).collect()) == list(range(9, 200))
    assert all(r.window[-1] == scores[r.hop] or scores[r.hop] != scores[r.hop] for r in windows.stride_windows(hops, "score", 10).collect())
    runs, run = {}, 0
    for i, s in enumerate(scores):
        run = run + 1 if s == 0.9 else 0
        runs[i] = run
    assert {r.hop: r.run for r in windows.run_lengths(hops, 0.5).collect()} == runs
    assert sorted(r.hop for r in windows.run_fires(hops, 0.5, 3).collect()) == [i for i, n in runs.items() if n >= 3]
    assert {r.hop for r in windows.lowest_of_last(hops, 3).where("score >= 0.5").collect()} == {i for i, n in runs.items() if n >= 3}
    opened = {r.hop: r.gate_open for r in windows.rolling_gate(hops, "loud", 5, 3).collect()}
    assert opened == {i: sum(s == 0.9 for s in scores[max(0, i - 4) : i + 1]) >= 3 for i in range(200)}
    clips = spark.createDataFrame([(1, i, 10 + i) for i in range(50)], "stream_id long, hop long, length int")
    at = 100
    for r in sorted(windows.layout(clips, 100, 7).collect(), key=lambda r: r.hop):
        assert (r.start, r.stop) == (at, at + 10 + r.hop)
        at += 10 + r.hop + 7


def test_one_stream_is_dealt_by_slices(spark):
    hops = spark.range(100).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("hop"), F.lit(0.9).alias("score"))
    for made in (windows.stride_windows(hops, "score"), windows.run_fires(hops, 0.5, 3), windows.rolling_gate(hops.withColumn("b", F.lit(True)), "b", 5, 3), windows.debounced(hops, 25)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert any("slice" in line for line in dealt), plan


def test_ranks_by_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(10_000)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    for group in "ab":
        mine = sorted(v for g, _, v in rows if g == group)
        assert [r.v for r in sampling.dense_order(df, "g", "v").where(F.col("g") == group).orderBy("ord").collect()] == mine
        assert sorted(r["rank"] for r in sampling.ranked(df, "i", "x", "g").where(F.col("g") == group).collect()) == list(range(len(mine)))
    whole = sampling.ranked(df.withColumn("g", F.when(F.col("i") % 2 == 0, F.col("g"))), "i", "x", "g")
    assert whole.where("g is null").agg(F.max("rank") + 1, F.count("*")).first() == (250, 250)
    assert sampling.dense_order(df.limit(0), "g", "v").count() == 0 and sampling.top_n(df, 3, ["v"], "g").count() == 6


def test_kth_highest_is_a_sort(spark):
    rng = random.Random(9)
    values = [rng.random() for _ in range(900)] + [0.5] * 50 + [1.0, 0.0, -0.5, 1.5, 7.0, float("nan")]
    df = spark.createDataFrame([("positive", v) for v in values], "kind string, score double").repartition(3)
    ranked = sorted((v if v == v else float("-inf") for v in values), reverse=True)
    targets = [0.001, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {r.target: r.threshold for r in metrics.kth_highest(df.select("score"), targets).collect()}
    for t in targets:
        assert got[t] == ranked[max(1, -(-round(t * len(values) * 10**9) // 10**9)) - 1]


def test_neighbours_are_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 13))) for _ in range(150)} | {"", "a", "ab" * 6}
    for w in list(words)[:60]:
        for _ in range(2):
            i = rng.randrange(len(w) + 1)
            words.add(w[:i] + rng.choice(["", "c"]) + w[i + rng.choice([0, 1]) :])
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for d in (1, 2):
        got = {(r.word, r.neighbour): r.distance for r in phrases.neighbours(df, df, d).collect()}
        want = {(a, b): n for a in words for b in words if a != b and (n := distance(a, b)) <= d}
        assert got == want
    long = spark.createDataFrame([("x" * 10_000,), ("x" * 9_999 + "y",)], "word string")
    assert phrases.neighbours(long, long, 2).count() == 2


def test_phonetic_neighbours(spark):
    entries = {"zuck": "Z AH1 K", "duck": "D AH1 K", "zach": "Z AE1 K", "zucker": "Z AH1 K ER0", "suck": "S AH1 K", "zuk": "Z AH0 K", "hey": "HH EY1", "a": "AH0", "cat": "K AE1 T", "computer": "K AH0 M P Y UW1 T ER0", "commuter": "K AH0 M Y UW1 T ER0", "commute": "K AH0 M Y UW1 T"}
    d = spark.createDataFrame([(w, p.split()) for w, p in entries.items()], "word string, phones array<string>")
    near = lambda w, **k: sorted(r.neighbour for r in phrases.phonetic_neighbours(spark.createDataFrame([(w,)], "word string"), d, **k).collect())
    assert near("zuck") == ["duck", "suck", "zach", "zucker"]  # not its homophone
    assert near("hey") == near("a") == near("none") == []
    assert near("computer") == ["commute", "commuter"] and near("computer", distance=1) == ["commuter"]
    swaps = phrases.word_swaps(spark.createDataFrame([("hey zuck",)], "phrase string"), spark.createDataFrame([("there",), ("siri",), ("zuck",), ("duck",)], "word string"), d)
    assert sorted(r.variant for r in swaps.collect()) == sorted(["hey siri", "hey there", "siri zuck", "there zuck", "zuck zuck", "duck zuck"])
    cut = phrases.expanded(spark.createDataFrame([("hey zuckcat now",)], "phrase string"), d)
    assert cut.first().tokens == ["hey", "zuck", "cat", "now"]
