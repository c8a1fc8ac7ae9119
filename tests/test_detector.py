"""The stateful detector against the batch plan, and its policies."""

from tidemark.operators import windows
from tidemark.streaming.detector import Detector, Policy


def fires(policy, scores, second=None, speech=None):
    d = Detector(policy)
    out = [d.hop(i, [("m", s, second[i] if second else None)], speech[i] if speech else True) for i, s in enumerate(scores)]
    return [f[1] for f in out if f], d


def test_runs_debounce_and_rejections():
    assert fires(Policy(0.5, 3, 25), [0.8, 0, 0.8, 0.8, 0.8, 0.8])[0] == [4]
    hops, d = fires(Policy(0.5, 1, 25, verifier=0.5), [0.9, 0.9, 0.9], [0.2, 0.3, 0.8])
    assert hops == [2] and d.rejected == 2
    assert fires(Policy(0.5, 1, 1, gate_window=5, gate_needed=2), [0.9] * 4, speech=[False, True, True, False])[0] == [2, 3]
    assert fires(Policy(0.5, 3, 1, reset_run=True), [0.9] * 6)[0] == [2, 5]


def test_one_timer_or_one_a_name():
    shared, own = Detector(Policy(debounce=10)), Detector(Policy(debounce=10, per_name=True))
    for d, want in ((shared, None), (own, ("b", 3, 0.9, None))):
        assert d.hop(0, [("a", 0.9, None)]) == ("a", 0, 0.9, None)
        assert d.hop(3, [("b", 0.9, None)]) == want


def test_state_survives_any_split():
    p, scores = Policy(0.5, 2, 5), [0.9, 0.9, 0.1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9]
    whole = fires(p, scores)[0]
    d, out = Detector(p), []
    for i, s in enumerate(scores):
        d = Detector.restored(p, d.state())
        out += [f[1] for f in [d.hop(i, [("m", s, None)])] if f]
    assert out == whole


def test_gate_survives_any_split():
    p, speech = Policy(0.5, 1, 1, gate_window=5, gate_needed=4, verifier=0.4), [h % 7 not in (2, 5) for h in range(40)]
    second = [0.9 if h % 3 else 0.1 for h in range(40)]
    whole, end = fires(p, [0.9] * 40, second, speech)
    assert whole
    for every in (1, 2, 3, 5):
        d, out = Detector(p), []
        for i in range(40):
            if i % every == 0:
                kept = d.state()
                d = Detector.restored(p, kept)
                assert d.state() == kept
            out += [f[1] for f in [d.hop(i, [("m", 0.9, second[i])], speech[i])] if f]
        assert (out, d.state()) == (whole, end.state())


def test_verified_stream_in_many_triggers(spark, tmp_path):
    from tidemark.streaming import feeds
    from tidemark.streaming.detector import detect

    p = Policy(0.5, 1, 3, gate_window=5, gate_needed=4, verifier=0.4)
    rows = [(s, h, "m", 0.9, 0.9 if (h + s) % 3 else 0.1, (h + s) % 6 != 2) for s in range(5) for h in range(40)]
    df = spark.createDataFrame(rows, "stream_id long, hop long, name string, score double, verifier_score double, speech boolean")
    want = []
    for s in range(5):
        d = Detector(p)
        want += [(s, h) for i, h, n, x, v, speech in rows if i == s and d.hop(h, [(n, x, v)], speech)]
    feeds.dropped(df.coalesce(1), str(tmp_path / "in"), "hop")
    # one file a trigger: the state is left and taken up again between drops
    found = feeds.run_through(detect(feeds.folder_stream(spark, str(tmp_path / "in"), df.schema, 1), p))
    assert sorted((r.stream_id, r.hop) for r in found.collect()) == want


def test_pause_until_resumed():
    d = Detector(Policy(0.5, 1, 1, pause=True))
    got = []
    for i in range(8):
        d = Detector.restored(d.policy, d.state())
        got.append(d.hop(i, [("m", 0.9, None)], resume=i == 5))
    assert [f[1] for f in got if f] == [0, 5]


def test_file_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.detector import detect

    rows = [(s, h, "m", 0.9 if (h * 7 + s) % 5 < 2 else 0.1) for s in (1, 2) for h in range(120)]
    df = spark.createDataFrame(rows, "stream_id long, hop long, name string, score double")
    for i in range(4):  # four files, four micro-batches
        df.where(f"hop between {i * 30} and {i * 30 + 29}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = detect(live, Policy(0.5, 1, 25)).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.stream_id, r.hop) for r in spark.table("found").collect())
    assert got == sorted((r.stream_id, r.hop) for r in windows.detections(df, 0.5, 25).collect())
