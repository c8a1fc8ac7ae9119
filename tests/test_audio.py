import wave

import numpy as np

from tidemark.sources import audio


def test_scan_names_and_sink(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, channels, rate in (("clip_000001.wav", 1, 16_000), ("sub/clip_000002_r1.wav", 2, 8_000), ("other.wav", 1, 16_000)):
        with wave.open(str(tmp_path / "in" / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(np.arange(0, 800 * channels, dtype="<i2").tobytes())
    (tmp_path / "in/clip_000009.wav").write_bytes(b"no wave")
    first = {r.name: r for r in audio.clip_names(audio.scan_wav(spark, str(tmp_path / "in"))).collect()}
    assert len(first) == 4 and first["clip_000009.wav"].problem and first["clip_000009.wav"].samples is None
    assert (first["clip_000002_r1.wav"].clip_idx, first["clip_000002_r1.wav"].round) == (2, 1) and first["other.wav"].clip_idx is None
    assert first["clip_000002_r1.wav"].samples[1] == 2 / 32768
    mean = {r.name: r for r in audio.scan_wav(spark, str(tmp_path / "in"), mean=True, rate=16_000).collect()}
    assert len(mean["clip_000002_r1.wav"].samples) == 1600 and mean["clip_000002_r1.wav"].sample_rate == 16_000
    assert [r.name for r in audio.scan_wav(spark, str(tmp_path / "in"), pattern=audio.ORIGINAL).orderBy("name").collect()] == ["clip_000001.wav", "clip_000009.wav"]
    good = audio.scan_wav(spark, str(tmp_path / "in")).where("problem is null")
    assert {r.frames for r in audio.write_wav(good, str(tmp_path / "out")).collect()} == {800}
    again = {r.name: r for r in audio.scan_wav(spark, str(tmp_path / "out")).collect()}
    assert len(again) == 3 and abs(again["other.wav"].samples[700] - 700 / 32768) < 1e-4
