"""Clips of speech: what is to be made, by which voice and with which settings, and a runner for any synthesizer.

Which voices, settings and phrases a clip gets follows from its index alone, so a run that is taken up again
makes what is missing and nothing else. The synthesizer is pluggable; `Tones` stands in where no network with
weights is at hand, with a tone for every phoneme.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import sampling
from tidemark.sources.tables import SAMPLE_RATE

#: Failed batches in a row that end a task.
FAILURES = 5


class SpeechSynthesizer(Protocol):
    """Samples in -1 … 1 at SAMPLE_RATE for texts with their settings, one array a text."""

    def batch(self, texts: list[str], settings: list[dict]) -> list[np.ndarray]: ...


def alignment(durations: np.ndarray) -> np.ndarray:
    """Which frames a symbol takes: symbols by frames, ones from one running sum of the durations to the next."""
    ends = np.cumsum(durations)
    frames = np.arange(int(ends[-1]) if len(ends) else 0)
    return ((frames[None] < ends[:, None]) & (frames[None] >= (ends - durations)[:, None])).astype(np.int8)


def mask(lengths: np.ndarray, most: int | None = None) -> np.ndarray:
    """Rows of ones up to each length."""
    return (np.arange(most if most is not None else int(max(lengths, default=0)))[None] < np.asarray(lengths)[:, None]).astype(np.int8)


class Tones:
    """A tone for every letter, pitched by the voice: no speech, but the same clip for the same text and settings."""

    def batch(self, texts: list[str], settings: list[dict]) -> list[np.ndarray]:
        return [self.one(t, s) for t, s in zip(texts, settings)]

    def one(self, text: str, settings: dict) -> np.ndarray:
        letters = [c for c in text.lower() if c.isalpha()]
        if not letters:
            return np.zeros(0)
        length = float(settings.get("length", 1.0))
        spans = np.array([int(800 * length) + 40 * (hashlib.md5(c.encode()).digest()[0] % 8) for c in letters])
        pitch = 110 + 3 * int(settings.get("a") or 0) + int(settings.get("b") or 0)
        tones = np.array([pitch * (1 + (ord(c) % 32) / 12) for c in letters])
        return 0.5 * np.sin(2 * np.pi * np.cumsum(tones @ alignment(spans)) / SAMPLE_RATE)


def plan_clips(scheduled: DataFrame, speakers: int, lengths: list[float], batch: int = 16) -> DataFrame:
    """split, clip_idx, phrase, a, b, length: two voices a clip, and a length that goes on by one a batch.

    scheduled: split, clip_idx, phrase.
    """
    voiced = sampling.speaker_pairs(scheduled, speakers)
    at = F.pmod(F.floor(F.col("clip_idx") / batch), F.lit(len(lengths))).cast("int")
    return voiced.withColumn("length", F.array(*map(F.lit, lengths))[at]).select("split", "clip_idx", "phrase", "a", "b", "length")


def synthesize(plan: DataFrame, load: Callable[[], SpeechSynthesizer], batch: int = 16) -> DataFrame:
    """The plan with samples array<float> and problem: a batch that fails leaves its clips without samples.

    A batch too large for memory is made in halves. FAILURES failed batches in a row end the task, as then no
    clip can be expected.
    """
    schema = T.StructType([*plan.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("problem", T.StringType())])
    names = plan.columns

    def made(synthesizer: SpeechSynthesizer, rows: list[dict]) -> list:
        try:
            return synthesizer.batch([r["phrase"] for r in rows], rows)
        except MemoryError:
            if len(rows) == 1:
                raise
            half = len(rows) // 2
            return [*made(synthesizer, rows[:half]), *made(synthesizer, rows[half:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        synthesizer, failed = load(), 0
        for some in batches:
            rows, samples, problems = some.to_pylist(), [], []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    samples += [np.asarray(x, np.float32) for x in made(synthesizer, part)]
                    problems += [None] * len(part)
                    failed = 0
                except Exception as e:  # told in the rows
                    failed += 1
                    if failed >= FAILURES:
                        raise RuntimeError(f"{FAILURES} batches in a row failed") from e
                    samples += [None] * len(part)
                    problems += [f"{type(e).__name__}: {e}"[:200]] * len(part)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(samples, pa.list_(pa.float32())), pa.array(problems, pa.string())], names=[*names, "samples", "problem"])

    return plan.mapInArrow(run, schema)
