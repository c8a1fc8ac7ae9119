"""Clip files: scans of WAV folders and their split and round names, and sinks."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dsp import resample
from tidemark.sources.sinks import present
from tidemark.sources.tables import SAMPLE_RATE

#: File names of original and of augmented clips.
ORIGINAL, AUGMENTED = r"^clip_(\d{6})\.wav$", r"^clip_(\d{6})_r(\d+)\.wav$"
SCHEMA = "path string, name string, sample_rate int, samples array<float>, problem string"


def decode(raw: bytes, mean: bool, rate: int | None) -> tuple[int, np.ndarray]:
    """Samples in [-1, 1]: the first channel or the mean of all; resampled within the band where `rate` is given."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, own, frames = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    kinds = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}
    if width not in kinds:
        raise ValueError(f"{8 * width}-bit samples")
    x = np.frombuffer(frames, kinds[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels)
    x = x.mean(1) if mean else x[:, 0]
    if rate and rate != own and len(x):
        x = resample(x.astype(np.float64), own, rate).astype(np.float32)
        own = rate
    return own, x


def scan_wav(spark: SparkSession, *folders: str, mean: bool = False, rate: int | None = None, pattern: str | None = None) -> DataFrame:
    """All *.wav files under the folders, and files named themselves, decoded on the executors.

    Places that are not there are left out with a warning. Unreadable files stay as rows with a problem and no
    samples. pattern: a regular expression for names, such as ORIGINAL.
    """
    folders = tuple(present(spark, {f: f for f in folders}).values())
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(list(folders))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if pattern:
        files = files.where(F.col("name").rlike(pattern))

    def run(batches):
        for batch in batches:
            rates, samples, problems = [], [], []
            for raw in batch.column("content").to_pylist():
                try:
                    own, x = decode(raw, mean, rate)
                    rates.append(own), samples.append(x), problems.append(None)
                except (wave.Error, EOFError, ValueError) as e:
                    rates.append(None), samples.append(None), problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float32())), pa.array(problems, pa.string())], names=["path", "name", "sample_rate", "samples", "problem"])

    return files.select("path", "name", "content").mapInArrow(run, SCHEMA)


def clip_names(files: DataFrame) -> DataFrame:
    """Add clip_idx and round from `name`; originals have no round, other files no index."""
    number = F.regexp_extract("name", r"^clip_(\d{6})(?:_r\d+)?\.wav$", 1)
    turn = F.regexp_extract("name", AUGMENTED, 2)
    return files.withColumn("clip_idx", F.when(number != "", number.cast("int"))).withColumn("round", F.when(turn != "", turn.cast("int")))


def write_wav(clips: DataFrame, folder: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Write name, samples as 16-bit WAV files below `folder` (any URL Arrow knows); returns name, frames.

    A file is written whole under its own name, so a task that runs again writes the same.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for batch in batches:
            names, frames = batch.column("name").to_pylist(), []
            for name, x in zip(names, batch.column("samples").to_pylist()):
                data = np.clip(np.array(x or [], np.float64), -1, 1)
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                    w.writeframes((data * 32767).astype("<i2").tobytes())
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(buffer.getvalue())
                frames.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(frames, pa.int64())], names=["name", "frames"])

    return clips.select("name", "samples").mapInArrow(run, "name string, frames long")
