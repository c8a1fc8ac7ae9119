"""Signal processing that expressions cannot state: numpy over Arrow batches, one row a clip."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.sources.tables import SAMPLE_RATE

#: Samples of a mel hop and frame, bands, and the scale of the features.
MEL_HOP, MEL_FRAME, MEL_BANDS, MEL_DIVIDE, MEL_ADD = 160, 512, 32, 10.0, 2.0


def per_row(df: DataFrame, column: str, out: str, kind: T.DataType, make: Callable[[np.ndarray, dict], object]) -> DataFrame:
    """Add `out`: make(samples, row's other columns) for each row; null samples give null. A column `out` is replaced."""
    df = df.drop(out) if out != column else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches):
        for batch in batches:
            samples = batch.column(column)
            rows = batch.drop_columns([column]).to_pylist() if batch.num_columns > 1 else [{}] * batch.num_rows
            values = [make(np.nan_to_num(samples[i].values.to_numpy(zero_copy_only=False).astype(np.float64)), r) if samples[i].is_valid else None for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, as_arrow(values, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def as_arrow(values: list, kind: T.DataType) -> pa.Array:
    """Numbers, vectors or matrices of numpy as one Arrow array, without Python lists between; None is null."""
    if not isinstance(kind, T.ArrayType):
        return pa.array(values, pa.float64())
    depth = 2 if isinstance(kind.elementType, T.ArrayType) else 1
    arrays = [np.asarray(v, np.float64) if v is not None else None for v in values]
    flat = pa.array(np.concatenate([a.ravel() for a in arrays if a is not None] or [np.zeros(0)]))
    if depth == 2:
        rows = [n for a in arrays if a is not None for n in [a.shape[1] if a.ndim == 2 else 0] * len(a)]
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rows))), pa.int32()), flat)
    ends = np.cumsum([0 if a is None else len(a) for a in arrays])
    offsets = pa.array([None if a is None else int(e) - len(a) for a, e in zip(arrays, ends)] + [int(ends[-1]) if len(ends) else 0], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat)


@functools.cache
def mel_filters(bands: int = MEL_BANDS, frame: int = MEL_FRAME, rate: int = SAMPLE_RATE, low: float = 60.0, high: float = 3800.0) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    rise = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def mel(x: np.ndarray, _row: dict | None = None) -> np.ndarray:
    """Log mel energies, frames by bands, of whole frames, divided by 10 plus 2."""
    if len(x) < MEL_FRAME:
        return np.zeros((0, MEL_BANDS))
    frames = np.lib.stride_tricks.sliding_window_view(x, MEL_FRAME)[::MEL_HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(MEL_FRAME), axis=1)) ** 2 @ mel_filters().T
    return (10 * np.log10(np.maximum(energy, 1e-10)) / MEL_DIVIDE + MEL_ADD)


def convolve(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Room response by FFT, peak-normalised, as long as the signal."""
    if not len(x) or not len(response):
        return x
    top = np.abs(response).max()
    n = len(x) + len(response) - 1
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response / top if top > 0 else response, n), n)[: len(x)]


def equalise(x: np.ndarray, gains: list[float]) -> np.ndarray:
    """Gains in dB at evenly spaced frequencies, interpolated over the spectrum."""
    if not len(x):
        return x
    spectrum = np.fft.rfft(x)
    at = np.linspace(0, len(gains) - 1, len(spectrum))
    return np.fft.irfft(spectrum * 10 ** (np.interp(at, np.arange(len(gains)), gains) / 20), len(x))


def distort(x: np.ndarray, drive: float) -> np.ndarray:
    """Soft clipping with the level kept."""
    top = np.abs(x).max(initial=0)
    y = np.tanh(drive * x)
    return y * (top / max(np.abs(y).max(initial=0), 1e-12))


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Band-limited resampling by the spectrum."""
    n = round(len(x) * target / source)
    if not len(x) or not n:
        return np.zeros(0)
    spectrum = np.fft.rfft(x)
    kept = np.zeros(n // 2 + 1, complex)
    m = min(len(kept), len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * n / len(x)


def augment(x: np.ndarray, row: dict) -> np.ndarray:
    """The row's steps: `gains` to equalise, `drive` to distort, `response` of a room; each only where given."""
    if row.get("gains"):
        x = equalise(x, row["gains"])
    if row.get("drive"):
        x = distort(x, row["drive"])
    if row.get("response"):
        x = convolve(x, np.asarray(row["response"], np.float64))
    return x
