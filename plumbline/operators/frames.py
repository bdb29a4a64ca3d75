"""Spectral work on signals, each of which is whole in its row.

Rows are dealt out once by CALL, a hash of the call. What is done to a signal's frames (transforms, and all that needs the frames around a
frame or all of a signal's: medians, percentiles, running phases, overlap-add) works on them together, as a matrix of frames by
bins that is made and left again signal by signal inside an Arrow batch: frames are never rows, so nothing is sorted or kept for them.

The frames of one signal, about four times its samples, have to fit a task: cut long recordings into segments first (sources.audio_files).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import signals as G
from ..functions import vectors as X
from ..functions.scalar import let

CALL = "call"
N_FFT, HOP = 2048, 512
VALUES = ArrayType(DoubleType())
#: Shares of magnitude that denoising leaves, and the peak that normalising aims at.
SUBTRACTION_FLOOR, ADAPTIVE_FLOOR, PEAK = 0.1, 0.05, 0.95
#: Bytes of the rows of a batch that are worked on together.
PART_BYTES = 1 << 24


def dealt(calls: DataFrame) -> DataFrame:
    """calls with CALL, dealt out by it over the tasks."""
    return calls.withColumn(CALL, F.xxhash64(*calls.columns)).repartition(CALL)


def cut(x: Column, length: Column | int, hop: Column | int) -> Column:
    """The frames that lie whole in x, as an array of arrays."""
    length, hop = (v if isinstance(v, Column) else F.lit(v) for v in (length, hop))

    def frames(given: Column) -> Column:
        y, size, step = given["y"], given["length"], given["hop"]
        last = F.floor((F.size(y) - size) / step).cast("int")
        return F.when(F.size(y) >= size, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(y, k * step + 1, size)))

    return let(F.struct(x.alias("y"), length.alias("length"), hop.alias("hop")), frames)


def centred(x: Column, n: Column | int) -> Column:
    """x between half a frame of zeros on either side."""
    n = n if isinstance(n, Column) else F.lit(n)
    silence = F.array_repeat(F.lit(0.0), F.floor(n / 2).cast("int"))
    return F.concat(silence, x, silence)


def frames_of(x: np.ndarray, size: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """The frames that lie whole in x, frames x samples."""
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size))


def signals_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a list column, row by row."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[n or 0 for n in column.value_lengths().to_pylist()]])
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def spectrum_of(x: np.ndarray) -> np.ndarray:
    """The transforms of a signal's frames, frames x bins."""
    return np.fft.rfft(frames_of(x) * G.hann(N_FFT))


def overlap_add(spectrum: np.ndarray) -> np.ndarray:
    """The samples of a signal's spectrum: frames are restored, added where they lie, and divided by the sum of the squared windows. Half a
    window is left out at the start."""
    window, n = G.hann(N_FFT), len(spectrum)
    y, w = np.zeros((2, (n - 1) * HOP + N_FFT))
    for i, frame in enumerate(np.fft.irfft(spectrum, N_FFT) * window):
        y[i * HOP : i * HOP + N_FFT] += frame
        w[i * HOP : i * HOP + N_FFT] += window**2
    return np.where(w > 1e-10, y / np.maximum(w, 1e-10), y)[N_FFT // 2 :]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, about PART_BYTES at a time: what is made of them is sent before the next ones are taken."""
    for batch in batches:
        n = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def changed(rows: DataFrame, work: dict[str, tuple[Callable[..., np.ndarray], list[str]]]) -> DataFrame:
    """rows with the signals of some columns changed: {column: (work, given)}, a signal becomes work(signal, *given), null stays null.

    Whole rows go to the tasks' Python, in batches bounded by their bytes. A column function would be handed nulls for the rows that
    don't need it, so up to spark.sql.execution.arrow.maxRecordsPerBatch rows a batch, and all of their signals would wait in the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = dict(zip(batch.schema.names, batch.columns))
            for name, (f, given) in work.items():
                each = zip(columns[name].is_valid().to_pylist(), signals_of(columns[name]), *[batch.column(c).to_pylist() for c in given])
                columns[name] = pa.array([f(x, *values) if there else None for there, x, *values in each], columns[name].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, rows.schema)


def resynthesised(signals: DataFrame, work: Callable[..., np.ndarray], given: list[str], carried: list[str]) -> DataFrame:
    """(carried, samples, n_frames) of signals (CALL, x, given, carried): work(x, *given) gives a signal's new spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            each = zip(signals_of(batch.column("x")), *[batch.column(c).to_pylist() for c in given])
            spectra = (work(x, *values) for x, *values in each)
            done = [(overlap_add(z), len(z)) for z in spectra]
            ends = np.cumsum([0, *[len(y) for y, _ in done]]).astype(np.int32)
            samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *[y for y, _ in done]])))
            n_frames = pa.array([n for _, n in done], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], samples, n_frames], [*carried, "samples", "n_frames"])

    schema = StructType([*[signals.schema[c] for c in carried], StructField("samples", VALUES), StructField("n_frames", IntegerType())])
    return signals.mapInArrow(run, schema)


def median_near(m: np.ndarray) -> np.ndarray:
    """Of each frame, the medians of the 21 frames around it; beyond the ends frames are mirrored."""
    n, out = len(m), np.empty_like(m)
    for i in range(n):
        at = (i + np.arange(-10, 11)) % (2 * n)
        out[i] = np.median(m[np.where(at < n, at, 2 * n - 1 - at)], axis=0)
    return out


def gains(m: np.ndarray, kind: str, factor: float, quiet: int) -> np.ndarray:
    """What each magnitude (frames x bins) is scaled by; the first `quiet` frames are taken for noise."""
    ratio = lambda kept: np.divide(kept, m, out=np.zeros_like(m), where=m > 0)
    if kind == "spectral_subtraction":
        return ratio(np.maximum(m - factor * np.median(m[:quiet], axis=0), SUBTRACTION_FLOOR * m))
    if kind == "wiener":
        power = (m / (N_FFT / 2)) ** 2
        return np.maximum(power - power[:quiet].mean(0), 0.0) / (power + 1e-10)
    if kind == "echo_cancellation":
        envelope = median_near(m)
        return 1 / (1 + 0.3 * envelope / (envelope.max() + 1e-10))
    if kind == "adaptive":
        inner = min(1.0, max(0.0, factor))
        floor = np.stack([np.percentile(m[max(0, i - 20) : i + 20], 10 + 40 * (1 - inner), axis=0) for i in range(len(m))])
        return ratio(np.maximum(m - 1.5 * inner * floor, ADAPTIVE_FLOOR * m))
    energy = m.mean(0) + 1e-10
    return np.broadcast_to((np.median(energy) / energy) ** factor, m.shape)


def _reweighted(x: np.ndarray, kind: str, factor: float, quiet: int, rate: int) -> np.ndarray:
    z = spectrum_of(G.butterworth(x, rate, 4, 80.0, None) if kind == "echo_cancellation" else x)
    return z * gains(np.abs(z), kind, factor, quiet)


def reweighted(signals: DataFrame) -> DataFrame:
    """(head, samples): every cell of a signal's spectrum scaled by the gain of its `gain`, one of spectral_subtraction, wiener,
    echo_cancellation, adaptive and spectral_normalize. signals: CALL, head, rate, x, gain, factor (noise factor,
    sensitivity or strength).

    Denoising starts half a window in and ends in silence of that length, echo_cancellation after a high pass at 80 Hz; spectral_normalize has centred frames and a fixed peak.
    """
    is_ = lambda *names: F.col("gain").isin(*names)
    x = F.when(is_("spectral_normalize"), centred(F.col("x"), N_FFT)).otherwise(F.col("x"))
    rows = signals.select(CALL, "head", "rate", "gain", "factor", F.size("x").alias("length"), F.greatest(F.lit(1), F.floor(0.5 * F.col("rate") / HOP).cast("int")).alias("quiet"), x.alias("x"))
    done = resynthesised(rows, _reweighted, ["gain", "factor", "quiet", "rate"], ["head", "gain", "length"])
    y, length = F.col("samples"), F.col("length")
    within = F.slice(y, F.lit(1), HOP * (F.col("n_frames") - 1))
    samples = F.when(is_("spectral_normalize"), X.normalise_peak(X.match_length(y, length), PEAK)).otherwise(X.match_length(within, length))
    return done.select("head", samples.alias("samples"))


def _turned(x: np.ndarray, speed: float) -> np.ndarray:
    """The spectrum of a signal read at its speed: magnitudes between frames; phases advance by what neighbouring frames differ."""
    z = spectrum_of(x)
    n = len(z)
    at = np.arange(math.ceil(n / speed)) * speed
    frame = np.floor(at).astype(np.int64)
    at, frame = at[frame < n], frame[frame < n]
    later = np.concatenate([z[1:], np.zeros((1, z.shape[1]), complex)])
    expected = math.pi * HOP * np.arange(z.shape[1]) / (N_FFT // 2)
    turn = np.angle(later) - np.angle(z) - expected
    advance = (expected + turn - 2 * math.pi * np.rint(turn / (2 * math.pi)))[frame]
    phase = np.angle(z[0]) + np.cumsum(advance, axis=0) - advance
    part = (at - frame)[:, None]
    return ((1 - part) * np.abs(z[frame]) + part * np.abs(later[frame])) * np.exp(1j * phase)


def stretched(signals: DataFrame) -> DataFrame:
    """(head, samples) of signals (CALL, head, x, speed): a phase vocoder."""
    rows = signals.select(CALL, "head", "speed", F.rint(F.size("x") / F.col("speed")).cast("int").alias("length"), centred(F.col("x"), N_FFT).alias("x"))
    turned = resynthesised(rows, _turned, ["speed"], ["head", "length"])
    return turned.select("head", X.match_length(F.col("samples"), F.col("length")).alias("samples"))


BANDS, CEPSTRA, MEL_FFT, MEL_HOP = 64, 13, 1024, 256


def _cosines() -> np.ndarray:
    """The matrix that takes a frame's levels to its first CEPSTRA cosine coefficients."""
    k, c = np.arange(BANDS), np.arange(CEPSTRA)[:, None]
    return np.sqrt(2 / BANDS) * np.cos(np.pi * c * (2 * k + 1) / (2 * BANDS)) * np.where(c == 0, np.sqrt(0.5), 1)


def _levels(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The levels of a signal's centred frames in dB, frames x bands, none more than 80 below the loudest."""
    power = np.abs(np.fft.rfft(frames_of(np.pad(x, MEL_FFT // 2), MEL_FFT, MEL_HOP) * G.hann(MEL_FFT))) ** 2
    db = 10 * np.log10(np.maximum(1e-10, power @ filters.T))
    return np.maximum(db, db.max() - 80)


def _compared(x: np.ndarray, y: np.ndarray, filters: np.ndarray, cosines: np.ndarray) -> tuple[float, float, float]:
    """The closeness of two signals: both sides' levels and cepstra, each band's course resampled to the longer one."""
    sides = [_levels(v, filters) for v in (x, y)]
    n = max(map(len, sides))
    whole = [np.stack([G.resample(c, n) for c in np.hstack([v, v @ cosines.T]).T]) for v in sides]
    (a, p), (b, q) = ((v[:BANDS], v[BANDS:]) for v in whole)
    cosine = lambda u, v: float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()) + 1e-8))
    return cosine(a, b), float(np.abs(a - b).mean()), cosine(p, q)


CLOSE = ("log_mel_cosine", "log_mel_l1", "mfcc_cosine")


def spectral_closeness(pairs: DataFrame) -> DataFrame:
    """(head, log_mel_cosine, log_mel_l1, mfcc_cosine) of pairs (CALL, head, rate, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosines, filters = _cosines(), {}
        for batch in batches:
            found = []
            for rate, x, y in zip(batch.column("rate").to_pylist(), signals_of(batch.column("x")), signals_of(batch.column("y"))):
                if rate not in filters:  # those of the last rate are kept
                    filters = {rate: G.mel_filters(rate, MEL_FFT, BANDS)}
                found.append(_compared(x, y, filters[rate], cosines))
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(CLOSE))]
            yield pa.RecordBatch.from_arrays([batch.column("head"), *columns], ["head", *CLOSE])

    return pairs.mapInArrow(run, StructType([pairs.schema["head"], *[StructField(c, DoubleType()) for c in CLOSE]]))


def resampled(x: np.ndarray, n: int | None) -> np.ndarray:
    """x with n values, by its Fourier series; as it is without n."""
    return x if n is None else G.resample(x, n)


def band_passed(x: np.ndarray, rate: int, high: float) -> np.ndarray:
    """What of x is heard: 20 Hz to `high`."""
    return G.butterworth(x, rate, 2, 20.0, high)


def coloured(x: np.ndarray, kind: str) -> np.ndarray:
    """Noise of a kind, of white noise: that of pink noise falls in power with frequency."""
    return G.pink(x) if kind == "pink" else x
