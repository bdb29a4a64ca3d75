"""WAV segments of files in memory as columns, applied to batches; the data source in audio_files reads by ranges instead."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import riff

AUDIO = "rate int, n_frames long, samples array<float>, status string, message string, decoder string"
#: A decoder gets a file's bytes and gives (rate, frames x channels).
Decoder = Callable[[bytes], tuple[int, np.ndarray]]


def by_riff(raw: bytes) -> tuple[int, np.ndarray]:
    head = riff.header(io.BytesIO(raw), len(raw))
    return head.rate, riff.frames(io.BytesIO(raw), head, 0, head.frames)


def by_soundfile(raw: bytes) -> tuple[int, np.ndarray]:
    """Other formats, where the soundfile package is installed."""
    import soundfile

    x, rate = soundfile.read(io.BytesIO(raw), always_2d=True)
    return rate, x


DECODERS: tuple[tuple[str, Decoder], ...] = (("riff", by_riff), ("soundfile", by_soundfile))


def decode(raw: bytes, begin: float | None, end: float | None, clamp: bool, decoders: tuple[tuple[str, Decoder], ...] = DECODERS) -> tuple[int, int, np.ndarray, str]:
    """(rate, frames in the file, mono float samples of the segment, the first decoder that reads the file). A segment outside the
    file is an error, or clamped; if no decoder reads the file, the error says why each doesn't."""
    reasons = []
    for name, read in decoders:
        try:
            rate, x = read(raw)
            break
        except Exception as error:  # a decoder may fail in ways of its own
            reasons.append(f"{name}: {error}")
    else:
        raise ValueError("; ".join(reasons) or "no decoders")
    n = len(x)
    first, last = int((begin or 0.0) * rate), n if end is None else int(end * rate)
    if clamp:
        first, last = min(max(0, first), n), min(max(0, last), n)
    if not 0 <= first < last <= n:
        raise ValueError(f"segment {first}-{last} is not within 0-{n}")
    return rate, n, x[first:last].mean(1).astype(np.float32), name


def read_segments(files: DataFrame, begin: Column | None = None, end: Column | None = None, clamp: bool = False, decoders: tuple[tuple[str, Decoder], ...] = DECODERS) -> DataFrame:
    """files (path, content) with AUDIO columns, by the first of the decoders that reads a file; one that none reads is a row with status
    failure and each one's reason."""
    null = F.lit(None).cast("double")
    rows = files.select("path", "content", (null if begin is None else begin).alias("begin"), (null if end is None else end).alias("end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw, first, last in pdf.itertuples(index=False):
                try:
                    rate, n, x, decoder = decode(raw, None if pd.isna(first) else first, None if pd.isna(last) else last, clamp, decoders)
                    out.append((path, rate, n, x, "success", None, decoder))
                except ValueError as error:
                    out.append((path, None, None, None, "failure", str(error), None))
            yield pd.DataFrame(out, columns=["path", "rate", "n_frames", "samples", "status", "message", "decoder"]).astype({"rate": "Int32", "n_frames": "Int64"})

    return rows.mapInPandas(run, f"path string, {AUDIO}")


def durations(files: DataFrame) -> DataFrame:
    """(path, seconds) from RIFF headers, with built-in functions only: the data chunk's bytes over the byte rate. Assumes the
    plain layout of a 44-byte header; other files give null."""
    le32 = lambda at: F.conv(F.array_join(F.reverse(F.transform(F.sequence(F.lit(at), F.lit(at + 3)), lambda i: F.hex(F.substr(F.col("content"), i, F.lit(1))))), ""), 16, 10).cast("double")
    plain = F.hex(F.substring("content", 37, 4)) == F.hex(F.lit("data"))
    return files.select("path", F.when(plain, le32(41) / le32(29)).alias("seconds"))


@F.pandas_udf(T.BinaryType())
def encode_pcm16(samples: pd.Series, rate: pd.Series, rule: pd.Series) -> pd.Series:
    """Mono WAV bytes. Rules for values over 1: "scale" divides by the peak and cuts off fractions, "clip" clips and rounds,
    "ceiling" lowers a peak over 0.98 to that and rounds."""

    def one(x, r, how):
        x = np.asarray(x, np.float64)
        peak = np.abs(x).max() if len(x) else 0.0
        if how == "scale":
            x = np.trunc((x / peak if peak > 1 else x) * 32767)
        elif how == "clip":
            x = np.round(np.clip(x, -1, 1) * 32767)
        else:
            x = np.round((x / peak * 0.98 if peak > 0.98 else x) * 32767)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(x.astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(x, r, h) for x, r, h in zip(samples, rate, rule)])
