"""The transforms of one frame or one signal that Spark's functions can't say; operators.frames applies them inside Arrow batches."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic raised-cosine window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def butterworth(x: np.ndarray, rate: int, order: int, low: float, high: float | None) -> np.ndarray:
    """A high pass, or with `high` a band pass, by its frequency response. The second of zeros behind x takes the tail, which
    by then is far below rounding."""
    n = len(x) + rate
    edge = lambda f: np.tan(np.pi * f / rate)
    at = np.tan(np.pi * np.fft.rfftfreq(n)[1:] * (1 - 1e-12))
    p = edge(low) / (1j * at) if high is None else (edge(low) * edge(high) - at**2) / (1j * at * (edge(high) - edge(low)))
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    response = np.concatenate([[0], 1 / np.prod([p - q for q in poles], axis=0)])
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """n values by truncating or padding the Fourier series."""
    have = len(x)
    if n == have or not have:
        return x
    series, m = np.fft.rfft(x), min(n, have)
    kept = np.zeros(n // 2 + 1, complex)
    kept[: m // 2 + 1] = series[: m // 2 + 1]
    if m % 2 == 0:  # the middle frequency of the shorter one stands for both signs
        kept[m // 2] *= 2.0 if n < have else 0.5
        if n < have:
            kept[m // 2] = kept[m // 2].real
    return np.fft.irfft(kept, n) * (n / have)


def pink(x: np.ndarray) -> np.ndarray:
    """White noise with its power falling with frequency."""
    frequency = np.fft.rfftfreq(len(x)) if len(x) else np.ones(1)
    frequency[0] = frequency[1] if len(x) > 1 else 1.0
    return np.fft.irfft(np.fft.rfft(x) / np.sqrt(frequency), len(x)) if len(x) else x


def mel_filters(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """(bands, bins) triangles of equal area, spaced evenly up to 1 kHz and by ratios above."""
    knee, linear, ratio = 1000.0, 200.0 / 3, np.log(6.4) / 27
    top = knee / linear + np.log(rate / 2 / knee) / ratio if rate / 2 > knee else rate / 2 / linear
    m = np.linspace(0, top, bands + 2)
    edges = np.where(m < knee / linear, m * linear, knee * np.exp(ratio * (m - knee / linear)))
    bins, width = np.fft.rfftfreq(n_fft, 1 / rate), np.diff(edges)
    rising, falling = (bins - edges[:-2, None]) / width[:-1, None], (edges[2:, None] - bins) / width[1:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (edges[2:] - edges[:-2]))[:, None]
