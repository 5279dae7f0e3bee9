"""Spectra and filters of whole channels: numpy over one array per channel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_arrays(signals: DataFrame, keys: list[str], *, index: str = "sample_idx", x: str = "x") -> DataFrame:
    """Per channel its finite samples in order, and their places."""
    finite = signals.filter(F.col(x).isNotNull() & ~F.isnan(x))
    pairs = finite.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.col(x).cast("double").alias("x")))).alias("pairs"))
    return pairs.select(*keys, F.transform("pairs", lambda s: s["x"]).alias("samples"), F.transform("pairs", lambda s: s["i"]).alias("places"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, without a Python object for each element."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def without_gaps(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Samples at every place from the first to the last one, gaps bridged by straight lines."""
    every = np.arange(places[0], places[-1] + 1)
    return x if len(every) == len(x) else np.interp(every, places, x)


def welch(x: np.ndarray, fs: float, segment: int = 256, overlap: float = 0.5, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density, averaged over segments, each without its mean and under a periodic window."""
    n = min(segment, len(x))
    step = n - int(n * overlap)
    k = 2 * np.pi * np.arange(n) / n
    w = 0.5 - 0.5 * np.cos(k) if window == "hann" else 0.54 - 0.46 * np.cos(k)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    parts = (parts - parts.mean(1, keepdims=True)) * w
    power = (np.abs(np.fft.rfft(parts)) ** 2).mean(0) / (fs * (w**2).sum())
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float, empty: float = np.nan) -> float:
    """Trapezoid over low <= f < high."""
    use = (f >= low) & (f < high)
    return float(np.trapezoid(p[use], f[use])) if use.any() else empty


def spectral_row(x: np.ndarray, fs: float, eps: float = 1e-8) -> tuple[float, ...]:
    """spectral_entropy, power_low, power_mayer, power_resp, mayer_ratio, resp_ratio; NaN below 10 samples."""
    if len(x) < 10:
        return (np.nan,) * 6
    f, p = welch(x, fs)
    q = p[p > 0]
    q = q / q.sum() if len(q) else q
    entropy = float(-(q * np.log(q + eps)).sum()) if len(q) else np.nan
    low, mayer, resp = (band_power(f, p, a, b, 0.0) for a, b in ((0.01, 0.08), (0.08, 0.15), (0.15, 0.40)))
    return entropy, low, mayer, resp, mayer / (low + resp + eps), resp / (low + mayer + eps)


def snr_row(x: np.ndarray, fs: float, signal: tuple[float, float] = (0.01, 0.2), noise: tuple[float, float] = (0.2, 0.5)) -> tuple[float, float]:
    """snr_time_db and snr_psd_db; NaN below 10 samples or without noise."""
    if len(x) < 10:
        return np.nan, np.nan
    rough = np.std(np.diff(x))
    f, p = welch(x, fs, overlap=0.0, window="hamming")
    use = (f >= min(signal[0], noise[0])) & (f <= max(signal[1], noise[1]))
    a, b = band_power(f[use], p[use], *signal), band_power(f[use], p[use], *noise)
    with np.errstate(all="ignore"):
        return float(20 * np.log10(np.std(x) / rough)) if rough > 0 else np.nan, float(10 * np.log10(a / b)) if b > 0 and a == a else np.nan


def _rows(signals: DataFrame, keys: list[str], names: list[str], work: Callable[[np.ndarray], tuple[float, ...]]) -> DataFrame:
    """One row of numbers per channel; NaN becomes null."""
    arrays = channel_arrays(signals, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(x) for x in _lists(batch.column("samples"))]
            columns = np.array(rows, float).reshape(len(rows), len(names)).T
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *(pa.array(c, mask=np.isnan(c)) for c in columns)], names=[*keys, *names])

    kinds = dict(arrays.dtypes)
    return arrays.mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names]))


def spectral_metrics(signals: DataFrame, keys: list[str], fs: float) -> DataFrame:
    return _rows(signals, keys, ["spectral_entropy", "power_low", "power_mayer", "power_resp", "mayer_ratio", "resp_ratio"], lambda x: spectral_row(x, fs))


def signal_to_noise(signals: DataFrame, keys: list[str], fs: float) -> DataFrame:
    return _rows(signals, keys, ["snr_time_db", "snr_psd_db"], lambda x: snr_row(x, fs))


def _series(signals: DataFrame, keys: list[str], names: tuple[str, str], kind: str, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Two columns of many rows per channel, from its samples and their places."""
    arrays = channel_arrays(signals, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (x, places) in enumerate(zip(_lists(batch.column("samples")), _lists(batch.column("places")), strict=True)):
                a, b = work(x, places)
                given = batch.select(keys).take(pa.array(np.full(len(a), k)))
                yield pa.RecordBatch.from_arrays([*given.columns, pa.array(a), pa.array(b.astype(float))], names=[*keys, *names])

    kinds = dict(arrays.dtypes)
    return arrays.mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{names[0]} {kind}", f"{names[1]} double"]))


def power_spectrum(signals: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Per channel and frequency the Welch density."""
    return _series(signals, keys, ("freq", "psd"), "double", lambda x, _: welch(x, fs))


# ---------------------------------------------------------------- filters


def _in_place(work: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Work on the whole series, gaps bridged; what comes out at the given places."""
    return lambda x, places: (places, work(without_gaps(x, places))[places - places[0]])


def _biquads(order: int, edge: float, fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth sections of an even order by the bilinear transform."""
    k = np.tan(np.pi * edge / fs)
    out = []
    for i in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * i + 1) / (2 * order))
        norm = 1 + q * k + k * k
        b = np.array([1.0, -2.0, 1.0]) if kind == "high" else np.array([1.0, 2.0, 1.0]) * k * k
        out.append((b / norm, np.array([1.0, 2 * (k * k - 1) / norm, (1 - q * k + k * k) / norm])))
    return out


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    s1, s2 = (b[1] + b[2] - (a[1] + a[2]) * b.sum() / a.sum()) * x[0], (b[2] - a[2] * b.sum() / a.sum()) * x[0]
    for n, v in enumerate(x):
        out = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * out + s2, b[2] * v - a[2] * out
        y[n] = out
    return y


def iir_band(x: np.ndarray, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band pass (forward and back, with odd padding)."""
    if len(x) < 2:
        return x.copy()
    pad = min(len(x) - 1, 3 * (2 * order + 1))
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for edge, kind in ((low, "high"), (high, "low")):
        for b, a in _biquads(order, edge, fs, kind):
            y = _section(b, a, y)
            y = _section(b, a, y[::-1])[::-1]
    return y[pad : pad + len(x)]


def fir_band(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Zero-phase windowed-sinc band pass of a length that its transition needs, by FFT."""
    taps = int(3.3 / max(min(low, 0.25 * high), 1e-6) * fs) | 1
    n = np.arange(taps) - taps // 2
    sinc = lambda edge: 2 * edge / fs * np.sinc(2 * edge / fs * n)
    h = (sinc(high) - sinc(low)) * (0.54 + 0.46 * np.cos(2 * np.pi * n / taps))
    pad = min(taps // 2, len(x) - 1) if len(x) > 1 else 0
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]] if pad else x
    size = 1 << (len(y) + taps - 1).bit_length()
    z = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(h, size), size)[taps // 2 : taps // 2 + len(y)]
    return z[pad : pad + len(x)]


def filter_method(n: int, fs: float, low: float) -> str:
    return "iir_butterworth_order4" if low <= 0.02 and n / fs < 300 else "fir_auto"


def filter_policy(n: Column, fs: float, low: float) -> Column:
    """The same of a column of lengths."""
    return F.when((n / fs < 300) & F.lit(low <= 0.02), "iir_butterworth_order4").otherwise("fir_auto")


def smart_filter(signals: DataFrame, keys: list[str], fs: float, low: float = 0.01, high: float = 0.2) -> DataFrame:
    """Band pass by the policy: IIR for a low edge in a short recording, else FIR. Samples keep their places; gaps are bridged for the filter and stay gaps."""
    work = lambda x: iir_band(x, fs, low, high) if filter_method(len(x), fs, low)[0] == "i" else fir_band(x, fs, low, high)
    return _series(signals, keys, ("sample_idx", "x"), "long", _in_place(work))


def tddr(x: np.ndarray, fs: float) -> np.ndarray:
    """Motion repair by temporal derivative distribution repair: robust weights on the derivative of the slow part."""
    if len(x) < 12:
        return x.copy()
    mean = x.mean()
    slow = x - mean
    if fs / 2 > 0.5:
        pad = min(len(x) - 1, 9)
        slow = np.r_[2 * slow[0] - slow[pad:0:-1], slow, 2 * slow[-1] - slow[-2 : -pad - 2 : -1]]
        for b, a in _biquads(2, 0.5, fs, "low"):
            slow = _section(b, a, slow)
            slow = _section(b, a, slow[::-1])[::-1]
        slow = slow[pad : pad + len(x)]
    fast = x - mean - slow
    d, w, mu = np.diff(slow), np.ones(len(x) - 1), np.inf
    for _ in range(50):
        before, mu = mu, (w * d).sum() / w.sum()
        off = np.abs(d - mu)
        sigma = 1.4826 * np.median(off)
        if sigma == 0:
            break
        r = off / (sigma * 4.685)
        w = np.where(r < 1, (1 - r**2) ** 2, 0)
        if abs(before - mu) < 1e-12 * max(abs(mu), abs(before)):
            break
    fixed = np.r_[0, np.cumsum(w * (d - mu))]
    return fixed - fixed.mean() + fast + mean


def motion_repair(signals: DataFrame, keys: list[str], fs: float) -> DataFrame:
    return _series(signals, keys, ("sample_idx", "x"), "long", _in_place(lambda x: tddr(x, fs)))


def fft_resampled(x: np.ndarray, n: int) -> np.ndarray:
    """The same band-limited signal at n samples."""
    f = np.fft.rfft(x)
    m = n // 2 + 1
    g = np.zeros(m, complex)
    k = min(len(f), m)
    g[:k] = f[:k]
    if n < len(x) and n % 2 == 0:
        g[-1] = 2 * g[-1].real if len(x) > n else g[-1]
    return np.fft.irfft(g, n) * n / len(x)


def fft_resample(signals: DataFrame, keys: list[str], fs: float, target: float, *, tolerance: float = 0.0, only_down: bool = True) -> DataFrame:
    """Resampled channels: only towards a lower rate (or, for any rate, if it differs by more than the tolerance)."""
    change = fs > target if only_down else abs(fs - target) > tolerance
    work = lambda x: fft_resampled(x, round(len(x) * target / fs))

    def both(x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not change:
            return places, x
        y = work(without_gaps(x, places))
        return round(int(places[0]) * target / fs) + np.arange(len(y)), y

    return _series(signals, keys, ("sample_idx", "x"), "long", both)
