"""Matching the events of two devices, and the consensus timeline of many.

On a line crossing pairs never pay, so a monotone dynamic program over both
sorted series finds the optimal assignment.  Series travel as one array per key,
and a batch of keys is worked off in numpy: the arrays of a key and a bounded
block of a program's choices have to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.operators.drift import robust_line
from tempoweave.plans.range_join import band_join, spread
from tempoweave.schemas import DRIFT

Match = tuple[np.ndarray, np.ndarray, np.ndarray]


#: Cells of a table of choices that are held at once.
CELLS = 1 << 26


def _walk(step: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], first: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a program over n rows: step gives a row's best values and choices (0 skip in the first series, 1 skip in the second, 2 a pair) from the row's number and the values before it.

    Choices are held for a block of rows at a time; values are kept where blocks begin, and a block's rows are worked out again on the way back.
    """
    size = max(1, CELLS // (m + 1))
    starts, best, held = [], first, []
    for i in range(1, n + 1):
        if (i - 1) % size == 0:
            starts.append(best)
        best, take = step(i, best)
        if n <= size:
            held.append(take)
    i, j, out = n, m, []
    for block in range(len(starts) - 1, -1, -1):
        base = block * size
        if n > size:
            held, best = [], starts[block]
            for k in range(base + 1, min(base + size, n) + 1):
                best, take = step(k, best)
                held.append(take)
        while i > base and j:
            c = held[i - base - 1][j]
            if c == 2:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif c == 1:
                j -= 1
            else:
                i -= 1
    pairs = np.array(out[::-1], int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def assign_all(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two sorted series: all of the shorter one, with the least sum of distances; of equals the earliest partners."""
    if len(a) > len(b):
        j, i = assign_all(b, a)
        return i, j
    n, m = len(a), len(b)

    def step(i: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, take = np.full(m + 1, np.inf), np.zeros(m + 1, np.int8)
        pair[1:] = best[:-1] + np.abs(a[i - 1] - b)
        now = np.minimum.accumulate(pair)
        take[1:] = np.where(pair[1:] < now[:-1], 2, 1)
        return now, take

    return _walk(step, np.zeros(m + 1), n, m)


def assign_most(a: np.ndarray, b: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """As many pairs within the band as possible, then the least sum of whole milliseconds."""
    n, m = len(a), len(b)
    worth = int(band * 1000) * (min(n, m) + 1) + 1

    def step(i: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.abs(a[i - 1] - b)
        pair, take = np.full(m + 1, -1, np.int64), np.zeros(m + 1, np.int8)
        pair[1:] = np.where(d <= band, best[:-1] + worth - (d * 1000).astype(np.int64), -1)
        now = np.maximum.accumulate(np.maximum(best, pair))
        take[1:] = np.where(now[:-1] == now[1:], 1, np.where(pair[1:] > best[1:], 2, 0))
        return now, take

    return _walk(step, np.zeros(m + 1, np.int64), n, m)


def gaussian(d: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-(d**2) / (2 * sigma**2))


def match_hungarian(a: np.ndarray, b: np.ndarray, sigma: float = 0.75, band: float = 3.0) -> Match:
    """Optimal assignment of all, then without pairs further apart than the band."""
    i, j = assign_all(a, b)
    d = np.abs(a[i] - b[j])
    return i[d <= band], j[d <= band], gaussian(d[d <= band], sigma)


def match_flow(a: np.ndarray, b: np.ndarray, sigma: float = 0.75, band: float = 3.0) -> Match:
    i, j = assign_most(a, b, band)
    return i, j, gaussian(np.abs(a[i] - b[j]), sigma)


def match_sinkhorn(a: np.ndarray, b: np.ndarray, sigma: float = 0.75, band: float = 3.0, reg: float = 0.1, rounds: int = 100) -> Match:
    """Entropic transport between uniform masses: every pair with a plan above 0.1 within the band, the plan as confidence."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    cost = np.abs(a[:, None] - b[None])
    kernel = np.exp(-cost / reg)
    u, v = np.ones(len(a)), np.ones(len(b))
    for _ in range(rounds):
        u = 1 / (kernel @ v + 1e-16)
        v = 1 / (kernel.T @ u + 1e-16)
    plan = u[:, None] * kernel * v[None]
    i, j = np.nonzero((plan > 0.1) & (cost <= band))
    return i, j, plan[i, j]


METHODS: dict[str, Callable[..., Match]] = {"hungarian": match_hungarian, "min_cost_flow": match_flow, "sinkhorn": match_sinkhorn}


def _method(name: str) -> Callable[..., Match]:
    if name not in METHODS:
        raise ValueError(f"unknown matching method {name}")
    return METHODS[name]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def match_events(left: DataFrame, right: DataFrame, keys: list[str], *, t: str = "t", method: str = "hungarian", sigma: float = 0.75, band: float = 3.0) -> DataFrame:
    """Per key the matched events: i, j (places in the sorted series, from 0), t_left, t_right, confidence."""
    match = _method(method)
    series = lambda df, name: df.filter(F.col(t).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(t).cast("double"))).alias(name))
    both = spread(series(left, "_a").join(series(right, "_b"), keys), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, (a, b) in enumerate(zip(_arrays(batch.column("_a")), _arrays(batch.column("_b")), strict=True)):
                i, j, c = match(a, b, sigma, band)
                row += [k] * len(i)
                out.append((i, j, a[i], b[j], c))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
            given = batch.select(keys).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*given.columns, *(pa.array(c.astype(np.int64)) for c in columns[:2]), *(pa.array(c.astype(float)) for c in columns[2:])], names=[*keys, "i", "j", "t_left", "t_right", "confidence"])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i long, j long, t_left double, t_right double, confidence double")


def match_candidates(left: DataFrame, right: DataFrame, keys: list[str], *, t: str = "t", sigma: float = 0.75, band: float = 3.0) -> DataFrame:
    """All pairs within the band, with their distance and Gaussian confidence."""
    pairs = band_join(left.select(*keys, F.col(t).alias("t_left")), right.select(*keys, F.col(t).alias("t_right")), keys, left_t="t_left", right_t="t_right", band=band)
    d = F.abs(F.col("t_left") - F.col("t_right"))
    return pairs.select(*keys, "t_left", "t_right", d.alias("dt"), F.exp(-(d * d) / (2 * sigma * sigma)).alias("confidence"))


def cost_matrix(left: DataFrame, right: DataFrame, keys: list[str], *, t: str = "t", power: float = 1.0) -> DataFrame:
    """|t_left - t_right| ** power of every pair of a key."""
    a, b = left.select(*keys, F.col(t).alias("t_left")), right.select(*keys, F.col(t).alias("t_right"))
    return a.join(b, keys).withColumn("cost", F.pow(F.abs(F.col("t_left") - F.col("t_right")), F.lit(power)))


def match_in_order(left: DataFrame, right: DataFrame, keys: list[str], *, t: str = "t", sigma: float = 0.75, band: float = 3.0) -> DataFrame:
    """The optimal assignment of series of equal length, as a join on places: pairs within the band."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(t)) - 1
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    a = left.select(*keys, F.col(t).alias("t_left"), nth.alias("i"), size.alias("n"))
    b = right.select(*keys, F.col(t).alias("t_right"), nth.alias("i"), size.alias("n"))
    d = F.abs(F.col("t_left") - F.col("t_right"))
    return a.join(b, [*keys, "i", "n"]).filter(d <= band).select(*keys, F.col("i").cast("long").alias("i"), "t_left", "t_right", F.exp(-(d * d) / (2 * sigma * sigma)).alias("confidence"))


# ---------------------------------------------------------------- drift of arrays, for the fold


def estimate_drift(ref: np.ndarray, dev: np.ndarray, method: str = "theil_sen", min_pairs: int = 5, rounds: int = 3) -> tuple[float, float, float, int, str]:
    """offset, scale, r_squared, n_matches, method of ref = scale * dev + offset."""
    ref, dev = np.sort(ref), np.sort(dev)
    if method in ("theil_sen", "theilsen"):
        i, j = assign_all(ref, dev)
        r, d = ref[i], dev[j]
        if len(r) >= min_pairs:
            offset, scale, fit = robust_line(r, d, rounds=rounds, min_pairs=min_pairs)
            return offset, scale, fit, len(r), "theil_sen"
    elif method not in ("endpoints", "linear"):
        raise ValueError(f"unknown drift method {method}")
    if len(ref) < 2 or len(dev) < 2:
        return 0.0, 1.0, 0.0, 0, "endpoints"
    span = dev[-1] - dev[0]
    scale = float((ref[-1] - ref[0]) / span) if span else 1.0
    return float(ref[0] - scale * dev[0]), scale, 1.0 if ref[-1] > ref[0] else 0.0, 2, "endpoints"


def device_drift(reference: DataFrame, device: DataFrame, keys: list[str], *, t: str = "t", method: str = "theil_sen") -> DataFrame:
    """Per key: offset, scale, r_squared, n_matches, and the method used (the end points where the robust line has too few pairs)."""
    series = lambda df, name: df.filter(F.col(t).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(t).cast("double"))).alias(name))
    both = spread(series(reference, "_a").join(series(device, "_b"), keys), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [estimate_drift(a, b, method) for a, b in zip(_arrays(batch.column("_a")), _arrays(batch.column("_b")), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), (pa.float64(),) * 3 + (pa.int64(), pa.string()), strict=True)] if lines else [pa.array([], k) for k in (pa.float64(),) * 3 + (pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *columns], names=[*keys, "offset", "scale", "r_squared", "n_matches", "method"])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", offset double, scale double, r_squared double, n_matches long, method string")


def fold_timeline(series: list[np.ndarray], *, method: str, sigma: float, band: float, drift: str | None, convention: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Consensus times and confidences, device times and weights (device x row; NaN and 0 where absent), and drift rows."""
    first = series[0]
    times, conf = first.copy(), np.ones(len(first))
    at, weight = [first.copy()], [np.ones(len(first))]
    drifts = [(0.0, 1.0, 1.0, 0, "reference")]
    for raw in series[1:]:
        line = estimate_drift(times, raw, drift) if drift and len(times) and len(raw) else (0.0, 1.0, 0.0, 0, "no_correction")
        drifts.append(line)
        moved = (raw - line[0]) / line[1] if convention == "reference" else line[1] * raw + line[0]
        order_a, order_b = np.argsort(times, kind="stable"), np.argsort(moved, kind="stable")
        i, j, c = _method(method)(times[order_a], moved[order_b], sigma, band)
        i, j = order_a[i], order_b[j]
        own_t, own_w = np.full(len(times), np.nan), np.zeros(len(times))
        own_t[i], own_w[i] = moved[j], c
        np.add.at(conf, i, c)
        new = np.setdiff1d(np.arange(len(moved)), j)
        pad = lambda x, v: np.r_[x, np.full(len(new), v)]  # noqa: B023, E731
        at, weight = [pad(x, np.nan) for x in at] + [np.r_[own_t, moved[new]]], [pad(x, 0.0) for x in weight] + [np.r_[own_w, np.ones(len(new))]]
        times, conf = np.r_[times, moved[new]], np.r_[conf, np.ones(len(new))]
        w = np.where(np.isnan(at), 0.0, weight)
        total = w.sum(0)
        times = np.where(total > 0, (np.nan_to_num(at) * w).sum(0) / np.where(total > 0, total, 1), times)
    return times, conf, np.array(at), np.array(weight), drifts


def consensus_timeline(markers: DataFrame, keys: list[str], devices: list[str], *, t: str = "t", method: str = "hungarian", sigma: float = 0.75, band: float = 3.0, drift: str | None = "theil_sen", convention: str = "reference") -> DataFrame:
    """Per key the devices merged in the given order, the first one being the axis; long rows: cons_id, cons_t, confidence, device, t, weight (t null and weight 0 where a device has no event), drift (the device's offset, scale, r_squared, n_matches, method).

    Only keys with an event of the first device have a timeline.
    """
    _method(method)
    columns = [F.array_sort(F.collect_list(F.when(F.col("device") == d, F.col(t).cast("double")))).alias(f"_{k}") for k, d in enumerate(devices)]
    series = spread(markers.filter(F.col("device").isin(*devices) & F.col(t).isNotNull()).select(*keys, "device", t), keys).groupBy(*keys).agg(*columns).filter(F.size("_0") > 0)

    fields = [("offset", pa.float64()), ("scale", pa.float64()), ("r_squared", pa.float64()), ("n_matches", pa.int32()), ("method", pa.string())]

    def drift_rows(lines: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*lines, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [_arrays(batch.column(f"_{k}")) for k in range(len(devices))]
            for row in range(batch.num_rows):
                times, conf, at, weight, lines = fold_timeline([a[row] for a in arrays], method=method, sigma=sigma, band=band, drift=drift, convention=convention)
                order = np.argsort(times, kind="stable")
                n = len(times)
                given = batch.select(keys).take(pa.array(np.full(n * len(devices), row)))
                flat_t = at[:, order].T.ravel()
                yield pa.RecordBatch.from_arrays(
                    [*given.columns, pa.array(np.repeat(np.arange(n), len(devices))), pa.array(np.repeat(times[order], len(devices))), pa.array(np.repeat(conf[order], len(devices))), pa.array(devices * n), pa.array(flat_t, mask=np.isnan(flat_t)), pa.array(weight[:, order].T.ravel()), drift_rows(lines).take(pa.array(np.tile(np.arange(len(devices)), n)))],
                    names=[*keys, "cons_id", "cons_t", "confidence", "device", "t", "weight", "drift"],
                )

    kinds = dict(series.dtypes)
    return series.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", cons_id long, cons_t double, confidence double, device string, t double, weight double, drift {DRIFT}")


def wide_timeline(timeline: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """One row per consensus event, with a time and weight column for each device."""
    grouped = timeline.groupBy(*keys, "cons_id", F.col("cons_t").alias("consensus_time"), F.col("confidence").alias("consensus_confidence"))
    return grouped.pivot("device", devices).agg(F.first("t").alias("time"), F.first("weight").alias("weight"))


def timeline_metadata(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of devices and events, the range, and by device the number of events and the drift."""
    events = timeline.groupBy(*keys).agg(F.countDistinct("cons_id").alias("n_consensus_events"), F.countDistinct("device").alias("n_devices"), F.min("cons_t").alias("lo"), F.max("cons_t").alias("hi"))
    per = timeline.groupBy(*keys, "device").agg(F.count("t").alias("n"), F.first("drift").alias("drift")).groupBy(*keys)
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", c))))
    per = per.agg(by("n").alias("events_by_device"), by("drift").alias("drift_by_device"))
    return events.join(per, keys)
