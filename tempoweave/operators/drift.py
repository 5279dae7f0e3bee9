"""Clock drift between devices, and its correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift_endpoints(reference: DataFrame, device: DataFrame, keys: list[str], *, t: str = "t") -> DataFrame:
    """Per key: offset, scale, r_squared, n_matches of the line through both series' first and last events.

    Series of fewer than two events give the identity with r_squared 0 and no matches.
    """
    ends = lambda df, p: df.groupBy(*keys).agg(F.min(t).alias(p + "_lo"), F.max(t).alias(p + "_hi"), F.count(t).alias(p + "_n"))
    both = ends(reference, "r").join(ends(device, "d"), keys)
    enough = (F.col("r_n") >= 2) & (F.col("d_n") >= 2)
    span = F.col("d_hi") - F.col("d_lo")
    scale = F.when(~enough | (span == 0), 1.0).otherwise((F.col("r_hi") - F.col("r_lo")) / F.nullif(span, F.lit(0.0)))
    out = both.withColumn("scale", scale).withColumn("offset", F.when(enough, F.col("r_lo") - F.col("scale") * F.col("d_lo")).otherwise(0.0))
    fit = F.when(enough & (F.col("r_hi") > F.col("r_lo")), 1.0).otherwise(0.0)
    return out.select(*keys, "offset", "scale", fit.alias("r_squared"), F.when(enough, 2).otherwise(0).cast("long").alias("n_matches"))


#: Pairs of events whose slopes are held at once; of longer series the median is found by narrowing bounds.
PAIRS = 1 << 22


def _slopes(ref: np.ndarray, dev: np.ndarray, rows: range) -> np.ndarray:
    """Slopes of the pairs of the events of some rows with all later ones."""
    i = np.repeat(np.array(rows), [len(ref) - 1 - r for r in rows])
    j = np.concatenate([np.arange(r + 1, len(ref)) for r in rows])
    step = dev[j] - dev[i]
    use = np.abs(step) > 1e-10
    return (ref[j] - ref[i])[use] / step[use]


def _median_slope(ref: np.ndarray, dev: np.ndarray) -> float:
    """The median of the slopes of all pairs, in blocks of rows.

    While more slopes lie between the bounds than may be held, the bounds close
    in on the middle by the blocks' own quantiles, so memory stays bounded.
    """
    n = len(ref)
    step = max(1, PAIRS // n)
    blocks = [range(k, min(k + step, n - 1)) for k in range(0, n - 1, step)]
    if len(blocks) == 1:
        slopes = _slopes(ref, dev, blocks[0])
        return float(np.median(slopes)) if len(slopes) else 1.0
    low, high, total = -np.inf, np.inf, None
    while True:
        below, inside, middles = 0, 0, []
        for rows in blocks:
            slopes = _slopes(ref, dev, rows)
            below += int((slopes < low).sum())
            slopes = slopes[(slopes >= low) & (slopes <= high)]
            inside += len(slopes)
            middles += [(float(q), len(slopes)) for q in np.quantile(slopes, (0.25, 0.5, 0.75))] if len(slopes) else []
        total = inside if total is None else total
        if not total:
            return 1.0
        if inside <= PAIRS or low == high:
            held = np.sort(np.concatenate([s[(s >= low) & (s <= high)] for s in (_slopes(ref, dev, rows) for rows in blocks)]))
            return float((held[(total - 1) // 2 - below] + held[total // 2 - below]) / 2)
        # a pivot splits the slopes between the bounds; the middle ranks lie on one side of it or around it
        middles.sort()
        pivot = middles[int(np.searchsorted(np.cumsum([w for _, w in middles]), sum(w for _, w in middles) / 2))][0]
        less = equal = 0
        for rows in blocks:
            slopes = _slopes(ref, dev, rows)
            less += int((slopes < pivot).sum())
            equal += int((slopes == pivot).sum())
        if total // 2 < less:
            high = np.nextafter(pivot, -np.inf)
        elif (total - 1) // 2 >= less + equal:
            low = np.nextafter(pivot, np.inf)
        elif (total - 1) // 2 >= less and total // 2 < less + equal:
            return pivot
        elif (total - 1) // 2 < less:  # the two middle ranks lie on both sides
            before = max(float(s[s < pivot].max()) for s in (_slopes(ref, dev, rows) for rows in blocks) if (s < pivot).any())
            return (before + pivot) / 2
        else:
            after = min(float(s[s > pivot].min()) for s in (_slopes(ref, dev, rows) for rows in blocks) if (s > pivot).any())
            return (pivot + after) / 2


def _median_line(ref: np.ndarray, dev: np.ndarray) -> tuple[float, float]:
    """Scale (median of the slopes of all pairs of events) and offset (median of what remains)."""
    if len(ref) < 2:
        return 1.0, 0.0
    scale = _median_slope(ref, dev)
    return scale, float(np.median(ref - scale * dev))


def robust_line(ref: np.ndarray, dev: np.ndarray, *, rounds: int = 3, min_pairs: int = 5) -> tuple[float, float, float]:
    """offset, scale and r_squared of ref = scale * dev + offset through matched events.

    After each round events whose residual is over twice the median are left out
    of the next, if the median is positive and `min_pairs` stay; the choice is
    always made among all events.
    """
    scale, offset = _median_line(ref, dev)
    for _ in range(rounds - 1):
        off = np.abs(ref - (scale * dev + offset))
        middle = np.median(off)
        near = off <= 2 * middle
        if middle > 0 and near.sum() >= min_pairs:
            scale, offset = _median_line(ref[near], dev[near])
    spread = np.var(ref)
    return offset, scale, float(max(0.0, 1 - np.var(ref - (scale * dev + offset)) / spread)) if spread > 0 else 0.0


def drift_theil_sen(pairs: DataFrame, keys: list[str], *, rounds: int = 3, min_pairs: int = 5) -> DataFrame:
    """Per key: offset, scale, r_squared, n_matches of the robust line through matched events (ref, dev).

    Keys with fewer pairs than `min_pairs` have no row (the end point method is theirs).
    """
    arrays = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dev", "ref"))).alias("p")).filter(F.size("p") >= min_pairs)
    arrays = arrays.select(*keys, F.transform("p", lambda x: x["ref"]).alias("ref"), F.transform("p", lambda x: x["dev"]).alias("dev"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.array(r.as_py(), float), np.array(d.as_py(), float)) for r, d in zip(batch.column("ref"), batch.column("dev"), strict=True)]
            lines = np.array([robust_line(r, d, rounds=rounds, min_pairs=min_pairs) for r, d in both], float).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *(pa.array(x) for x in lines), pa.array([len(r) for r, _ in both], pa.int64())], names=[*keys, "offset", "scale", "r_squared", "n_matches"])

    kinds = dict(arrays.dtypes)
    return arrays.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", offset double, scale double, r_squared double, n_matches long")


def corrected(t: Column, offset: Column, scale: Column, *, convention: str = "reference") -> Column:
    """A device's time on the reference axis.

    `reference` is (t - offset) / scale, which results of existing analyses
    follow; the estimators fit ref = scale * t + offset, so `forward`, the map
    that they fit, is the one that removes the drift.
    """
    if convention not in ("reference", "forward"):
        raise ValueError(f"unknown drift convention {convention}")
    return (t - offset) / scale if convention == "reference" else scale * t + offset


def device_time(t: Column, offset: Column | None, scale: Column | None) -> Column:
    """A consensus time on the device's axis: t * scale + offset, unchanged without parameters."""
    return t * F.coalesce(F.lit(1.0) if scale is None else scale, F.lit(1.0)) + F.coalesce(F.lit(0.0) if offset is None else offset, F.lit(0.0))
