"""Trigger edges and greedy cleaning over a stream, with one row of state per series.

Rows of a series must arrive in order across batches; within a batch they are
sorted.  The watermark only bounds what the source keeps: state is a single
number per series and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def clean_stream(markers: DataFrame, keys: list[str], *, t: str = "t", min_interval: float = 1.0) -> DataFrame:
    """Markers at least `min_interval` after the last one kept of their series."""
    kinds = dict(markers.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {t} double"

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(x for batch in batches for x in batch[t].dropna().tolist())
        kept = []
        for x in times:
            if last is None or x - last >= min_interval:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame([(*key, x) for x in kept], columns=[*keys, t])

    return markers.groupBy(*keys).applyInPandasWithState(keep, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def edge_stream(samples: DataFrame, keys: list[str], *, index: str = "i", voltage: str = "v", fs: float = 500.0, tolerance: float = 0.2) -> DataFrame:
    """Samples at which the level changes; out-of-band samples always count."""
    kinds = dict(samples.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {index} long, reference_time double, level double"

    def level(v: float) -> float | None:
        return 0.0 if abs(v) <= tolerance else 5.0 if abs(v - 5) <= tolerance else None

    def edges(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, before = (True, state.get[0]) if state.exists else (False, None)
        before = None if before is not None and before < 0 else before
        rows = sorted((int(i), v) for batch in batches for i, v in zip(batch[index], batch[voltage], strict=True))
        out = []
        for i, v in rows:
            now = level(v)
            if not seen or now is None or before is None or now != before:
                out.append((*key, i, round(i * (1 / fs), 4), now))
            seen, before = True, now
        if seen:
            state.update((-1.0 if before is None else before,))
        yield pd.DataFrame(out, columns=[*keys, index, "reference_time", "level"])

    return samples.groupBy(*keys).applyInPandasWithState(edges, schema, "level double", "append", GroupStateTimeout.NoTimeout)
