"""Event markers: edges, cleaning, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: All outcomes of cleaning a series.
STATUSES = ("cleaned", "deleted_empty", "deleted_too_few_rows", "missing_time_col", "deleted_invalid_time", "deleted_after_clean", "read_error")


def snap_level(voltage: Column, tolerance: float = 0.2) -> Column:
    """0 or 5 if the voltage is within the tolerance of it, else null."""
    return F.when(F.abs(voltage) <= tolerance, 0.0).when(F.abs(voltage - 5.0) <= tolerance, 5.0)


def edge_markers(samples: DataFrame, keys: list[str], *, index: str = "i", voltage: str = "v", fs: float = 500.0, tolerance: float = 0.2) -> DataFrame:
    """The first sample and every one whose level differs from the one before; out-of-band samples always count as different.

    Gives the keys, the index, reference_time (seconds, 4 digits) and level.
    """
    order = W.partitionBy(*keys).orderBy(index)
    level = snap_level(F.col(voltage), tolerance)
    out = samples.withColumn("level", level).withColumn("before", F.lag("level").over(order)).withColumn("row", F.row_number().over(order))
    changed = (F.col("row") == 1) | F.col("level").isNull() | F.col("before").isNull() | (F.col("level") != F.col("before"))
    return out.filter(changed).select(*keys, index, F.round(F.col(index) * (1 / fs), 4).alias("reference_time"), "level")


def clean_greedy(markers: DataFrame, keys: list[str], *, t: str = "t", min_interval: float = 1.0) -> DataFrame:
    """The keys and times of the markers that lie at least `min_interval` after the last one kept.

    Sorted series stream through a task; it jumps from each kept marker to the
    next one and holds no more than a batch and the last kept time, so a series
    may be as long and dense as it likes.  Equal times are kept once (if the
    interval is positive).
    """
    rows = markers.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias(t)).repartition(*keys).sortWithinPartitions(*keys, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(t).to_numpy()
            new = np.zeros(len(times), bool)
            new[0] = True
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            kept: list[int] = []
            for a, b in zip(starts, [*starts[1:], len(times)], strict=True):
                own = tuple(batch.column(k)[a].as_py() for k in keys)
                at = a
                if own != key:
                    key, last = own, times[a]
                    kept.append(a)
                    at = a + 1
                while at < b:
                    at = max(at, a + int(np.searchsorted(times[a:b], last + min_interval)))
                    while at > a and at - 1 > (kept[-1] if kept and kept[-1] >= a else a - 1) and times[at - 1] - last >= min_interval:
                        at -= 1
                    while at < b and times[at] - last < min_interval:
                        at += 1
                    if at < b:
                        kept.append(at)
                        last = times[at]
                        at += 1
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def clean_status(markers: DataFrame, keys: list[str], *, t: str = "t", min_rows: int = 2, min_interval: float = 1.0, remove_start: bool = False) -> DataFrame:
    """Per series the outcome of cleaning, and how many markers remain."""
    kept_first = F.col(t).isNotNull() & ((F.col(t) != 0) | F.lit(not remove_start))
    counts = markers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(t).alias("n_valid"), F.count(F.when(kept_first, 1)).alias("n_start"))
    cleaned = clean_greedy(markers.filter(kept_first), keys, t=t, min_interval=min_interval).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kept"))
    out = counts.join(cleaned, keys, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    status = (
        F.when(F.col("n_rows") == 0, "deleted_empty")
        .when(F.col("n_rows") < min_rows, "deleted_too_few_rows")
        .when(F.col("n_valid") < min_rows, "deleted_invalid_time")
        .when(F.col("n_start") < min_rows, "deleted_invalid_time")
        .when(F.col("n_kept") < min_rows, "deleted_after_clean")
        .otherwise("cleaned")
    )
    return out.select(*keys, status.alias("status"), "n_rows", F.when(status == "cleaned", F.col("n_kept")).otherwise(0).cast("long").alias("n_kept"))


def status_histogram(statuses: DataFrame) -> DataFrame:
    """Every possible outcome with its number of series."""
    spark = statuses.sparkSession
    domain = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return domain.join(statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def marker_metrics(markers: DataFrame, keys: list[str], *, t: str = "t", value: str | None = None) -> DataFrame:
    """Per series: n_markers, start, end and duration (6 digits) of the rows with a time and a value."""
    rows = markers.filter(F.col(t).isNotNull() & (F.lit(True) if value is None else F.col(value).isNotNull()))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_markers"), F.round(F.min(t), 6).alias("start_time"), F.round(F.max(t), 6).alias("end_time"), F.round(F.max(t) - F.min(t), 6).alias("duration"))


def vmrk_markers(lines: DataFrame, *, line: str = "line", interval_us: str = "interval_us") -> DataFrame:
    """Markers of BrainVision lines `Mk<n>=type,description,position,...`, but the first: adds reference_time and value."""
    parts = F.split(F.regexp_extract(F.col(line), r"^Mk\d+=(.*)$", 1), ",")
    position = F.trim(F.get(parts, 2)).try_cast("long")
    rows = lines.filter(F.col(line).rlike(r"^Mk\d+=") & ~F.col(line).startswith("Mk1=")).filter((F.size(parts) >= 3) & position.isNotNull())
    return rows.withColumn("reference_time", F.round((position - 1) * F.col(interval_us) / 1e6, 6)).withColumn("value", F.trim(F.get(parts, 1)))


def stim_from_marks(rows: DataFrame, *, t: str = "t", mark: str = "mark", ignore: tuple[str, ...] = ("", "0", "0Z")) -> DataFrame:
    """Adds the stimulus name, duration and amplitude of rows that carry a mark."""
    value = F.trim(F.col(mark))
    return rows.filter(~value.isin(*ignore)).withColumn("stim", F.concat(F.lit("Mark_"), value)).withColumn("duration", F.lit(0.0)).withColumn("amplitude", F.lit(1.0))


def aux_numeric(rows: DataFrame, keys: list[str], *, value: str = "count") -> DataFrame:
    """Adds `x`, the value as a number (blank: null); a series with any other text is dropped as a whole."""
    text = F.trim(F.col(value))
    number = text.try_cast("double")
    fine = F.min(((text == "") | number.isNotNull()).cast("int")).over(W.partitionBy(*keys))
    return rows.withColumn("x", number).withColumn("fine", fine).filter("fine = 1").drop("fine")


def annotations_inside(annotations: DataFrame, *, onset: str = "onset", sfreq: str = "sfreq", n_times: str = "n_times") -> DataFrame:
    """Annotations whose sample (half-even rounding) lies in the recording."""
    at = F.bround(F.col(onset) * F.col(sfreq), 0)
    return annotations.filter((at >= 0) & (at < F.col(n_times)))
