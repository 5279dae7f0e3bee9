"""Whole jobs over folders of files: one plan for all recordings each.

Tables of converted recordings live in a folder of Parquet tables (see
sources.sinks); marker series in folders of CSV; results are written next to
them.  A file that cannot be read is a row of status, not a failed job.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweave.functions.naming import bids_name, channel_group, channel_name, with_task
from tempoweave.operators import crop, inventory, markers, matching, quality, report, spectral
from tempoweave.sources import sinks, text_scans

#: Metrics of a run's summary.
SIGNAL_METRICS = ["cv", "tsnr", "rdi", "drift", "spectral_entropy", "mayer_ratio", "resp_ratio", "hbo_hbr_corr", "hbo_hbr_var_ratio", "hbo_hbr_deriv_corr"]


# ---------------------------------------------------------------- conversion


def convert_fnirs(spark: SparkSession, texts: str, out: str, sources: str | None = None, detectors: str | None = None, *, patch: bool = True) -> dict[str, DataFrame]:
    """fNIRS exports to SNIRF tables; with patch, total haemoglobin goes to the auxiliary series."""
    positions = {}
    for name, path, prefix in (("source", sources, "T"), ("detector", detectors, "R")):
        if path:
            rows = spark.read.option("header", "true").csv(path).withColumn("path", F.lit(path)).withColumn("line_no", F.monotonically_increasing_id())
            positions[name] = text_scans.optodes(rows, prefix).select("num", "idx", *(F.col(c).try_cast("double").alias(c) for c in "XYZ"))
    tables = sinks.snirf_tables(text_scans.whole_texts(spark, texts), positions.get("source"), positions.get("detector"))
    tables = sinks.without_total(tables) if patch else tables
    sinks.write_tables(tables, out)
    return tables


def convert_ecg(samples: DataFrame, fs: float, out: str, base: str, *, target: float = 250.0) -> DataFrame:
    """Long samples (channel, sample_idx, x) resampled and written as CSV by channel group."""
    named = samples.withColumn("channel", F.trim("channel"))
    moved = quality.resample_linear(named, ["channel"], fs, target) if abs(fs - target) > 1e-9 else named
    sinks.write_ecg(moved, out, base)
    return moved.withColumn("group", channel_group(F.col("channel"))).withColumn("normalized_name", channel_name(F.col("channel")))


def convert_eeg(signals: DataFrame, keys: list[str], fs: float, *, target: float | None = None, tolerance: float = 0.1) -> DataFrame:
    """Channels resampled if the rates differ by more than the tolerance."""
    return signals if target is None or abs(fs - target) <= tolerance else spectral.fft_resample(signals, keys, fs, target, tolerance=tolerance, only_down=False)


# ---------------------------------------------------------------- markers


def extract_markers(spark: SparkSession, path: str, kind: str, *, fs: float = 500.0, tolerance: float = 0.2, header: str | None = None) -> DataFrame:
    """path, reference_time and value of marker files of a kind: biopac, brainvision (with the headers' path) or fnirs."""
    texts = text_scans.robust_texts(spark, path).filter("text IS NOT NULL").drop("encoding")
    if kind == "biopac":
        return markers.edge_markers(text_scans.trigger_samples(texts), ["path"], fs=fs, tolerance=tolerance).select("path", "reference_time", F.col("level").cast("string").alias("value"))
    if kind == "brainvision":
        headers = text_scans.robust_texts(spark, header or path.replace(".vmrk", ".vhdr")).drop("encoding")
        return markers.vmrk_markers(text_scans.vmrk_lines(texts, headers)).select("path", "reference_time", "value")
    if kind == "fnirs":
        return text_scans.protocol_markers(texts).select("path", "reference_time", "value")
    raise ValueError(f"unknown marker kind {kind}")


def marker_series(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """subject, device, t of marker CSV files: the device is the file name without `_marker.csv`."""
    rows = text_scans.marker_rows(text_scans.whole_texts(spark, paths))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_marker)?\.csv$", "")
    return rows.filter("t IS NOT NULL").select(F.lit(0).cast("long").alias("subject"), name.alias("device"), "t")


def clean_markers(spark: SparkSession, folder: str, out: str, *, min_rows: int = 2, min_interval: float = 1.0, remove_start: bool = False) -> DataFrame:
    """Cleans every marker CSV below a folder into `out`, with all its columns, under its path below the folder (partition column `file`); gives path, status and counts."""
    every = text_scans.robust_texts(spark, folder).filter(~F.col("path").contains("/._"))
    texts = every.filter("text IS NOT NULL").drop("encoding")
    rows = text_scans.marker_rows(texts, text_scans.CLEANING_TIME)
    missing = rows.filter("status IS NOT NULL").groupBy("path").agg(F.lit("missing_time_col").alias("status"), F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("long").alias("n_kept"))
    timed = rows.filter("status IS NULL").select("path", "row", "t")
    status = markers.clean_status(timed.select("path", "t"), ["path"], min_rows=min_rows, min_interval=min_interval, remove_start=remove_start)
    kept = markers.clean_greedy(timed.filter((F.col("t") != 0) | F.lit(not remove_start)), ["path"], min_interval=min_interval)
    fine = kept.join(status.filter("status = 'cleaned'").select("path"), "path", "left_semi")
    first = timed.groupBy("path", "t").agg(F.min("row").alias("row")).join(fine, ["path", "t"]).select("path", (F.col("row") + 1).alias("line_no"))
    lines = text_scans.lines_of(texts)
    whole = lines.join(first, ["path", "line_no"]).unionByName(lines.filter("line_no = 0").join(fine.select("path").distinct(), "path", "left_semi"))
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(re.sub("^[a-z]+:/+", "/", folder).rstrip("/")) + "/", "")
    whole.withColumn("file", below).repartition("file").sortWithinPartitions("file", "line_no").select("file", F.regexp_replace("line", "\r$", "").alias("value")).write.mode("overwrite").partitionBy("file").text(out)
    unread = every.filter("text IS NULL").select("path", F.lit("read_error").alias("status"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_kept"))
    empty = texts.join(rows.select("path").distinct(), "path", "left_anti").select("path", F.lit("deleted_empty").alias("status"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_kept"))
    return status.unionByName(missing).unionByName(unread).unionByName(empty)


def marker_inventory(spark: SparkSession, data: str, marks: str, out: str | None = None) -> DataFrame:
    """The inventory report of a data folder and a marker folder, written by subject."""
    files = inventory.with_names(text_scans.scan_folder(spark, data).select("path").withColumn("duration", F.lit(None).cast("double")))
    texts = text_scans.whole_texts(spark, marks).filter(F.col("path").endswith(".csv") & ~F.col("path").contains("/info/"))
    metrics = markers.marker_metrics(text_scans.marker_rows(texts), ["path"]).select("path", "n_markers", "duration")
    rows = inventory.inventory_report(files, inventory.with_names(texts.select("path")), metrics)
    if out:
        rows.write.mode("overwrite").partitionBy("subject_id").option("header", "true").csv(out)
    return rows


# ---------------------------------------------------------------- matching


def match_devices(series: DataFrame, devices: list[str], out: str | None = None, *, method: str = "hungarian", max_time_diff: float = 3.0, sigma: float = 0.75, drift: str | None = "theil_sen", convention: str = "reference") -> tuple[DataFrame, DataFrame]:
    """The consensus timeline of devices in order (wide), and its metadata; both written if `out` is given. At least two devices are needed."""
    if len(devices) < 2:
        raise ValueError("at least two devices are needed")
    timeline = matching.consensus_timeline(series, ["subject"], devices, method=method, sigma=sigma, band=max_time_diff, drift=drift, convention=convention)
    wide, meta = matching.wide_timeline(timeline, ["subject"], devices), matching.timeline_metadata(timeline, ["subject"])
    if out:
        wide.write.mode("overwrite").option("header", "true").csv(f"{out}/timeline")
        meta.write.mode("overwrite").json(f"{out}/metadata")
    return wide, meta


def match_by_filename(spark: SparkSession, folder: str, name: str, out: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The timeline of all devices (folders below `folder`) that have a marker file of a name; at least two are needed."""
    texts = text_scans.robust_texts(spark, folder).filter(F.col("path").endswith("_marker.csv")).filter("text IS NOT NULL").drop("encoding")
    rows = text_scans.marker_rows(texts).filter("t IS NOT NULL")
    chosen = inventory.first_marker_files(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows")), name)
    series = rows.join(chosen, "path").select(F.lit(0).cast("long").alias("subject"), "device", "t")
    devices = sorted(r["device"] for r in chosen.select("device").distinct().collect())  # folders of one recording
    return match_devices(series, devices, out, **options)


def rematch_with_offsets(series: DataFrame, drifts: DataFrame, changes: DataFrame, devices: list[str], *, add: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """The timeline after changing offsets by hand (drifts: device, offset, scale, method; changes: device, change), and the report of what changed."""
    after = crop.adjusted_offsets(drifts, changes, ["device"], add=add)
    moved = series.join(after, "device").withColumn("t", (F.col("t") - F.col("offset")) / F.col("scale")).select("subject", "device", "t")
    return match_devices(moved, devices, drift=None, **options)[0], crop.offset_report(drifts, after, ["device"])


def crop_recordings(samples: DataFrame, kind: str, start: float, end: float, offsets: DataFrame, *, task: str | None = None) -> DataFrame:
    """Samples (file_name, i, t, x) of one modality cropped to a consensus range by its rule, each file with its offset; the task in the name changed if given."""
    if not start < end:
        raise ValueError("the range is empty")
    rows = samples.join(offsets.select("file_name", "offset", *(["sfreq"] if kind == "eeg" else [])), "file_name", "left").withColumn("offset", F.coalesce("offset", F.lit(0.0))).withColumn("start", F.lit(start)).withColumn("end", F.lit(end))
    work = {"ecg": crop.crop_closed, "eeg": crop.crop_by_index, "fnirs": crop.crop_half_open}.get(kind)
    if work is None:
        raise ValueError(f"unknown kind {kind}")
    out = work(rows, ["file_name"]).drop("start", "end", "offset", "sfreq")
    return out.withColumn("file_name", with_task(F.col("file_name"), task)) if task else out


def crop_with_metadata(samples: DataFrame, kind: str, meta: DataFrame, *, reference: str | None = None, task: str | None = None) -> DataFrame:
    """Samples (subject, device, file_name, i, t, x, for EEG sfreq) cropped by what matching wrote: the consensus range, and each device's own offset.

    Subjects without metadata or with an empty range have no rows; the reference device's samples stay as they are.
    """
    work = {"ecg": crop.crop_closed, "eeg": crop.crop_by_index, "fnirs": crop.crop_half_open}.get(kind)
    if work is None:
        raise ValueError(f"unknown kind {kind}")
    own = F.try_element_at("drift_by_device", F.col("device"))
    ranges = meta.filter("lo < hi").select("subject", F.col("lo").alias("start"), F.col("hi").alias("end"), "drift_by_device")
    rows = samples.join(ranges, "subject").withColumn("offset", F.coalesce(own["offset"], F.lit(0.0))).drop("drift_by_device")
    kept = rows.filter(F.col("device") == reference) if reference else rows.limit(0)
    cut = work(rows.filter(F.col("device") != reference) if reference else rows, ["subject", "device", "file_name"])
    out = cut.drop("start", "end", "offset", "sfreq").unionByName(kept.drop("start", "end", "offset", "sfreq"), allowMissingColumns=True)
    return out.withColumn("file_name", with_task(F.col("file_name"), task)) if task else out


# ---------------------------------------------------------------- quality


def table_signals(tables: dict[str, DataFrame]) -> DataFrame:
    """Haemoglobin channels of SNIRF tables as signals."""
    kind = F.lower("dataTypeLabel")
    base = F.format_string("S%d_D%d", "sourceIndex", "detectorIndex")
    named = tables["channel"].filter(kind.isin("hbo", "hbr")).select("path", "measurement", kind.alias("ch_type"), base.alias("pair_base"), F.concat(base, F.lit(" "), kind).alias("channel"))
    return tables["sample"].join(named, ["path", "measurement"]).select(F.col("path").alias("recording"), "channel", "ch_type", "pair_base", F.col("row").alias("sample_idx"), "t", "x")


def assess(signals: DataFrame, fs: float, *, low: float = 0.01, high: float = 0.2, target: float = 4.0, repair: bool = True) -> dict[str, DataFrame]:
    """Quality before and after filtering: pre, post (channels with their noise ratios), comprehensive, pairs, runs, resting, overall."""
    names = signals.select("recording", "channel", "ch_type", "pair_base").distinct()
    keys = ["recording", "channel"]
    rated = signals.select(*keys, "sample_idx", "x")
    if target and fs > target:
        rated, fs = spectral.fft_resample(rated, keys, fs, target), target
    raw = rated.join(names, keys)
    cleaned = spectral.smart_filter(rated, keys, fs, low, high)
    cleaned = (spectral.motion_repair(cleaned, keys, fs) if repair else cleaned).join(names, keys)
    noted = lambda s: quality.basic_assessment(s).join(spectral.signal_to_noise(s, keys, fs), keys, "left")
    full = quality.comprehensive_assessment(raw, fs, spectral.spectral_metrics(raw, keys, fs))
    pairs = quality.composite_scores(full)
    bad = full.filter("bad_final").select(*keys)
    pre, post = noted(raw), noted(cleaned)
    return {
        "pre": pre, "post": post, "comprehensive": full, "pairs": pairs, "runs": quality.run_summary(full, SIGNAL_METRICS).join(quality.run_scores(pairs), "recording", "left"),
        "resting": quality.resting_metrics(raw, bad), "overall": quality.channel_scores(post, pre), "best": quality.best_pairs(full),
    }


def plot_data(assessed: dict[str, DataFrame], signals: DataFrame) -> dict[str, DataFrame]:
    """What the quality plots show: heat map, histogram, and the regression of a pair's deviations."""
    full = assessed["comprehensive"]
    side = lambda c: F.stddev_pop(F.when((F.col("ch_type") == c) & ~F.isnan("x"), F.col("x")))
    pairs = signals.groupBy("recording", "pair_base").agg(side("hbo").alias("a"), side("hbr").alias("b"))
    return {"heatmap": report.heat_map(full.select("recording", "channel"), full), "histogram": report.histogram(full, ["recording"], "tsnr"), "regression": report.regression(pairs, ["recording"], "a", "b")}


def write_all(tables: dict[str, DataFrame], out: str) -> None:
    for name, table in tables.items():
        report.rounded(table).write.mode("overwrite").parquet(f"{out}/{name}")


def bids_renames(files: DataFrame) -> DataFrame:
    """old path, folder and new name of files with legacy names; names that collide in a folder are numbered. files: path."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    out = files.select(F.col("path").alias("old_name"), F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), bids_name(name, F.when(F.size(parts) > 1, F.element_at(parts, -2))).alias("base"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"))
    return inventory.without_collisions(out.filter("base IS NOT NULL").select("old_name", "folder", F.concat("base", "ext").alias("new_name")), folder="folder")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


