"""Sinks: SNIRF tables, ECG CSV by channel group, timelines, reports.

An HDF5 container needs a library that is optional; the tables below are its
content one to one and are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.functions.naming import channel_group, processed_label
from tempoweave.operators.markers import aux_numeric, stim_from_marks
from tempoweave.sources.text_scans import fnirs_body, fnirs_headers, measurements_per_channel


def snirf_tables(texts: DataFrame, sources: DataFrame | None = None, detectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a SNIRF container for every export: meta, channel, sample, stim, aux, source, detector.

    Exports whose pairs times measurements are not their columns have no channels.
    """
    head = fnirs_headers(texts)
    per = measurements_per_channel(F.col("signal_labels"))
    fits = F.size("channel_pairs") * per == F.size("signal_labels")
    meta = head.select("path", F.col("subject_id").alias("SubjectID"), F.col("date").alias("MeasurementDate"), F.col("time").alias("MeasurementTime"), F.lit("mm").alias("LengthUnit"), F.lit("s").alias("TimeUnit"), F.lit("Hz").alias("FrequencyUnit"))
    channel = head.withColumn("per", per).filter(fits).select("path", "per", "channel_pairs", F.posexplode("signal_labels").alias("k", "label"))
    pair = F.get("channel_pairs", F.floor(F.col("k") / F.col("per")).cast("int"))
    channel = channel.select("path", (F.col("k") + 1).alias("measurement"), pair["source"].alias("sourceIndex"), pair["detector"].alias("detectorIndex"), F.lit(1).alias("wavelengthIndex"), F.lit(99999).alias("dataType"), processed_label(F.col("label")).alias("dataTypeLabel"))
    body = fnirs_body(texts)
    sample = body.select("path", "row", "t", F.posexplode("signals").alias("k", "x")).select("path", (F.col("k") + 1).alias("measurement"), "row", "t", "x")
    stim = stim_from_marks(body).select("path", F.col("stim").alias("name"), F.col("t").alias("onset"), "duration", F.col("amplitude").alias("value"))
    aux = aux_numeric(body, ["path"]).select("path", F.lit("COUNT").alias("name"), "t", "x")
    out = {"meta": meta, "channel": channel, "sample": sample, "stim": stim, "aux": aux}
    if sources is not None:
        out["source"] = sources
    if detectors is not None:
        out["detector"] = detectors
    return out


def without_total(tables: dict[str, DataFrame], name: str = "HbT") -> dict[str, DataFrame]:
    """Moves total haemoglobin to the auxiliary series and numbers the other channels anew."""
    total = (F.col("dataType") == 99999) & F.lower("dataTypeLabel").isin("hbt")
    channel = tables["channel"]
    nth = F.row_number().over(W.partitionBy("path").orderBy("measurement"))
    kept = channel.filter(~total).withColumn("new", nth)
    gone = channel.filter(total).withColumn("new", nth).select("path", "measurement", F.concat(F.lit(name), F.lit("_"), F.col("new").cast("string")).alias("name"))
    aux = tables["sample"].join(gone, ["path", "measurement"]).select("path", "name", "t", "x")
    sample = tables["sample"].join(kept.select("path", "measurement", "new"), ["path", "measurement"]).select("path", F.col("new").alias("measurement"), "row", "t", "x")
    return tables | {"channel": kept.withColumn("measurement", F.col("new")).drop("new"), "sample": sample, "aux": tables["aux"].unionByName(aux)}


def wavelengths(given: Column, dummies: tuple[float, float] = (760.0, 850.0)) -> Column:
    """At least two wavelengths."""
    return F.when(F.size(given) >= 2, given).otherwise(F.array(*(F.lit(w) for w in dummies)))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def ecg_rows(samples: DataFrame, digits: int = 6) -> DataFrame:
    """Channel samples with their group and the value as fixed-point text. samples: channel, sample_idx, x."""
    return samples.select(channel_group(F.col("channel")).alias("group"), "channel", "sample_idx", F.format_string(f"%.{digits}f", "x").alias("x"))


def group_file(base: Column, group: Column) -> Column:
    """File name of a group: the base for ECG, the base without its ecg ending for inputs, else base and group."""
    bare = F.regexp_replace(base, r"(?i)(_ecg|ecg)$", "")
    return F.when(group == "ecg", F.concat(base, F.lit(".csv"))).when(group == "input", F.concat(bare, F.lit("_input.csv"))).otherwise(F.concat(base, F.lit("_"), group, F.lit(".csv")))


def write_ecg(samples: DataFrame, folder: str, base: str) -> None:
    """One folder of CSV files per channel group, columns by channel."""
    rows = ecg_rows(samples)
    for group in [r["group"] for r in rows.select("group").distinct().collect()]:
        wide = rows.filter(F.col("group") == group).groupBy("sample_idx").pivot("channel").agg(F.first("x")).orderBy("sample_idx").drop("sample_idx")
        name = rows.sparkSession.range(1).select(group_file(F.lit(base), F.lit(group))).first()[0]
        wide.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def updated_metadata(meta: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata rows (keys, name, value) with those of `new` in place of older ones."""
    return meta.join(new.select(*keys, "name"), [*keys, "name"], "left_anti").unionByName(new)
