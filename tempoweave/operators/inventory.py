"""Which data file belongs to which marker file, and reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.functions.naming import device_from_path, join_key, parsed_name


def with_names(files: DataFrame, *, path: str = "path") -> DataFrame:
    """Adds what name and path say of each file."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    out = files.withColumn("file_name", name).withColumn("parsed", parsed_name(name)).withColumn("device", device_from_path(F.col(path)))
    return out.withColumn("subject_id", F.col("parsed.subject_id")).withColumn("sequence_id", F.col("parsed.sequence_id")).withColumn("key", join_key(name)).drop("parsed")


def match_markers(data: DataFrame, markers: DataFrame) -> DataFrame:
    """Each data file with its marker file, if exactly one has the same key; n_candidates says how many there were."""
    per_key = markers.groupBy("key").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("path").alias("only"))
    out = data.join(per_key, "key", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out.withColumn("marker_path", F.when(F.col("n_candidates") == 1, F.col("only"))).drop("only")


def orphan_markers(data: DataFrame, markers: DataFrame) -> DataFrame:
    """Marker files that no data file is matched with."""
    used = match_markers(data, markers).filter("marker_path IS NOT NULL").select(F.col("marker_path").alias("path")).distinct()
    return markers.join(used, "path", "left_anti")


def inventory_report(data: DataFrame, markers: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per data file and per orphan marker file: file_name, device, subject_id, sequence_id, n_markers, sequence_duration.

    data: path, file_name, device, subject_id, sequence_id, key, duration; markers: the same without duration; metrics: path, n_markers, duration.
    """
    matched = match_markers(data, markers).join(metrics.select(F.col("path").alias("marker_path"), "n_markers"), "marker_path", "left")
    rows = matched.select("file_name", "device", "subject_id", "sequence_id", "n_markers", "duration")
    alone = orphan_markers(data, markers).join(metrics, "path", "left").select("file_name", "device", "subject_id", "sequence_id", "n_markers", "duration")
    out = rows.unionByName(alone)
    return out.select("file_name", "device", F.coalesce("subject_id", F.lit("UNKNOWN")).alias("subject_id"), "sequence_id", F.coalesce("n_markers", F.lit(0)).alias("n_markers"), F.round("duration", 2).alias("sequence_duration"))


def first_by_priority(candidates: DataFrame, keys: list[str], *, priority: str = "priority") -> DataFrame:
    """Of each key the candidate that comes first."""
    return candidates.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(priority))).filter("nth = 1").drop("nth")


#: Where data of a marker file are looked for, in this order.
PLACES = ("convert/fnirs", "convert/ecg", "convert/eeg", "raw")


def data_files_for_markers(markers: DataFrame, files: DataFrame) -> DataFrame:
    """Per marker file (path) its data files of the same stem, without case and marker endings, in the order of PLACES, then by path: path, data_path, priority (from 1), each file once."""
    key = lambda c: join_key(F.element_at(F.split(F.col(c), "/"), -1))
    low, place = F.lower("data_path"), F.lit(None).cast("int")
    for k, folder in reversed(list(enumerate(PLACES))):
        place = F.when(low.contains(f"/{folder}/"), k).otherwise(place)
    there = files.select(F.col("path").alias("data_path")).distinct().withColumn("key", key("data_path")).withColumn("place", place).filter("place IS NOT NULL")
    both = markers.select("path").distinct().withColumn("key", key("path")).join(there, "key")
    nth = F.row_number().over(W.partitionBy("path").orderBy("place", "data_path"))
    return both.select("path", "data_path", nth.cast("long").alias("priority"))


#: Extensions of data files.
DATA_EXTENSIONS = (".snirf", ".txt", ".set", ".vhdr", ".edf", ".eeg", ".fdt", ".csv", ".acq")


def data_files(paths: DataFrame) -> DataFrame:
    """Data files by their extension (in any case) with what their names say; hidden files and folders and archive leftovers are skipped."""
    shown = ~F.col("path").rlike(r"(^|/)\.[^/]") & ~F.col("path").contains("__MACOSX")
    return with_names(paths.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*DATA_EXTENSIONS) & shown))


def first_marker_files(files: DataFrame, name: str | Column) -> DataFrame:
    """Per device folder the first marker file that is not empty and whose stem without `_marker` is the name, without case: device, path. files: path, n_rows."""
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    same = F.lower(F.regexp_replace(file, r"_marker\.csv$", "")) == F.lower(F.lit(name) if isinstance(name, str) else name)
    return files.filter(file.endswith("_marker.csv") & same & (F.col("n_rows") > 0)).withColumn("device", F.element_at(parts, -2)).groupBy("device").agg(F.min("path").alias("path"))


def with_fallback(cached: DataFrame, extracted: DataFrame, keys: list[str], *, force_reload: bool = False) -> DataFrame:
    """Rows that are there already, and extracted ones of the keys that have none; with force_reload extracted ones alone."""
    return extracted if force_reload else cached.unionByName(extracted.join(cached.select(*keys).distinct(), keys, "left_anti"))


def without_collisions(names: DataFrame, *, new: str = "new_name", old: str = "old_name", folder: str | None = None) -> DataFrame:
    """Renames whose targets collide (in a folder) get _1, _2 ... before their extension, in order of the old name."""
    nth = F.row_number().over(W.partitionBy(*([folder] if folder else []), new).orderBy(old)) - 1
    ext = F.regexp_extract(F.col(new), r"(\.[^./]*)$", 1)
    base = F.substring(F.col(new), F.lit(1), F.length(new) - F.length(ext))
    return names.withColumn("nth", nth).withColumn(new, F.when(F.col("nth") == 0, F.col(new)).otherwise(F.concat(base, F.lit("_"), F.col("nth").cast("string"), ext))).drop("nth")


def duration_of(files: DataFrame) -> DataFrame:
    """Adds `duration` in seconds by format: last time of SNIRF and EEG files, rows / 250 of CSV files (estimated from sizes above 100 MB), size / 12 / 500 of ACQ files, Time Range, Total Points / 10 or lines / 10 of text files."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = F.when(F.col("size") > 100_000_000, F.floor(F.col("size") / F.col("line_bytes"))).otherwise(F.col("n_rows"))
    return files.withColumn(
        "duration",
        F.when(ext.isin(".snirf", ".set", ".vhdr", ".edf"), F.coalesce(F.col("last_time"), F.col("n_rows") / 10.0))
        .when(ext == ".csv", rows / 250.0)
        .when(ext == ".acq", F.col("size") / 12.0 / 500.0)
        .when(ext == ".txt", F.coalesce(F.col("last_time"), F.col("total_points") / 10.0, F.col("n_rows") / 10.0)),
    )
