"""Devices of a recording: their files, durations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.functions.times import fixed

#: Folder and ending of converted files by device type.
CONVERTED = {"ecg": ("ECG", "_ecg.csv"), "eeg": ("EEG", ".vhdr"), "fnirs": ("fnirs", ".snirf")}
#: Letters at the start of a name by which it is looked up inside file names.
GRAM = 8


def softmax(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Adds `softmax` of x over the rows of a key, taken from the greatest value."""
    every = W.partitionBy(*keys)
    out = rows.withColumn("_e", F.exp(F.col(x) - F.max(x).over(every)))
    return out.withColumn("softmax", F.col("_e") / F.sum("_e").over(every)).drop("_e")


def device_info(markers: DataFrame, keys: list[str], *, t: str = "t") -> DataFrame:
    """Per device n_events and time_range (null without events)."""
    return markers.groupBy(*keys).agg(F.count(t).alias("n_events"), F.when(F.count(t) > 0, F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).alias("time_range"))


def confidence_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair of devices the number of matches, and least, greatest, mean and deviation of their confidence."""
    c = "confidence"
    return matches.groupBy(*keys).agg(F.count(c).alias("n_matches"), F.avg(c).alias("mean_confidence"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"))


def search_name(name: Column, kind: Column) -> Column:
    """The stem under which a device's converted file is looked for: `_ecg` in place of `_input`."""
    return F.when((kind == "ecg") & F.lower(name).contains("_input"), F.replace(name, F.lit("_input"), F.lit("_ecg"))).otherwise(name)


def _held_names(names: DataFrame, files: DataFrame) -> DataFrame:
    """The stretches of files (folder, path, file, whole: only from the start) that can be a name (folder, search): folder, search, path.

    Names are indexed by their first letters with the lengths that occur; of a file only places that begin like a name are cut, to these lengths.  All names are among the stretches, so an equality join finds every file that holds a name.
    """
    known = names.filter("search IS NOT NULL AND folder IS NOT NULL").select("folder", "search", F.length("search").alias("n")).withColumn("w", F.least("n", F.lit(GRAM)))
    index = known.groupBy("folder", "w", F.substr("search", F.lit(1), F.col("w")).alias("gram")).agg(F.collect_set("n").alias("lengths"))
    widths = known.groupBy("folder").agg(F.collect_set("w").alias("widths"))
    last = F.when(F.col("whole") | (F.col("w") == 0), 1).otherwise(F.col("m") - F.col("w") + 1)
    places = files.withColumn("m", F.length("file")).join(F.broadcast(widths), "folder").withColumn("w", F.explode("widths")).filter("w <= m").withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    cut = places.withColumn("gram", F.substr("file", F.col("at"), F.col("w"))).join(index, ["folder", "w", "gram"]).withColumn("n", F.explode("lengths")).filter("at + n - 1 <= m")
    return cut.select("folder", F.substr("file", F.col("at"), F.col("n")).alias("search"), "path")


def converted_files(devices: DataFrame, files: DataFrame, *, root: str = "Data/convert") -> DataFrame:
    """Per device (name, kind) the path of its converted file: the exact stem first, then a name that holds it, else the path that it would have.

    files: path of what is there.  Names meet files by equality of stems and stretches; of several fuzzy matches the first path is taken.  Null for other kinds.
    """
    folder = F.create_map(*(F.lit(x) for k, (f, _) in CONVERTED.items() for x in (k, f)))
    ending = F.create_map(*(F.lit(x) for f, e in CONVERTED.values() for x in (f, e)))
    name, file, end, ecg = F.col("search"), F.col("file"), F.col("end"), F.col("folder") == CONVERTED["ecg"][0]
    asked = devices.withColumn("search", search_name(F.col("name"), F.col("kind"))).withColumn("folder", F.try_element_at(folder, F.col("kind"))).withColumn("end", F.try_element_at(ending, F.col("folder")))
    there = files.select("path", F.regexp_extract("path", rf"^{root}/([^/]+)/", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).withColumn("end", F.try_element_at(ending, F.col("folder"))).filter("end IS NOT NULL")
    stem = lambda tail: F.when(file.endswith(tail), F.substr(file, F.lit(1), F.length(file) - F.length(tail)))
    exact = there.select("folder", "path", F.explode(F.array_compact(F.array(stem(end), F.when(ecg, stem(F.lit(".csv")))))).alias("search"), F.lit(1).alias("rank"))
    fuzzy = _held_names(asked, there.filter(file.endswith(end)).select("folder", "path", "file", ecg.alias("whole"))).withColumn("rank", F.lit(2))
    found = exact.unionByName(fuzzy).groupBy("folder", "search").agg(F.min(F.struct("rank", "path")).alias("best")).select("folder", "search", F.col("best.path").alias("found"))
    built = F.concat(F.lit(f"{root}/"), "folder", F.lit("/"), name, F.when((F.col("kind") == "ecg") & name.endswith("_ecg"), F.lit("_ecg.csv")).otherwise(end))
    return asked.join(found, ["folder", "search"], "left").select("name", "kind", F.coalesce("found", built).alias("path"), F.col("found").isNotNull().alias("exists"))


def raw_durations(devices: DataFrame, files: DataFrame, *, ecg_rate: float = 250.0) -> DataFrame:
    """Per device (name, kind) the duration of its converted recording: samples by rate for EEG, last time for fNIRS, rows by 250 for ECG; null if the file or its figures are missing.

    files: stem, kind, n_rows, sfreq, last_time.  Stems are compared without case, `_input` as `_ecg`.
    """
    name = F.lower("name")
    ecg = F.when(name.endswith("_input"), F.concat(F.regexp_replace(name, "_input$", ""), F.lit("_ecg"))).when(~name.endswith("_ecg"), F.concat(name, F.lit("_ecg"))).otherwise(name)
    asked = devices.withColumn("key", F.when(F.lower("kind") == "ecg", ecg).otherwise(name)).withColumn("of", F.lower("kind"))
    seconds = F.when(F.col("kind") == "eeg", F.col("n_rows") / F.col("sfreq")).when(F.col("kind") == "fnirs", F.col("last_time")).when(F.col("kind") == "ecg", F.col("n_rows") / F.lit(ecg_rate))
    known = files.select(F.lower("stem").alias("key"), F.col("kind").alias("of"), seconds.alias("duration")).groupBy("key", "of").agg(F.min("duration").alias("duration"))
    return asked.join(known, ["key", "of"], "left").select("name", "kind", "duration")


def duration_for_marker(candidates: DataFrame, keys: list[str], *, priority: str = "priority") -> DataFrame:
    """Per marker the first data file, by priority, that has a duration: path and duration."""
    return candidates.filter("duration IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct("path", "duration"), priority).alias("first")).select(*keys, "first.*")


def match_plots(timeline: DataFrame, keys: list[str], *, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """What the match plots show: per device and bin of the weights (0 to 1) the number of matched events, and per device the number of events."""
    given = timeline.filter("t IS NOT NULL")
    nth = F.least(F.floor(F.col("weight") * bins) + 1, F.lit(bins)).cast("long")
    return given.groupBy(*keys, "device", nth.alias("bin")).agg(F.count(F.lit(1)).alias("n")), given.groupBy(*keys, "device").agg(F.count("t").alias("n_matched"))


def crop_summary(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the readable report of a crop; crops: device, reference, lo, hi, new_lo, new_hi, offset (the reference keeps its range).  Null if one of its numbers is missing."""
    number = lambda c: fixed(F.col(c), 3)
    line = F.when(F.col("device") == F.col("reference"), F.concat(F.lit("  "), "device", F.lit(": KEEP"))).otherwise(
        F.concat(F.lit("  "), "device", F.lit(": CROP\n    Original: "), number("lo"), F.lit(" - "), number("hi"), F.lit("s\n    Cropped:  "), number("new_lo"), F.lit(" - "), number("new_hi"), F.lit("s\n    Offset:   "), fixed(F.col("offset"), 3, "+"), F.lit("s"))
    )
    own = F.col("device") == F.col("reference")
    out = crops.withColumn("line", line).groupBy(*keys, "reference").agg(F.max(F.when(own, F.col("lo"))).alias("a"), F.max(F.when(own, F.col("hi"))).alias("b"), F.array_sort(F.collect_list(F.struct("device", "line"))).alias("lines"))
    out = out.withColumn("span", F.col("b") - F.col("a"))
    rule = "=" * 60
    head = F.concat(F.lit(f"{rule}\nTIMELINE CROPPING SUMMARY\n{rule}\nReference (shortest): "), "reference", F.lit("\n  Range: "), number("a"), F.lit(" - "), number("b"), F.lit("s\n  Duration: "), number("span"), F.lit("s\n\nDevices processed:\n"))
    whole = F.when(~F.exists("lines", lambda x: x["line"].isNull()), F.concat_ws("\n", F.transform("lines", lambda x: x["line"])))
    return out.select(*keys, F.concat(head, whole).alias("summary"))


def export_format(name: Column) -> Column:
    """Struct of the writer and extension of an EEG export format; null for others."""
    pairs = {"BrainVision": ("brainvision", ".vhdr"), "EEGLAB": ("eeglab", ".set"), "EDF": ("edf", ".edf")}
    out = F.lit(None).cast("struct<writer:string,ext:string>")
    for key, (writer, ext) in pairs.items():
        out = F.when(name == key, F.struct(F.lit(writer).alias("writer"), F.lit(ext).alias("ext"))).otherwise(out)
    return out
