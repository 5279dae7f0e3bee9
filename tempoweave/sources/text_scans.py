"""Text formats: fNIRS exports, optode positions, BrainVision headers and markers, protocol and marker CSV, JSON metadata, folders.

Every scan takes paths (or a DataFrame of path and whole text) and handles all
files in one plan; a file's errors are rows or nulls, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave import schemas
from tempoweave.functions.naming import device_from_path, input_format, stem
from tempoweave.operators.inventory import DATA_EXTENSIONS
from tempoweave.functions.times import hms_seconds, iso_date, iso_time

#: Names of the time column, in the order in which they are looked for.
MATCHING_TIME = ("reference_time", "Time(sec)", "time", "Time")
CLEANING_TIME = ("Time(sec)", "reference_time", "time", "Time")



def whole_texts(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """path and text of each file; without a byte order mark."""
    if encoding:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        text = F.decode("content", encoding)
        return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


#: Encodings of CSV files, in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "gbk", "gb2312", "latin1")


def decoded(files: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """path, text and encoding of files (path, content) by the first encoding that fits; null if none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("content").to_pylist():
                text, used = None, None
                for name in encodings:
                    try:
                        text, used = (raw or b"").decode(name), name
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append((text, used))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([t for t, _ in rows], pa.string()), pa.array([u for _, u in rows], pa.string())], names=["path", "text", "encoding"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def robust_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text and encoding of each file, whatever its encoding."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths))


def quality_details(detail: DataFrame, comprehensive: DataFrame | None = None) -> DataFrame:
    """Rows of the detail table after filtering, with the columns of the comprehensive one beside them where it is given."""
    if comprehensive is None:
        return detail
    more = [c for c in comprehensive.columns if c not in detail.columns]
    return detail.join(comprehensive.select("recording", "channel", *more), ["recording", "channel"], "left")


def lines_of(texts: DataFrame) -> DataFrame:
    """path, line_no (from 0) and line."""
    return texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def _tab_value(lines: Column, start: str) -> Column:
    """The second tab-separated part of the last line that starts so, or the empty text."""
    found = F.filter(lines, lambda x: x.startswith(start) & (F.size(F.split(x, "\t+")) >= 2))
    return F.when(F.size(found) > 0, F.trim(F.get(F.split(F.element_at(found, -1), "\t+"), 1))).otherwise("")


def fnirs_headers(texts: DataFrame) -> DataFrame:
    """Per export: data_start (line number of the first row), subject_id, date, time, data_type, time_range, total_points, channel_pairs, signal_labels; data_start null if there is no table."""
    lines = texts.select("path", "text", F.split("text", "\r?\n").alias("lines"))
    header = F.array_position(F.transform("lines", lambda x: x.startswith("Time(sec)")), True)
    given = F.nullif(F.regexp_extract(F.get("lines", 0), r"\[Data Line\]\s*(\d+)", 1), F.lit("")).try_cast("int")
    out = lines.withColumn("header_no", F.when(header > 0, header - 1)).withColumn("data_start", F.coalesce(F.when(given.isNotNull(), F.greatest(given - 1, F.lit(0))), F.col("header_no") + 1))
    ident, name = _tab_value(F.col("lines"), "ID"), _tab_value(F.col("lines"), "Name")
    subject = F.coalesce(F.nullif(F.when(F.length(ident) >= F.length(name), ident).otherwise(name), F.lit("")), F.lit("unknown"))
    info = F.regexp_extract("text", r"(?s)\[Text Info\.\](.*?)Time\(sec\)", 1)
    pairs = F.transform(F.arrays_zip(F.regexp_extract_all(info, F.lit(r"\((\d+),(\d+)\)"), F.lit(1)).alias("s"), F.regexp_extract_all(info, F.lit(r"\((\d+),(\d+)\)"), F.lit(2)).alias("d")), lambda p: F.struct(p["s"].cast("int").alias("source"), p["d"].cast("int").alias("detector")))
    measured = _tab_value(F.col("lines"), "Measured Date")
    clock = F.regexp_extract(measured, r"(\d{1,2}:\d{1,2}:\d{1,2}\S*)", 1)
    columns = F.split(F.get("lines", F.col("header_no").cast("int")), "\t")
    labels = F.when(F.size(columns) >= 5, F.transform(F.slice(columns, 5, F.greatest(F.size(columns), F.lit(1))), lambda x: F.trim(x)))
    points = F.regexp_extract("text", r"Total Points\s+(\d+)", 1)
    span = lambda k: F.regexp_extract("text", r"Time Range\s+([0-9.]+)\s+([0-9.]+)", k).try_cast("double")
    return out.select(
        "path", "data_start", subject.alias("subject_id"), iso_date(measured).alias("date"), iso_time(clock).alias("time"),
        F.nullif(F.regexp_extract("text", r"Output Mode[^\n]*Data Type\s+(\w+)", 1), F.lit("")).alias("data_type"), F.array(span(1), span(2)).alias("time_range"), points.try_cast("long").alias("total_points"), pairs.alias("channel_pairs"), labels.alias("signal_labels"),
    )


def fnirs_body(texts: DataFrame) -> DataFrame:
    """Rows of the table: path, row, t, task, mark, count, signals (as many as labels: short rows filled with null, long ones cut); rows without a time are left out."""
    head = fnirs_headers(texts).select("path", "data_start", F.size("signal_labels").alias("n_signals"))
    rows = lines_of(texts).join(head, "path").filter("line_no >= data_start").withColumn("parts", F.split("line", "\t"))
    t = F.trim(F.get("parts", 0)).try_cast("double")
    number = lambda i: F.trim(F.get(F.col("parts"), (i + 4).cast("int"))).try_cast("double")
    signals = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_signals") - 1, F.lit(0))), number)
    text = lambda i: F.trim(F.coalesce(F.get("parts", i), F.lit("")))
    rows = rows.withColumn("t", t).filter("t IS NOT NULL AND n_signals > 0")
    nth = F.row_number().over(W.partitionBy("path").orderBy("line_no")) - 1
    return rows.select("path", nth.cast("long").alias("row"), "t", text(1).alias("task"), text(2).alias("mark"), text(3).alias("count"), signals.alias("signals"))


def measurements_per_channel(labels: Column) -> Column:
    """3 for oxyHb, deoxyHb, totalHb; else the smallest block of at most 8 labels that repeats; else 1."""
    triple = F.array(F.lit("oxyHb"), F.lit("deoxyHb"), F.lit("totalHb"))
    n = F.size(labels)
    repeats = lambda k: (n % k == 0) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(labels, i.cast("int")) == F.get(labels, (i % k).cast("int")))
    block = F.get(F.filter(F.sequence(F.lit(1), F.least(F.lit(8), F.greatest(n, F.lit(1)))), repeats), 0)
    return F.when((F.slice(labels, 1, 3) == triple) | (F.array_distinct(labels) == triple), 3).otherwise(F.coalesce(block, F.lit(1)))


def optodes(rows: DataFrame, prefix: str) -> DataFrame:
    """Positions of labels that are the prefix and a number: adds num and idx (place in the file, from 1); others are left out. rows: path, line_no, Label, X, Y, Z."""
    num = F.regexp_extract("Label", rf"(?i)^\s*{prefix}(\d+)\s*$", 1).try_cast("int")
    out = rows.withColumn("num", num).filter("num IS NOT NULL")
    return out.withColumn("idx", F.row_number().over(W.partitionBy("path").orderBy("line_no")))


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, without the quotes and blanks around them."""
    cells = F.split(F.regexp_replace(line, r"\r$", ""), r''',(?=(?:[^"]*"[^"]*")*[^"]*$)''')
    quoted = lambda x: F.when(x.rlike(r'''^".*"$'''), F.replace(F.regexp_extract(x, r'''^"(.*)"$''', 1), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(cells, lambda x: quoted(F.trim(x)))


def vhdr_interval(texts: DataFrame) -> DataFrame:
    """path and interval_us of BrainVision headers; null without a SamplingInterval line."""
    return texts.select("path", F.regexp_extract("text", r"(?m)^SamplingInterval=\s*([0-9.]+)", 1).try_cast("double").alias("interval_us"))


def vmrk_lines(markers: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of marker files with the interval of the header beside them (the same path but for the extension)."""
    beside = vhdr_interval(headers).select(F.regexp_replace("path", r"\.vhdr$", "").alias("stem"), "interval_us")
    return lines_of(markers).withColumn("stem", F.regexp_replace("path", r"\.vmrk$", "")).join(beside, "stem")


def protocol_markers(texts: DataFrame) -> DataFrame:
    """path, reference_time and value of an fNIRS protocol table, whose header line starts with `Start Time`."""
    rows = lines_of(texts)
    head = rows.filter(F.col("line").startswith("Start Time")).groupBy("path").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("head_no"))
    at = lambda name: F.array_position(csv_cells(F.col("head")), name)
    head = head.withColumn("a", at("Start Time")).withColumn("b", at("Protocol Type")).filter("a > 0 AND b > 0")
    cells = csv_cells(F.col("line"))
    out = rows.join(head, "path").filter("line_no > head_no").select("path", "line_no", F.round(hms_seconds(F.get(cells, (F.col("a") - 1).cast("int"))), 4).alias("reference_time"), F.nullif(F.trim(F.get(cells, (F.col("b") - 1).cast("int"))), F.lit("")).alias("value"))
    return out.filter("reference_time IS NOT NULL AND value IS NOT NULL")


def marker_rows(texts: DataFrame, candidates: tuple[str, ...] = MATCHING_TIME) -> DataFrame:
    """path, row, t and value of marker CSV files of any header: t is the first candidate column (any with `time` in its name for cleaning), value the column of that name; t null where it is no number, status missing_time_col where there is none."""
    rows = lines_of(texts)
    head = rows.filter("line_no = 0").select("path", csv_cells(F.col("line")).alias("names"))
    where = F.coalesce(*(F.nullif(F.array_position("names", c), F.lit(0).cast("long")) for c in candidates))
    if candidates == CLEANING_TIME:
        where = F.coalesce(where, F.nullif(F.array_position(F.transform("names", lambda x: F.lower(x).contains("time")), True), F.lit(0).cast("long")))
    head = head.select("path", where.alias("t_at"), F.nullif(F.array_position("names", "value"), F.lit(0).cast("long")).alias("v_at"))
    cells = csv_cells(F.col("line"))
    cell = lambda at: F.trim(F.get(cells, (F.col(at) - 1).cast("int")))
    out = rows.filter("line_no > 0 AND trim(line) <> ''").join(head, "path")
    return out.select("path", (F.col("line_no") - 1).alias("row"), cell("t_at").try_cast("double").alias("t"), cell("v_at").alias("value"), F.when(F.col("t_at").isNull(), "missing_time_col").alias("status"))


def wide_samples(texts: DataFrame) -> DataFrame:
    """path, sample_idx, channel and x of CSV files with one column per channel; without a header (a first line of numbers only) channels are ch1, ch2 ..."""
    rows = lines_of(texts).filter("trim(line) <> ''").withColumn("cells", csv_cells(F.col("line")))
    head = rows.filter("line_no = 0").select("path", "cells")
    bare = F.forall("cells", lambda x: x.try_cast("double").isNotNull())
    names = F.when(bare, F.transform("cells", lambda x, i: F.concat(F.lit("ch"), (i + 1).cast("string")))).otherwise(F.col("cells"))
    head = head.select("path", names.alias("names"), bare.alias("bare"))
    body = rows.join(head, "path").filter("bare OR line_no > 0")
    return body.select("path", (F.col("line_no") - F.when(F.col("bare"), 0).otherwise(1)).cast("long").alias("sample_idx"), F.posexplode(F.arrays_zip("names", "cells")).alias("k", "c")).select("path", "sample_idx", F.col("c.names").alias("channel"), F.col("c.cells").try_cast("double").alias("x"))


def timed_samples(texts: DataFrame) -> DataFrame:
    """path, i, t, channel and x of CSV files with a time column (the first candidate, or one with `time` in its name, or the first column); without a header the columns are Time(sec), CH1, CH2 ... Rows without a time are left out."""
    rows = wide_samples(texts)
    bare = F.col("channel").rlike(r"^ch\d+$")
    named = rows.withColumn("channel", F.when(bare & (F.col("channel") == "ch1"), "Time(sec)").when(bare, F.concat(F.lit("CH"), (F.substring("channel", 3, 9).cast("int") - 1).cast("string"))).otherwise(F.col("channel")))
    rank = F.coalesce(*(F.when(F.col("channel") == c, k) for k, c in enumerate(CLEANING_TIME)), F.when(F.lower("channel").contains("time"), len(CLEANING_TIME)))
    time = named.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("path").agg(F.min_by("channel", F.struct("rank", "channel")).alias("time"))
    t = named.join(time, "path").filter("channel = time AND x IS NOT NULL").select("path", "sample_idx", F.col("x").alias("t"))
    return named.join(time, "path").filter("channel <> time").join(t, ["path", "sample_idx"]).select("path", F.col("sample_idx").alias("i"), "t", "channel", "x")


def trigger_samples(texts: DataFrame) -> DataFrame:
    """path, i and v of one-column trigger files (the first line is a header); files with more columns are left out."""
    rows = lines_of(texts).filter("line_no > 0 AND trim(line) <> ''")
    wide = lines_of(texts).filter("line_no = 0 AND line LIKE '%,%'").select("path")
    return rows.join(wide, "path", "left_anti").select("path", (F.col("line_no") - 1).alias("i"), F.trim("line").try_cast("double").alias("v"))


def match_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Matching metadata JSON, one row a file."""
    return parsed_metadata(whole_texts(spark, paths))


def parsed_metadata(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.from_json("text", schemas.MATCH_METADATA).alias("meta"))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_name, stem, ext, device and size of the data files below a folder; hidden ones and archive leftovers are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    out = files.withColumn("file_name", name).withColumn("ext", ext).filter(F.col("ext").isin(*DATA_EXTENSIONS) & ~F.col("path").rlike(r"/\.[^/]") & ~F.col("path").contains("__MACOSX"))
    return out.select("path", "file_name", stem(F.col("file_name")).alias("stem"), "ext", device_from_path(F.col("path")).alias("device"), input_format(F.col("path")).alias("format"), "size")
