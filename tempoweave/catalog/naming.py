"""Queries on file names, inventories and text values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweave.catalog import Catalog
from tempoweave.functions import naming, times
from tempoweave.operators import inventory
from tempoweave.sources.driver_tables import FILES_SQL, MARKERS_SQL, file_names, markers, table

C = Catalog()

DEVICE_SQL = "CASE WHEN lower({0}) LIKE '%nirs%' THEN 'fnirs' WHEN lower({0}) LIKE '%eeg%' THEN 'eeg' WHEN lower({0}) LIKE '%ecg%' OR lower({0}) LIKE '%ekg%' THEN 'ecg' WHEN lower({0}) LIKE '%eda%' OR lower({0}) LIKE '%gsr%' THEN 'eda' WHEN lower({0}) LIKE '%emg%' THEN 'emg' WHEN lower({0}) LIKE '%resp%' THEN 'resp' ELSE 'unknown' END"
PATH_SQL = f"CASE WHEN path LIKE 'Data/raw/fnirs/%' THEN 'fnirs' WHEN path LIKE 'Data/convert/ECG/%' THEN 'ecg' WHEN path LIKE 'Data/raw/my_eeg_files/%' THEN 'eeg' ELSE {DEVICE_SQL.format('name')} END"
PARSE_SQL = """SELECT id, name,
 CASE id % 5 WHEN 0 THEN CASE WHEN length(regexp_extract(name, '^sub-(\\d+)', 1)) < 3 THEN lpad(regexp_extract(name, '^sub-(\\d+)', 1), 3, '0') ELSE regexp_extract(name, '^sub-(\\d+)', 1) END
   WHEN 1 THEN substr(name, 9, 3) WHEN 2 THEN substr(name, 9, 3) ELSE substr(name, 6, 3) END AS subject_id,
 CASE id % 5 WHEN 0 THEN 'ses-0' || (id % 7) WHEN 1 THEN left(name, 8) WHEN 2 THEN left(name, 8) WHEN 3 THEN 'WJTB' ELSE 'MISC' END AS session_label,
 CASE id % 5 WHEN 0 THEN '0' || (id % 7) WHEN 1 THEN '0' || (id % 9 + 1) WHEN 2 THEN '0' || (id % 3 + 1) WHEN 3 THEN lpad(CAST(id % 12 AS VARCHAR), 2, '0') ELSE '01' END AS sequence_id,
 CASE id % 5 WHEN 3 THEN 'WJTB' WHEN 4 THEN 'MISC' END AS project,
 CASE id % 5 WHEN 0 THEN 'bids' WHEN 1 THEN 'date_subject' WHEN 2 THEN 'date_subject' WHEN 3 THEN 'project_subject_seg' ELSE 'unmatched' END AS filename_style,
 CASE id % 5 WHEN 0 THEN 'fnirs' WHEN 4 THEN 'ecg' ELSE 'unknown' END AS device FROM fn"""


@C.query(f"WITH {FILES_SQL} {PARSE_SQL}")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    return file_names(spark, d).select("id", "name", naming.parsed_name(F.col("name")).alias("p")).select("id", "name", "p.*")


@C.query(f"WITH {FILES_SQL} SELECT id, {DEVICE_SQL.format('name')} AS by_name, {PATH_SQL} AS by_path FROM fn")
def device_infer(spark: SparkSession, d: str) -> DataFrame:
    return file_names(spark, d).select("id", naming.device_from_name(F.col("name")).alias("by_name"), naming.device_from_path(F.col("path")).alias("by_path"))


@C.query(f"""WITH {FILES_SQL}, n AS (SELECT id, name, CASE id % 5 WHEN 1 THEN 'sub-' || substr(name, 9, 3) || '_ses-0' || (id % 9 + 1) || '_task-rest_fnirs' WHEN 2 THEN 'sub-' || substr(name, 9, 3) || '_ses-0' || (id % 3 + 1) || '_task-rest_ecg'
  WHEN 3 THEN 'sub-' || substr(name, 6, 3) || '_ses-' || lpad(CAST(id % 12 AS VARCHAR), 2, '0') || '_task-breathe_eeg' END AS base FROM fn),
e AS (SELECT *, base || regexp_extract(name, '\\.[^.]*$') AS target FROM n WHERE base IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) - 1 AS nth FROM e)
SELECT id, name AS old_name, CASE WHEN nth = 0 THEN target ELSE base || '_' || nth || regexp_extract(name, '\\.[^.]*$') END AS new_name FROM c""")
def bids_rename(spark: SparkSession, d: str) -> DataFrame:
    names = file_names(spark, d).withColumn("base", naming.bids_name(F.col("name"))).filter("base IS NOT NULL")
    names = names.select("id", F.col("name").alias("old_name"), F.concat("base", F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("new_name"))
    return inventory.without_collisions(names, old="id").select("id", "old_name", "new_name")


@C.query(f"WITH {FILES_SQL} SELECT id, CASE WHEN path LIKE '%/convert/%' THEN 'convert' ELSE 'raw' END AS kind, CASE WHEN name LIKE '%.set' THEN 'eeglab' END AS format FROM fn")
def file_kind(spark: SparkSession, d: str) -> DataFrame:
    return file_names(spark, d).select("id", naming.file_type(F.col("path")).alias("kind"), naming.input_format(F.col("path")).alias("format"))


@C.query(f"WITH {FILES_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'rest' END AS task, CASE WHEN id % 5 = 0 THEN replace(name, '_task-rest_', '_task-film_') ELSE name END AS renamed FROM fn")
def task_rename(spark: SparkSession, d: str) -> DataFrame:
    return file_names(spark, d).select("id", naming.task_of(F.col("name")).alias("task"), naming.with_task(F.col("name"), "film").alias("renamed"))


def _inventory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Data files, and marker files named like their stems (some several times, every seventh like none)."""
    files = file_names(spark, d)
    data = inventory.with_names(files.select("path", (F.col("id") % 97 + 0.25).alias("duration")))
    stems = files.select("id", F.concat(naming.stem(F.col("name")), F.when(F.col("id") % 7 == 0, "_x").otherwise("")).alias("stem"))
    marks = inventory.with_names(stems.select(F.concat(F.lit("Data/marker/"), "stem", F.when(F.col("id") % 2 == 0, "_input_marker.csv").otherwise("_marker.csv")).alias("path")).distinct())
    return data, marks


INVENTORY_SQL = f"""WITH {FILES_SQL}, s AS (SELECT id, name, path, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM fn), da AS (SELECT id, path, name AS file_name, lower(stem) AS key, id % 97 + 0.25 AS duration FROM s),
ma AS (SELECT DISTINCT 'Data/marker/' || stem || CASE WHEN id % 7 = 0 THEN '_x' ELSE '' END || CASE WHEN id % 2 = 0 THEN '_input_marker.csv' ELSE '_marker.csv' END AS path, lower(stem || CASE WHEN id % 7 = 0 THEN '_x' ELSE '' END) AS key FROM s),
c AS (SELECT key, count(*) AS n, min(path) AS one FROM ma GROUP BY key),
m AS (SELECT da.*, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN one END AS marker_path FROM da LEFT JOIN c ON c.key = da.key),
orphan AS (SELECT * FROM ma WHERE path NOT IN (SELECT marker_path FROM m WHERE marker_path IS NOT NULL))"""


@C.query(INVENTORY_SQL + " SELECT path, n_candidates, marker_path FROM m")
def data_marker_join(spark: SparkSession, d: str) -> DataFrame:
    return inventory.match_markers(*_inventory(spark, d)).select("path", "n_candidates", "marker_path")


@C.query(INVENTORY_SQL + " SELECT path, key FROM orphan")
def marker_orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    return inventory.orphan_markers(*_inventory(spark, d)).select("path", "key")


@C.query(INVENTORY_SQL + """, r AS (SELECT file_name, length(marker_path) AS n_markers, duration FROM m UNION ALL SELECT regexp_extract(path, '[^/]*$') AS file_name, length(path), NULL FROM orphan)
SELECT file_name, coalesce(n_markers, 0) AS n_markers, round(duration, 2)::DOUBLE AS sequence_duration FROM r""")
def subject_report(spark: SparkSession, d: str) -> DataFrame:
    data, marks = _inventory(spark, d)
    metrics = marks.select("path", F.length("path").cast("long").alias("n_markers"), F.lit(None).cast("double").alias("duration"))
    return inventory.inventory_report(data, marks, metrics).select("file_name", "n_markers", "sequence_duration")


@C.query(f"WITH {MARKERS_SQL}, p AS (SELECT subject, device, t, CASE device WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 3 END AS priority FROM mk), f AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY priority, t) AS nth FROM p) SELECT subject, device, round(t, 6) AS t FROM f WHERE nth = 1")
def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    ranked = markers(spark, d).withColumn("priority", F.struct(F.when(F.col("device") == "view", 2).when(F.col("device") == "click", 1).otherwise(3), F.col("t")))
    return inventory.first_by_priority(ranked, ["subject"]).select("subject", "device", F.round("t", 6).alias("t"))


@C.query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 13 + 1 > 12 THEN 'unknown' ELSE '2024-' || lpad(CAST(event_id % 13 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') END AS date,
 CASE WHEN event_id % 25 > 23 THEN 'unknown' ELSE lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 9 AS VARCHAR), 2, '0') || '.5Z' END AS time FROM events""")
def normalize_date_time(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    day = F.when(k % 7 == 0, "2024/**/01").otherwise(F.concat(F.lit("on 2024/"), (k % 13 + 1).cast("string"), F.lit("-"), (k % 28 + 1).cast("string")))
    clock = F.concat((k % 25).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":"), (k % 9).cast("string"), F.lit(".5"))
    return table(spark, d, "events").select("event_id", times.iso_date(day).alias("date"), times.iso_time(clock).alias("time"))


@C.query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ecg' WHEN event_id % 5 = 1 THEN 'eeg' WHEN event_id % 5 = 2 THEN 'egg' WHEN event_id % 5 = 3 THEN 'input' ELSE 'other' END AS grp, CASE event_id % 4 WHEN 0 THEN 'HbO' WHEN 1 THEN 'HbR' WHEN 2 THEN 'ProcessedData' ELSE 'raw' || event_id END AS label FROM events")
def channel_group_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    name = F.when(k % 5 == 0, "E_C-G (1)").when(k % 5 == 1, " EEG 12").when(k % 5 == 2, "egg[3]").when(k % 5 == 3, "In Put 4").otherwise("Respiration")
    label = F.when(k % 4 == 0, " oxyHb").when(k % 4 == 1, "deoxyHb").when(k % 4 == 2, "  ").otherwise(F.concat(F.lit("raw"), k.cast("string")))
    return table(spark, d, "events").select("event_id", naming.channel_group(name).alias("grp"), naming.processed_label(label).alias("label"))


@C.query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50) / 4.0 WHEN 1 THEN CASE WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN (200000000 // 40) / 250.0 ELSE (event_id % 1000) / 250.0 END WHEN 2 THEN (event_id * 12000) / 12.0 / 500.0 ELSE (event_id % 70) / 10.0 END::DOUBLE AS duration FROM events""")
def file_duration(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    big = (k % 2 == 1) & (k % 3 == 0)
    files = table(spark, d, "events").select(
        "event_id", F.when(k % 4 == 0, "a/b.snirf").when(k % 4 == 1, "a/b.csv").when(k % 4 == 2, "a/b.acq").otherwise("a/b.TXT").alias("path"),
        F.when(k % 4 == 0, (k % 50) / 4.0).alias("last_time"), (k % 1000).alias("n_rows"), F.when(k % 4 == 2, k * 12000).when(big, 200_000_000).otherwise(1000).alias("size"), F.lit(40).alias("line_bytes"), F.when(k % 4 == 3, k % 70).alias("total_points"),
    )
    return inventory.duration_of(files).select("event_id", "duration")


@C.query(f"""WITH {FILES_SQL}, s AS (SELECT DISTINCT path, lower(regexp_replace(name, '\\.[^.]*$', '')) AS key FROM fn WHERE path LIKE 'Data/raw/%' OR path LIKE 'Data/convert/ECG/%'),
m AS (SELECT DISTINCT 'Data/marker/' || regexp_replace(name, '\\.[^.]*$', '') || '_marker.csv' AS path, lower(regexp_replace(name, '\\.[^.]*$', '')) AS key FROM fn)
SELECT m.path, s.path AS data_path, row_number() OVER (PARTITION BY m.path ORDER BY CASE WHEN s.path LIKE 'Data/convert/%' THEN 1 ELSE 3 END, s.path) AS priority FROM m JOIN s ON m.key = s.key""")
def marker_data_files(spark: SparkSession, d: str) -> DataFrame:
    files = file_names(spark, d)
    marks = files.select(F.concat(F.lit("Data/marker/"), naming.stem(F.col("name")), F.lit("_marker.csv")).alias("path"))
    return inventory.data_files_for_markers(marks, files.select("path"))
