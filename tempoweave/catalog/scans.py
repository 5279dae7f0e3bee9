"""Queries on text formats (texts made of table rows, read back), devices' files and summaries, and plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.catalog import Catalog
from tempoweave.catalog.markers import BAND, SIGMA, TWO_SQL, _devices, _two, _two_timeline
from tempoweave.functions import naming, times
from tempoweave.operators import crop, devices, inventory, matching, quality, report, spectral
from tempoweave.sources import text_scans
from tempoweave.sources.driver_tables import FILES_SQL, MARKERS_SQL, SIGNALS_SQL, file_names, markers, signals, table

C = Catalog()


def _export(spark: SparkSession, d: str) -> DataFrame:
    """One fNIRS export per subject: a header, and a row per event with six signals (four in every fifth row)."""
    k, u = F.col("event_id"), F.col("user_id")
    cells = [F.format_string("%.3f", F.col("nth") / 4.0), F.lit("0"), F.when(k % 3 == 0, F.lit("0Z")).otherwise((k % 9).cast("string")), F.col("nth").cast("string"), *((k * 10 + j).cast("string") for j in range(4))]
    line = F.concat_ws("\t", *cells, F.when(F.col("nth") % 5 != 4, F.concat_ws("\t", *((k * 10 + j).cast("string") for j in (4, 5)))))
    rows = table(spark, d, "events").withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).select(u, "nth", line.alias("line"))
    body = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("lines"), F.count(F.lit(1)).alias("n"))
    head = [
        F.when(u % 2 == 0, F.lit("[Data Line]\t11")).otherwise("[Header]"), F.concat(F.lit("Measured Date\t2024/"), (u % 12 + 1).cast("string"), F.lit("/5 9:"), (u % 60).cast("string"), F.lit(":07")),
        F.concat(F.lit("ID\t"), F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("S"), u.cast("string")))), F.when(u % 7 == 0, F.lit("Name\tSomebody")).otherwise("Name\t"),
        F.concat(F.lit("Total Points\t"), F.col("n").cast("string")), F.when(u % 2 == 0, F.lit("Output Mode\tx Data Type Hb")).otherwise("Output Mode\tx Data Type Abs"),
        F.concat(F.lit("Time Range\t0.0\t"), F.format_string("%.2f", (F.col("n") - 1) / 4.0)), F.lit("[Text Info.]"), F.concat(F.lit("(1,1)(2,"), (u % 4).cast("string"), F.lit(")")),
        F.lit("Time(sec)\tTask\tMark\tCount\toxyHb\tdeoxyHb\ttotalHb\toxyHb\tdeoxyHb\ttotalHb"),
    ]
    return body.select(u.cast("string").alias("path"), F.concat_ws("\n", *head, F.col("lines")).alias("text"))


@C.query("""WITH s AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(u AS VARCHAR) AS path, 10 AS data_start, CASE WHEN u % 7 = 0 AND length(CASE WHEN u % 3 = 0 THEN '' ELSE 'S' || u END) < 8 THEN 'Somebody' WHEN u % 3 = 0 THEN 'unknown' ELSE 'S' || u END AS subject_id,
'2024-' || lpad(CAST(u % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS date, '09:' || lpad(CAST(u % 60 AS VARCHAR), 2, '0') || ':07Z' AS time, CASE WHEN u % 2 = 0 THEN 'Hb' ELSE 'Abs' END AS data_type,
0.0::DOUBLE AS first_time, round((n - 1) / 4.0::DOUBLE, 2) AS last_time, n AS total_points, '1-1 2-' || (u % 4) AS pairs, 6 AS n_labels, 3 AS per_channel FROM s""")
def fnirs_header(spark: SparkSession, d: str) -> DataFrame:
    head = text_scans.fnirs_headers(_export(spark, d))
    pairs = F.array_join(F.transform("channel_pairs", lambda p: F.concat(p["source"].cast("string"), F.lit("-"), p["detector"].cast("string"))), " ")
    return head.select("path", "data_start", "subject_id", "date", "time", "data_type", F.col("time_range")[0].alias("first_time"), F.col("time_range")[1].alias("last_time"), "total_points", pairs.alias("pairs"), F.size("signal_labels").alias("n_labels"), text_scans.measurements_per_channel(F.col("signal_labels")).alias("per_channel"))


@C.query("""WITH s AS (SELECT user_id AS u, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events)
SELECT CAST(u AS VARCHAR) AS path, nth AS "row", round(nth / 4.0::DOUBLE, 3) AS t, '0' AS task, CASE WHEN k % 3 = 0 THEN '0Z' ELSE CAST(k % 9 AS VARCHAR) END AS mark, CAST(nth AS VARCHAR) AS count,
(k * 10)::DOUBLE AS s0, (k * 10 + 3)::DOUBLE AS s3, CASE WHEN nth % 5 <> 4 THEN (k * 10 + 5)::DOUBLE END AS s5, 6 AS n_signals FROM s""")
def fnirs_body(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("signals")
    return text_scans.fnirs_body(_export(spark, d)).select("path", "row", F.round("t", 3).alias("t"), "task", "mark", "count", F.get(s, 0).alias("s0"), F.get(s, 3).alias("s3"), F.get(s, 5).alias("s5"), F.size(s).alias("n_signals"))


@C.query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_suppkey % 3 <> 2)
SELECT n AS path, CASE WHEN k % 3 = 0 THEN 'T' ELSE 't' END || k AS label, CAST(k AS INTEGER) AS num, row_number() OVER (PARTITION BY n ORDER BY k) AS idx FROM s""")
def optode_positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("t"), k.cast("string"))).otherwise(F.concat(F.lit("R"), k.cast("string")))
    return text_scans.optodes(table(spark, d, "supplier").select(F.col("s_nationkey").alias("path"), k.alias("line_no"), label.alias("Label")), "T").select("path", F.col("Label").alias("label"), "num", "idx")


@C.query(f"""WITH {MARKERS_SQL}, r AS (SELECT subject, device, min(t) AS lo, max(t) AS hi, count(*) AS n FROM mk GROUP BY ALL)
SELECT CAST(subject AS VARCHAR) AS path, device, n AS n_events, round(lo, 3) AS lo, round(hi, 3) AS hi, round(lo, 2) AS "offset", 'theil_sen' AS method FROM r""")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Matching metadata written as JSON and read with its schema."""
    rows = markers(spark, d).groupBy("subject", "device").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    drift = F.struct(F.round("lo", 2).alias("offset"), F.lit(1.0).alias("scale"), F.lit(1.0).alias("r_squared"), F.lit(5).alias("n_matches"), F.lit("theil_sen").alias("method"))
    info = F.struct(F.col("device").alias("name"), F.col("n").alias("n_events"), F.array(F.round("lo", 3), F.round("hi", 3)).alias("time_range"), drift.alias("drift_correction"))
    texts = rows.groupBy("subject").agg(F.to_json(F.struct(F.collect_list(info).alias("device_info"))).alias("text")).select(F.col("subject").cast("string").alias("path"), "text")
    out = text_scans.parsed_metadata(texts).select("path", F.explode("meta.device_info").alias("i"))
    return out.select("path", F.col("i.name").alias("device"), F.col("i.n_events").cast("long").alias("n_events"), F.col("i.time_range")[0].alias("lo"), F.col("i.time_range")[1].alias("hi"), F.col("i.drift_correction.offset").alias("offset"), F.col("i.drift_correction.method").alias("method"))


def _csv_texts(spark: SparkSession, d: str) -> DataFrame:
    """Marker CSV per subject: an index column, a quoted value with a comma, and the time in a column of one of three names."""
    k, u = F.col("event_id"), F.col("user_id")
    line = F.concat(k.cast("string"), F.lit(',"a ""'), (k % 5).cast("string"), F.lit('"", b",'), F.when(k % 11 == 0, "x").otherwise(F.format_string("%.2f", k / 4.0)))
    head = F.concat(F.lit(",value,"), F.when(u % 3 == 0, "reference_time").when(u % 3 == 1, '"Time(sec)"').otherwise("Moment"))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(k, line.alias("line")))).alias("l")).select(u.cast("string").alias("path"), F.concat_ws("\r\n", head, F.transform("l", lambda x: x["line"])).alias("text"))


@C.query("""WITH s AS (SELECT user_id AS u, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events)
SELECT CAST(u AS VARCHAR) AS path, nth AS "row", CASE WHEN u % 3 <> 2 AND k % 11 <> 0 THEN round(k / 4.0::DOUBLE, 2) END AS t, 'a "' || (k % 5) || '", b' AS value, CASE WHEN u % 3 = 2 THEN 'missing_time_col' END AS status FROM s""")
def marker_csv(spark: SparkSession, d: str) -> DataFrame:
    return text_scans.marker_rows(_csv_texts(spark, d)).select("path", F.col("row").cast("long").alias("row"), F.round("t", 2).alias("t"), "value", "status")


@C.query("""SELECT CAST(user_id AS VARCHAR) AS path, round((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59) + 0.25::DOUBLE, 4) AS reference_time, 'Task' || (event_id % 4) AS value FROM events WHERE event_id % 6 <> 0""")
def protocol_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    clock = F.format_string("%02d:%02d:%02d.25", k % 24, k % 60, k % 59)
    line = F.concat(clock, F.lit(",1,"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("Task"), (k % 4).cast("string"))))
    texts = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(line).alias("l")).select(F.col("user_id").cast("string").alias("path"), F.concat_ws("\n", F.lit("some text"), F.lit("Start Time,No, Protocol Type"), "l").alias("text"))
    return text_scans.protocol_markers(texts).select("path", "reference_time", "value")


@C.query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'gbk' ELSE 'utf-8-sig' END AS encoding, CASE WHEN event_id % 3 = 2 THEN '时间' || event_id ELSE 'time' || event_id END AS text FROM events""")
def robust_csv(spark: SparkSession, d: str) -> DataFrame:
    """Texts of three encodings (one with a byte order mark), each read by the first that fits."""
    k = F.col("event_id")
    plain = F.concat(F.lit("time"), k.cast("string"))
    raw = F.when(k % 3 == 0, F.encode(plain, "UTF-8")).when(k % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(plain, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("CAB1BCE4")), F.encode(k.cast("string"), "UTF-8")))
    return text_scans.decoded(table(spark, d, "events").select(k.cast("string").alias("path"), raw.alias("content"))).select(F.col("path").cast("long").alias("event_id"), "encoding", "text")


@C.query(f"WITH {FILES_SQL} SELECT id, CASE WHEN name LIKE '%\\_fnirs%' ESCAPE '\\' THEN 'fnirs' ELSE 'unknown' END AS kind, lower(replace(replace(replace(name, '_', ''), '-', ''), ' ', '')) AS plain, replace(replace(name, '_hbo', ''), '_hbr', '') AS base FROM fn")
def name_probes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return file_names(spark, d).select("id", naming.device_type(n).alias("kind"), naming.channel_name(n).alias("plain"), naming.pair_base(n).alias("base"))


@C.query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 7 + 0.5::DOUBLE ELSE -(event_id % 5) - 0.25::DOUBLE END AS ecg, 1.5::DOUBLE AS eeg FROM events""")
def offset_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    spec = F.when(k % 2 == 0, F.concat(F.lit("ecg:"), (k % 7 + 0.5).cast("string"), F.lit(", eeg:1.5"))).otherwise(F.concat(F.lit('{"ecg": '), (-(k % 5) - 0.25).cast("string"), F.lit(', "eeg": 1.5}')))
    out = table(spark, d, "events").select("event_id", times.offset_map(spec).alias("m"))
    return out.select("event_id", F.col("m")["ecg"].alias("ecg"), F.col("m")["eeg"].alias("eeg"))


@C.query("SELECT event_id, round_even(value, 2) AS value FROM events")
def report_rounded(spark: SparkSession, d: str) -> DataFrame:
    return report.rounded(table(spark, d, "events").select("event_id", "value"))


# ---------------------------------------------------------------- devices


@C.query(f"WITH {MARKERS_SQL}, e AS (SELECT subject, device, t, exp(value / 10 - max(value / 10) OVER (PARTITION BY subject)) AS e FROM mk) SELECT subject, device, round(t, 6) AS t, round(e / sum(e) OVER (PARTITION BY subject), 9) AS softmax FROM e")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d).withColumn("x", F.col("value") / 10)
    return devices.softmax(rows, ["subject"], "x").select("subject", "device", F.round("t", 6).alias("t"), F.round("softmax", 9).alias("softmax"))


@C.query(f"WITH {MARKERS_SQL} SELECT subject, device, count(t) AS n_events, round(min(t), 6) AS lo, round(max(t), 6) AS hi FROM mk GROUP BY ALL")
def device_info(spark: SparkSession, d: str) -> DataFrame:
    return devices.device_info(markers(spark, d), ["subject", "device"]).select("subject", "device", "n_events", F.round("time_range.lo", 6).alias("lo"), F.round("time_range.hi", 6).alias("hi"))


@C.query(TWO_SQL + " SELECT subject, count(*) AS n_matches, round(avg(w), 6) AS mean_confidence, round(min(w), 6) AS min, round(max(w), 6) AS max, round(stddev_pop(w), 6) AS std FROM mt GROUP BY subject")
def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    out = devices.confidence_stats(matching.match_events(*_two(spark, d), ["subject"], sigma=SIGMA, band=BAND), ["subject"])
    return out.select("subject", "n_matches", *(F.round(c, 6).alias(c) for c in ("mean_confidence", "min", "max", "std")))


@C.query(TWO_SQL + """, g AS (SELECT 'view' AS device, 1.0::DOUBLE AS w FROM tl WHERE ta IS NOT NULL UNION ALL SELECT 'click', w FROM tl WHERE tb IS NOT NULL)
SELECT device, CAST(least(floor(w * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY ALL""")
def match_histogram(spark: SparkSession, d: str) -> DataFrame:
    return devices.match_plots(_two_timeline(spark, d), [])[0]


@C.query(TWO_SQL + " SELECT subject, 'view' AS device, count(ta) AS n_matched FROM tl GROUP BY subject HAVING count(ta) > 0 UNION ALL SELECT subject, 'click', count(tb) FROM tl GROUP BY subject HAVING count(tb) > 0")
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return devices.match_plots(_two_timeline(spark, d), ["subject"])[1]


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Devices named by customer, of four kinds, and the converted files that are there (exact, fuzzy, none)."""
    c = F.col("c_custkey")
    kind = F.when(c % 4 == 0, "ecg").when(c % 4 == 1, "eeg").when(c % 4 == 2, "fnirs").otherwise("other")
    asked = table(spark, d, "customer").select(F.concat(F.lit("sub-"), c.cast("string"), F.lit("_x"), F.when(c % 8 == 0, "_input").otherwise("")).alias("name"), kind.alias("kind"), c.alias("k"))
    stem = devices.search_name(F.col("name"), F.col("kind"))
    path = F.when(F.col("kind") == "ecg", F.concat(F.lit("Data/convert/ECG/"), stem, F.when(F.col("k") % 3 == 0, "_ecg.csv").when(F.col("k") % 3 == 1, "_b_ecg.csv"))).when(
        F.col("kind") == "eeg", F.concat(F.lit("Data/convert/EEG/"), F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "a_"), stem, F.lit(".vhdr"))
    ).when(F.col("kind") == "fnirs", F.concat(F.lit("Data/convert/fnirs/"), F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "a_"), stem, F.lit(".snirf")))
    return asked.select("name", "kind"), asked.select(path.alias("path")).filter("path IS NOT NULL")


@C.query("""WITH a AS (SELECT c_custkey AS k, 'sub-' || c_custkey || '_x' || CASE WHEN c_custkey % 8 = 0 THEN '_input' ELSE '' END AS name, CASE c_custkey % 4 WHEN 0 THEN 'ecg' WHEN 1 THEN 'eeg' WHEN 2 THEN 'fnirs' ELSE 'other' END AS kind FROM customer),
s AS (SELECT *, CASE WHEN kind = 'ecg' THEN replace(name, '_input', '_ecg') ELSE name END AS stem FROM a)
SELECT name, kind, k % 3 <> 2 AND kind <> 'other' AS exists, CASE kind WHEN 'ecg' THEN 'Data/convert/ECG/' || stem || CASE WHEN k % 3 = 1 THEN '_b' ELSE '' END || '_ecg.csv'
  WHEN 'eeg' THEN 'Data/convert/EEG/' || CASE WHEN k % 3 = 1 THEN 'a_' ELSE '' END || stem || '.vhdr' WHEN 'fnirs' THEN 'Data/convert/fnirs/' || CASE WHEN k % 3 = 1 THEN 'a_' ELSE '' END || stem || '.snirf' END AS path FROM s""")
def converted_files(spark: SparkSession, d: str) -> DataFrame:
    return devices.converted_files(*_asked(spark, d)).select("name", "kind", "exists", "path")


@C.query("""WITH a AS (SELECT c_custkey AS k, 'Rec' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_input' ELSE '' END AS name, CASE c_custkey % 4 WHEN 0 THEN 'ecg' WHEN 1 THEN 'eeg' WHEN 2 THEN 'fnirs' ELSE 'gsr' END AS kind FROM customer)
SELECT name, kind, CASE WHEN k % 5 = 0 THEN NULL WHEN kind = 'ecg' THEN (k * 100) / 250.0::DOUBLE WHEN kind = 'eeg' THEN (k * 100) / 500.0::DOUBLE WHEN kind = 'fnirs' THEN k / 4.0::DOUBLE END AS duration FROM a""")
def raw_durations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = F.when(c % 4 == 0, "ecg").when(c % 4 == 1, "eeg").when(c % 4 == 2, "fnirs").otherwise("gsr")
    rows = table(spark, d, "customer").select(F.concat(F.lit("Rec"), c.cast("string"), F.when(c % 3 == 0, "_input").otherwise("")).alias("name"), kind.alias("kind"), c.alias("k"))
    stem = F.when(F.col("kind") == "ecg", F.concat(F.lit("REC"), F.col("k").cast("string"), F.lit("_ECG"))).otherwise(F.upper("name"))
    files = rows.filter("k % 5 <> 0").select(stem.alias("stem"), "kind", (F.col("k") * 100).alias("n_rows"), F.lit(500.0).alias("sfreq"), (F.col("k") / 4.0).alias("last_time"))
    return devices.raw_durations(rows.select("name", "kind"), files)


@C.query(f"""WITH {MARKERS_SQL}, c AS (SELECT subject, device AS path, CASE device WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 + length(device) END AS priority, CASE WHEN device = 'click' AND subject % 2 = 0 THEN NULL ELSE round(max(t) - min(t), 3) END AS duration FROM mk GROUP BY subject, device)
SELECT subject, arg_min(path, priority) AS path, arg_min(duration, priority) AS duration FROM c WHERE duration IS NOT NULL GROUP BY subject""")
def marker_duration(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("device") == "click", 1).when(F.col("device") == "view", 2).otherwise(F.length("device") + 3)
    rows = markers(spark, d).groupBy("subject", "device").agg((F.max("t") - F.min("t")).alias("span")).select("subject", F.col("device").alias("path"), priority.alias("priority"), F.when(~((F.col("device") == "click") & (F.col("subject") % 2 == 0)), F.round("span", 3)).alias("duration"))
    return devices.duration_for_marker(rows, ["subject"])


@C.query(f"""WITH {MARKERS_SQL}, r AS (SELECT subject, device, min(t) AS lo, max(t) AS hi FROM mk WHERE device IN ('view', 'click') GROUP BY ALL), v AS (SELECT * FROM r WHERE device = 'view'), c AS (SELECT * FROM r WHERE device = 'click'), n AS (SELECT chr(10) AS nl)
SELECT v.subject, repeat('=', 60) || nl || 'TIMELINE CROPPING SUMMARY' || nl || repeat('=', 60) || nl || 'Reference (shortest): view' || nl || printf('  Range: %.3f - %.3fs', v.lo, v.hi) || nl || printf('  Duration: %.3fs', v.hi - v.lo) || nl || nl || 'Devices processed:' || nl
 || '  click: CROP' || nl || printf('    Original: %.3f - %.3fs', c.lo, c.hi) || nl || printf('    Cropped:  %.3f - %.3fs', v.lo, v.hi) || nl || printf('    Offset:   %+.3fs', v.lo - c.lo) || nl || '  view: KEEP' AS summary FROM v JOIN c ON c.subject = v.subject, n""")
def crop_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _devices(spark, d).filter("device IN ('view', 'click')").select("subject", "device", "lo", "hi")
    ref = rows.filter("device = 'view'").select("subject", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
    both = rows.join(ref, "subject").join(rows.filter("device = 'click'").select("subject"), "subject")
    return devices.crop_summary(both.withColumn("reference", F.lit("view")).withColumn("offset", F.col("new_lo") - F.col("lo")), ["subject"])


@C.query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'brainvision' WHEN 1 THEN 'eeglab' WHEN 2 THEN 'edf' END AS writer, CASE event_id % 4 WHEN 0 THEN '.vhdr' WHEN 1 THEN '.set' WHEN 2 THEN '.edf' END AS ext FROM events")
def export_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    name = F.when(k == 0, "BrainVision").when(k == 1, "EEGLAB").when(k == 2, "EDF").otherwise("MAT")
    return table(spark, d, "events").select("event_id", devices.export_format(name).alias("f")).select("event_id", "f.*")


@C.query(f"""WITH {SIGNALS_SQL}, a AS (SELECT recording, channel, stddev_pop(x) AS sd FROM sig GROUP BY ALL), b AS (SELECT recording, channel, max(x) AS peak FROM sig WHERE recording % 2 = 0 GROUP BY ALL)
SELECT a.recording, a.channel, round(sd, 6) AS sd, round(peak, 6) AS peak FROM a LEFT JOIN b ON a.channel = b.channel AND a.recording = b.recording""")
def quality_detail_scan(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    detail = s.groupBy("recording", "channel").agg(F.stddev_pop("x").alias("sd"))
    more = s.filter("recording % 2 = 0").groupBy("recording", "channel").agg(F.max("x").alias("peak"), F.lit(0.0).alias("sd"))
    return text_scans.quality_details(detail, more).select("recording", "channel", F.round("sd", 6).alias("sd"), F.round("peak", 6).alias("peak"))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """CSV samples per subject: a time column of one of three names, or no header, and two channels."""
    k, u = F.col("event_id"), F.col("user_id")
    cells = F.concat_ws(",", F.when(k % 13 == 0, "-").otherwise(F.format_string("%.2f", k / 4.0)), (k % 7).cast("string"), F.format_string("%.1f", F.col("value")))
    head = F.when(u % 4 == 0, "Time(sec),A,B").when(u % 4 == 1, "time,A,B").when(u % 4 == 2, "My Time,A,B")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k, cells.alias("line")))), lambda x: x["line"])
    first = F.lit("0.00,1,1.0")
    return table(spark, d, "events").groupBy("user_id").agg(lines.alias("l")).select(u.cast("string").alias("path"), F.concat_ws("\n", head, first, "l").alias("text"))


SHEET_SQL = """s AS (SELECT user_id AS u, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value FROM events),
r AS (SELECT u, i, CASE WHEN k % 13 <> 0 THEN round(k / 4.0::DOUBLE, 2) END AS t, (k % 7)::DOUBLE AS a, round(value, 1)::DOUBLE AS b FROM s UNION ALL SELECT DISTINCT u, 0, 0.0, 1.0, 1.0 FROM s),
w AS (SELECT CAST(u AS VARCHAR) AS path, i, t, CASE WHEN u % 4 = 3 THEN 'CH1' ELSE 'A' END AS channel, a AS x FROM r WHERE t IS NOT NULL UNION ALL SELECT CAST(u AS VARCHAR), i, t, CASE WHEN u % 4 = 3 THEN 'CH2' ELSE 'B' END, b FROM r WHERE t IS NOT NULL)"""


@C.query(f"WITH {SHEET_SQL} SELECT path, i, t, channel, round(x, 1) AS x FROM w")
def timed_sheets(spark: SparkSession, d: str) -> DataFrame:
    return text_scans.timed_samples(_sheet(spark, d)).select("path", "i", F.round("t", 2).alias("t"), "channel", F.round("x", 1).alias("x"))


@C.query(f"WITH {SHEET_SQL} SELECT path, channel, round(t - 99.5, 2) AS t, round(x, 1) AS x FROM w WHERE t >= 99.5 AND t <= 299.5")
def crop_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheets cropped by the closed rule, headerless ones as well."""
    rows = text_scans.timed_samples(_sheet(spark, d)).withColumn("start", F.lit(100.0)).withColumn("end", F.lit(300.0)).withColumn("offset", F.lit(0.5))
    return crop.crop_closed(rows, ["path", "channel"]).select("path", "channel", F.round("t", 2).alias("t"), F.round("x", 1).alias("x"))


@C.query(f"""WITH {FILES_SQL}, p AS (SELECT id, CASE WHEN id % 6 = 0 THEN replace(path, 'Data/', 'Data/.cache/') WHEN id % 6 = 1 THEN replace(path, name, '._' || name) WHEN id % 6 = 2 THEN '__MACOSX/' || path WHEN id % 6 = 3 THEN path || '.bak' ELSE path END AS path FROM fn)
SELECT id, path, regexp_extract(path, '[^/]*$') AS file_name FROM p WHERE id % 6 > 3""")
def data_file_scan(spark: SparkSession, d: str) -> DataFrame:
    k, p, n = F.col("id"), F.col("path"), F.col("name")
    path = F.when(k % 6 == 0, F.replace(p, F.lit("Data/"), F.lit("Data/.cache/"))).when(k % 6 == 1, F.replace(p, n, F.concat(F.lit("._"), n))).when(k % 6 == 2, F.concat(F.lit("__MACOSX/"), p)).when(k % 6 == 3, F.concat(p, F.lit(".bak"))).otherwise(p)
    return inventory.data_files(file_names(spark, d).select("id", path.alias("path"))).select("id", "path", "file_name")


@C.query(f"""WITH {MARKERS_SQL}, f AS (SELECT 'marker/' || device || '/' || CASE subject % 3 WHEN 0 THEN 'REC' WHEN 1 THEN 'rec' ELSE 'other' END || '_marker.csv' AS path, device, subject % 3 AS k, CASE WHEN subject % 3 = 0 AND device = 'view' THEN 0 ELSE count(*) END AS n FROM mk GROUP BY subject, device)
SELECT device, min(path) AS path FROM f WHERE k < 2 AND n > 0 GROUP BY device""")
def marker_folder(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("subject") % 3
    path = F.concat(F.lit("marker/"), "device", F.lit("/"), F.when(k == 0, "REC").when(k == 1, "rec").otherwise("other"), F.lit("_marker.csv"))
    files = markers(spark, d).groupBy("subject", "device").agg(F.count(F.lit(1)).alias("n")).select(path.alias("path"), F.when((k == 0) & (F.col("device") == "view"), 0).otherwise(F.col("n")).alias("n_rows"))
    return inventory.first_marker_files(files, "Rec")


@C.query(f"WITH {MARKERS_SQL} SELECT subject, device, round(t, 6) AS t, CASE WHEN subject % 3 = 0 THEN 'cached' ELSE 'extracted' END AS origin FROM mk")
def marker_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d).select("subject", "device", F.round("t", 6).alias("t"))
    return inventory.with_fallback(rows.filter("subject % 3 = 0").withColumn("origin", F.lit("cached")), rows.withColumn("origin", F.lit("extracted")), ["subject", "device"])


@C.query(f"""WITH {MARKERS_SQL}, r AS (SELECT subject, device, round(min(t), 3) AS lo, round(max(t), 3) AS hi FROM mk GROUP BY ALL), l AS (SELECT subject, list(device ORDER BY device) AS dv, list(lo ORDER BY device) AS lo FROM r GROUP BY subject)
SELECT subject, 'ecg' AS kind, len(dv) AS n, dv[1] AS first_device, round(lo[1], 3) AS first_lo, 'm' || subject AS meta FROM l""")
def crop_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of a crop, read back."""
    rows = _devices(spark, d).select("subject", "device", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), F.lit(0.5).alias("offset"), F.concat(F.lit("m"), F.col("subject").cast("string")).alias("meta"))
    out = crop.crop_metadata(rows, ["subject"], {"kind": "ecg"})
    read = F.from_json("json", "struct<crop_parameters:struct<kind:string>,devices_cropped:array<struct<name:string,range:array<double>,offset:double>>,original_matched_metadata:string>")
    out = out.select("subject", read.alias("j"))
    return out.select("subject", F.col("j.crop_parameters.kind").alias("kind"), F.size("j.devices_cropped").cast("long").alias("n"), F.col("j.devices_cropped")[0]["name"].alias("first_device"), F.col("j.devices_cropped")[0]["range"][0].alias("first_lo"), F.col("j.original_matched_metadata").alias("meta"))


@C.query(f"""WITH {SIGNALS_SQL}, p AS (SELECT recording, channel, max(x) > 0.35 AND recording % 2 = 0 AS post, min(x) < -0.35 AS pre FROM sig GROUP BY recording, channel), b AS (SELECT *, CASE WHEN bool_or(post) OVER (PARTITION BY recording) THEN post ELSE pre END AS bad FROM p)
SELECT recording, channel, CASE WHEN bad THEN 0.0 ELSE 1.0 END::DOUBLE AS channel_score, round(avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY recording), 6) AS overall_score FROM b""")
def channel_scores_of_both(spark: SparkSession, d: str) -> DataFrame:
    """Bad channels after filtering, or before it where none is left."""
    s = signals(spark, d).groupBy("recording", "channel").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    post, pre = s.select("recording", "channel", ((F.col("hi") > 0.35) & (F.col("recording") % 2 == 0)).alias("bad_final")), s.select("recording", "channel", (F.col("lo") < -0.35).alias("bad_final"))
    return quality.channel_scores(post, pre).select("recording", "channel", "channel_score", F.round("overall_score", 6).alias("overall_score"))


# ---------------------------------------------------------------- SQL


@C.query(f"WITH {MARKERS_SQL} SELECT subject, device, count(*) AS n, round(max(t) - min(t), 3) AS span FROM mk GROUP BY ROLLUP (subject, device)")
def marker_rollup(spark: SparkSession, d: str) -> DataFrame:
    return markers(spark, d).rollup("subject", "device").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("span"))


_SQL = """WITH per AS (SELECT subject, device, count(*) AS n FROM {mk} GROUP BY subject, device), most AS (SELECT subject, max(n) AS n FROM per GROUP BY subject)
SELECT per.subject, per.device, per.n FROM per JOIN most ON per.subject = most.subject AND per.n = most.n WHERE per.n > (SELECT avg(n) FROM per) AND EXISTS (SELECT 1 FROM {mk} m WHERE m.subject = per.subject AND m.value > 50)"""


@C.query(f"WITH {MARKERS_SQL}, q AS ({_SQL.format(mk='mk')}) SELECT * FROM q")
def busiest_devices_sql(spark: SparkSession, d: str) -> DataFrame:
    """Common table expressions, a scalar and a correlated subquery, as SQL text over the engine's views."""
    return spark.sql(_SQL, mk=markers(spark, d))


@C.query(f"WITH {SIGNALS_SQL}, g AS (SELECT j FROM range(32) t(j)) SELECT recording, channel, j AS sample_idx, round(sum(x * (1 + 2 * list_sum([cos(2 * pi() * k * (j / 32.0 - sample_idx / 64.0)) for k in range(1, 16)]) + 2 * cos(pi() * sample_idx / 2) * cos(pi() * j)) / 64), 6) AS x FROM sig, g GROUP BY ALL")
def fft_resample(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.fft_resample(signals(spark, d), ["recording", "channel"], 4.0, 2.0)
    return out.select("recording", "channel", "sample_idx", F.round("x", 6).alias("x"))

