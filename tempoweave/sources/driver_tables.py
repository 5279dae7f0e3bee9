"""Views of general tables (events, embeddings, line items, orders) as domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FS = 4.0  #: samples per second of the short channels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, device, t (seconds since the start of 2024) and value of each event."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("device"), (micros / 1e6).alias("t"), "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, ch_type, pair_base, sample_idx, x: one channel of 64 samples per embedding, even and odd ones in pairs, 50 to a recording."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample_idx", "x"))
    return rows.select(
        F.floor(F.col("vec_id") / 50).alias("recording"), F.concat(F.lit("ch"), F.col("vec_id").cast("string")).alias("channel"), F.when(F.col("vec_id") % 2 == 0, "hbo").otherwise("hbr").alias("ch_type"),
        F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2).cast("string")).alias("pair_base"), F.col("sample_idx").cast("long").alias("sample_idx"), F.col("x").cast("double").alias("x"),
    )


def trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, i and v: a voltage from 0 to 5 per supplier, in order of shipping."""
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.round(F.col("l_discount") * 50, 4).alias("v"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name and path of a recording file per order, in five naming styles."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    subject = F.format_string("%03d", c % 1000)
    day = F.format_string("202511%02d", k % 28 + 1)
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("sub-"), (c % 1000).cast("string"), F.lit("_ses-"), (k % 7).cast("string"), F.lit("_task-rest_fnirs.snirf")))
        .when(k % 5 == 1, F.concat(day, subject, F.lit("_"), (k % 9 + 1).cast("string"), F.lit(".TXT")))
        .when(k % 5 == 2, F.concat(day, subject, F.lit("part"), (k % 3 + 1).cast("string"), F.lit(".acq")))
        .when(k % 5 == 3, F.concat(F.lit("WJTB_"), subject, F.lit("_SEG_"), (k % 12).cast("string"), F.lit("_Breathe"), (k % 6 + 1).cast("string"), F.lit(".set")))
        .otherwise(F.concat(F.lit("misc_"), subject, F.lit("_ekg_x.csv")))
    )
    folder = F.when(k % 4 == 0, "Data/raw/fnirs/").when(k % 4 == 1, "Data/convert/ECG/").when(k % 4 == 2, "Data/raw/my_eeg_files/").otherwise("Data/other/")
    return table(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"), F.concat(folder, name).alias("path"))


MARKERS_SQL = "mk AS (SELECT user_id AS subject, event_type AS device, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value FROM events)"
SIGNALS_SQL = """sig AS (SELECT vec_id // 50 AS recording, 'ch' || vec_id AS channel, CASE WHEN vec_id % 2 = 0 THEN 'hbo' ELSE 'hbr' END AS ch_type,
  'p' || (vec_id // 2) AS pair_base, CAST(i - 1 AS BIGINT) AS sample_idx, CAST(x AS DOUBLE) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
TRIGGER_SQL = "tr AS (SELECT l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount) - 1 AS i, round(l_discount * 50, 4) AS v FROM lineitem)"
FILES_SQL = """fn AS (SELECT id, name, folder || name AS path FROM (SELECT o_orderkey AS id,
  CASE o_orderkey % 5 WHEN 0 THEN 'sub-' || (o_custkey % 1000) || '_ses-' || (o_orderkey % 7) || '_task-rest_fnirs.snirf'
    WHEN 1 THEN '202511' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '_' || (o_orderkey % 9 + 1) || '.TXT'
    WHEN 2 THEN '202511' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'part' || (o_orderkey % 3 + 1) || '.acq'
    WHEN 3 THEN 'WJTB_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '_SEG_' || (o_orderkey % 12) || '_Breathe' || (o_orderkey % 6 + 1) || '.set'
    ELSE 'misc_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '_ekg_x.csv' END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'Data/raw/fnirs/' WHEN 1 THEN 'Data/convert/ECG/' WHEN 2 THEN 'Data/raw/my_eeg_files/' ELSE 'Data/other/' END AS folder FROM orders))"""
