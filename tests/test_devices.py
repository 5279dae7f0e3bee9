"""Files and summaries of a recording's devices."""

from __future__ import annotations

import random
import threading

from pyspark.sql import functions as F

from tempoweave.functions.times import fixed
from tempoweave.operators import devices


def test_numbers_round_from_their_binary_value(spark):
    """As in C and Python: ties of the decimal form go by the exact value, exact ties to even, and null stays null."""
    given = [1.0005, 1.0015, 2.0005, 0.0625, 0.1875, -0.0005, -0.0004, 123456.1235, 1e23, float("nan"), float("-inf"), None]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", fixed(F.col("x"), 3).alias("a"), fixed(F.col("x"), 3, "+").alias("b")).orderBy("i").collect()
    assert [r["a"] for r in out] == [None if x is None else f"{x:.3f}" for x in given]
    assert [r["b"] for r in out] == [None if x is None else f"{x:+.3f}" for x in given]
    assert out[0]["a"] == "1.000" and out[3]["a"] == "0.062" and out[4]["a"] == "0.188"


def test_crop_summary(spark):
    """Numbers at the rounding edge, and no report (not one with gaps) where a number is missing."""
    rows = [(1, "view", 1.0005, 9.0625, 0.0), (1, "click", 2.0005, 8.5, -1.0005), (2, "view", 1.0, 2.0, 0.0), (2, "click", None, 3.0, 0.5)]
    crops = spark.createDataFrame(rows, "subject long, device string, lo double, hi double, offset double").withColumn("reference", F.lit("view"))
    ends = crops.filter("device = 'view'").select("subject", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
    out = {r["subject"]: r["summary"] for r in devices.crop_summary(crops.join(ends, "subject"), ["subject"]).collect()}
    assert out[1].split("\n")[3:] == ["Reference (shortest): view", "  Range: 1.000 - 9.062s", "  Duration: 8.062s", "", "Devices processed:", "  click: CROP", "    Original: 2.001 - 8.500s", "    Cropped:  1.000 - 9.062s", "    Offset:   -1.000s", "  view: KEEP"]
    assert out[2] is None


def _looked_for(name, kind, paths):
    """The rule of `converted_files`, file by file."""
    if kind not in devices.CONVERTED or name is None:
        return None, False
    folder, end = devices.CONVERTED[kind]
    search = name.replace("_input", "_ecg") if kind == "ecg" and "_input" in name.lower() else name
    there = [(p, p.rsplit("/", 1)[1]) for p in paths if p.startswith(f"Data/convert/{folder}/")]
    exact = [p for p, f in there if f == search + end or (kind == "ecg" and f == search + ".csv")]
    fuzzy = [p for p, f in there if f.endswith(end) and (f.startswith(search) if kind == "ecg" else search in f)]
    built = f"Data/convert/{folder}/{search}" + ("_ecg.csv" if kind == "ecg" and search.endswith("_ecg") else end)
    return min(exact or fuzzy or [built]), bool(exact or fuzzy)


def test_converted_files_as_file_by_file(spark):
    """Short, empty, long, accented and repeated names, names with an ending in them, nested folders, files of other kinds."""
    rng = random.Random(7)
    word = lambda most: "".join(rng.choice("aab_é") for _ in range(rng.randint(0, most)))
    kinds = [*devices.CONVERTED, "gsr", None]
    asked = [(word(rng.choice((2, 6, 14))) + rng.choice(("", "", "_input", "_INPUT", "_ecg", ".vhdr")), rng.choice(kinds)) for _ in range(600)] + [(None, "eeg"), ("", "eeg"), ("", "ecg"), ("x" * 30, "fnirs")]
    stems = [n + word(4) if rng.random() < 0.3 else word(2) + n + word(3) for n, _ in asked if n] + ["", "b", "x" * 29, "y" + "x" * 30]
    paths = sorted({f"Data/convert/{rng.choice(('ECG', 'EEG', 'EEG/deep', 'fnirs', 'other'))}/{s}{rng.choice(('_ecg.csv', '.csv', '.vhdr', '.snirf', '.bak'))}" for s in stems for _ in range(2)} | {"Data/raw/EEG/aab.vhdr", "Data/convert/fnirs/" + "x" * 30 + "z.snirf"})
    got = devices.converted_files(spark.createDataFrame(asked, "name string, kind string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    key = lambda r: tuple("~" if x is None else str(x) for x in r)
    want = [(n, k, *_looked_for(n, k, paths)) for n, k in asked]
    assert sorted(((r["name"], r["kind"], r["path"], r["exists"]) for r in got), key=key) == sorted(want, key=key)
    assert 50 < sum(w[3] for w in want) < len(want) - 50


def test_converted_files_do_not_meet_each_device(spark):
    """100000 devices and as many files of one folder take seconds; comparing all pairs took minutes, and is stopped here."""
    ids = spark.range(100000).select(F.col("id").cast("string").alias("k"))
    asked = ids.select(F.concat(F.lit("sub-"), "k", F.lit("_x")).alias("name"), F.lit("eeg").alias("kind"))
    files = ids.select(F.concat(F.lit("Data/convert/EEG/a_sub-"), "k", F.lit("_x.vhdr")).alias("path"))
    spark.sparkContext.addJobTag("converted")
    stop = threading.Timer(60, spark.sparkContext.cancelJobsWithTag, ["converted"])
    stop.start()
    try:
        assert devices.converted_files(asked, files).filter(F.col("exists") & F.col("path").endswith(F.concat(F.lit("a_"), "name", F.lit(".vhdr")))).count() == 100000
    finally:
        stop.cancel()
        spark.sparkContext.removeJobTag("converted")
