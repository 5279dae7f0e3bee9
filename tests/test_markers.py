"""Exact cases of marker cleaning, edges, drift, crops and text scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoweave.functions import naming, times
from tempoweave.operators import crop, drift, markers, matching
from tempoweave.sources import sinks, text_scans


def _times(spark, values, key="a"):
    return spark.createDataFrame([(key, v) for v in values], "k string, t double")


def _kept(spark, values, gap):
    return sorted(r["t"] for r in markers.clean_greedy(_times(spark, values), ["k"], min_interval=gap).collect())


def test_greedy_cleaning(spark):
    assert _kept(spark, [0.0, 0.3, 0.8, 2.0, 2.5, 4.0], 1.0) == [0.0, 2.0, 4.0]
    assert _kept(spark, [5.0, 1.0, 3.0, 2.0, 4.0], 0.5) == [1.0, 2.0, 3.0, 4.0, 5.0]
    values = sorted(np.random.default_rng(1).uniform(0, 50, 200).round(3).tolist())
    once = _kept(spark, values, 0.7)
    assert min(np.diff(once)) >= 0.7 and _kept(spark, once, 0.7) == once


def test_cleaning_status(spark):
    rows = [("few", 1.0), ("few", 9.0), ("null", None), ("null", None), ("null", None), ("near", 1.0), ("near", 1.1), ("near", 1.2), ("ok", 1.0), ("ok", 3.0), ("ok", 5.0)]
    out = markers.clean_status(spark.createDataFrame(rows, "k string, t double"), ["k"], min_rows=3)
    assert {r["k"]: r["status"] for r in out.collect()} == {"few": "deleted_too_few_rows", "null": "deleted_invalid_time", "near": "deleted_after_clean", "ok": "cleaned"}


def test_edges(spark):
    volts = [1.0] * 3 + [5.0] * 3 + [0.1] * 2 + [4.9]
    out = markers.edge_markers(spark.createDataFrame([(1, i, v) for i, v in enumerate(volts)], "s int, i long, v double"), ["s"], fs=1.0)
    assert sorted(r["i"] for r in out.collect()) == [0, 1, 2, 3, 6, 8]  # out-of-band samples always count


def test_drift_directions(spark):
    ref = [0.0, 10.0, 20.0, 30.0]
    dev = [1.01 * t + 2 for t in ref]
    row = drift.drift_endpoints(_times(spark, ref), _times(spark, dev), ["k"]).first()
    assert row["scale"] == pytest.approx(1 / 1.01) and row["offset"] == pytest.approx(-2 / 1.01) and row["n_matches"] == 2
    line = F.lit(row["offset"]), F.lit(row["scale"])
    out = _times(spark, dev).select(drift.corrected(F.col("t"), *line).alias("r"), drift.corrected(F.col("t"), *line, convention="forward").alias("f")).collect()
    assert [round(r["f"], 6) for r in out] == ref
    assert [round(r["r"], 2) for r in out] == [4.02, 14.22, 24.42, 34.62]
    offset, scale, fit = drift.robust_line(np.array([2 + 1.5 * x for x in range(9)] + [90.0]), np.arange(10.0))
    assert scale == pytest.approx(1.5, abs=0.2) and 0 <= fit <= 1
    with pytest.raises(ValueError):
        drift.corrected(F.lit(1.0), *line, convention="other")


def _best(a, b, band=None):
    """All assignments by brute force: (pairs, cost)."""
    from itertools import combinations, permutations

    if len(a) > len(b):
        a, b = b, a
    top = (0, 0.0)
    for size in range(1, len(a) + 1):
        for rows in combinations(range(len(a)), size):
            for columns in permutations(range(len(b)), size):
                d = [abs(a[i] - b[j]) for i, j in zip(rows, columns, strict=True)]
                if band is None or max(d) <= band:
                    cost = sum(d) if band is None else sum(int(x * 1000) for x in d)
                    top = min(top, (-size, cost))
    return -top[0], top[1]


def test_assignments_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(120):
        a, b = (np.sort(rng.uniform(0, 6, rng.integers(1, 5)).round(3)) for _ in range(2))
        i, j = matching.assign_all(a, b)
        assert len(i) == min(len(a), len(b)) and abs(np.abs(a[i] - b[j]).sum() - _best(a, b)[1]) < 1e-9
        i, j = matching.assign_most(a, b, 1.0)
        size, cost = _best(a, b, 1.0)
        assert len(i) == size and abs(sum(int(x * 1000) for x in np.abs(a[i] - b[j])) - cost) <= size


def test_matches(spark):
    a, b = np.array([1.0, 2, 3, 10]), np.array([1.1, 2.1, 100, 100.5])
    assert len(matching.match_hungarian(a, b)[0]) == 2
    assert len(matching.match_flow(a, b)[0]) == 2
    assert len(matching.match_hungarian(np.array([1.0, 2, 3]), np.array([100.0, 101, 102]), band=1.0)[0]) == 0
    i, j, c = matching.match_sinkhorn(np.array([1.0, 2, 3, 4]), np.array([1.0, 2, 3, 4]))
    assert i.tolist() == j.tolist() == [0, 1, 2, 3] and c.min() > 0.9
    rows = [(1, "x", t) for t in (5.0, 10.0, 15.0)] + [(1, "y", t + 0.15) for t in (5.0, 10.0, 15.0)] + [(1, "z", t + 0.3) for t in (5.0, 10.0, 15.0, 40.0)]
    out = matching.consensus_timeline(spark.createDataFrame(rows, "subject int, device string, t double"), ["subject"], ["x", "y", "z"], drift=None)
    got = out.select("cons_id", "confidence").distinct().orderBy("cons_id").collect()
    assert len(got) == 4 and all(1 <= r["confidence"] <= 3 for r in got) and got[3]["confidence"] == 1
    assert matching.wide_timeline(out, ["subject"], ["x", "y", "z"]).count() == 4
    with pytest.raises(ValueError):
        matching.match_events(_times(spark, [1.0]), _times(spark, [1.0]), ["k"], method="other")


def test_crops(spark):
    rows = spark.createDataFrame([("r", i, i / 10) for i in range(50)], "k string, i long, t double").withColumn("start", F.lit(1.0)).withColumn("end", F.lit(2.0)).withColumn("offset", F.lit(0.0)).withColumn("sfreq", F.lit(10.0))
    assert crop.crop_closed(rows, ["k"]).count() == 11
    assert crop.crop_by_index(rows, ["k"]).count() == 10
    assert crop.crop_half_open(rows, ["k"]).agg(F.count("t"), F.min("t")).first()[:] == (10, 0.0)
    assert crop.crop_half_open(rows.withColumn("start", F.lit(90.0)).withColumn("end", F.lit(99.0)), ["k"]).count() == 50


def test_names_and_times(spark):
    names = spark.createDataFrame([("sub-60_ses-1_task-rest_x_fnirs.csv",), ("20250516017part1.acq",), ("WJTB_060_SEG_08_Breathe3.set",), ("060_x.csv",), ("a_123_SEG_4_b.csv",), ("sub-12345_ses-1_task-a_eeg.set",)], "n string")
    out = [tuple(r["p"]) for r in names.select(naming.parsed_name(F.col("n")).alias("p")).collect()]
    assert out[0] == ("060", "ses-01", "01", None, "bids", "fnirs") and out[1][:3] == ("017", "20250516", "01") and out[2][:4] == ("060", "WJTB", "08", "WJTB")
    assert out[3][4] == "subject_only" and out[4][:3] == ("123", "unknown", "04") and out[5][0] == "12345"
    bids = names.select(naming.bids_name(F.col("n")).alias("b")).collect()
    assert bids[1]["b"] == "sub-017_ses-01_task-rest_ecg" and bids[2]["b"] == "sub-060_ses-08_task-breathe_eeg" and bids[0]["b"] is None
    row = spark.range(1).select(times.iso_date(F.lit("2024/2/30")), times.iso_date(F.lit("2024-2-9 x")), times.iso_time(F.lit("7:5:3.25")), times.iso_time(F.lit("070503")), times.iso_time(F.lit("27:00:00")), times.hms_seconds(F.lit("1:02:03.5")), times.hms_seconds(F.lit("1:02"))).first()
    assert tuple(row) == ("unknown", "2024-02-09", "07:05:03.25Z", "07:05:03Z", "unknown", 3723.5, None)
    specs = spark.createDataFrame([("[1, 2.5]",), ('{"a": 1.5}',), ("1.5, ,-2",), ("a:1",)], "s string").select(times.offset_list(F.col("s")).alias("o"), times.offset_map(F.col("s")).alias("m")).collect()
    assert [r["o"] for r in specs] == [[1.0, 2.5], [1.5], [1.5, -2.0], None] and specs[3]["m"] == {"a": 1.0}


EXPORT = "\n".join(
    ["[Data Line]\t12", "Measured Date\t2024/3/5 9:08:07", "ID\tS01", "Name\tAb", "Total Points\t3", "Output Mode\tx Data Type Hb", "Time Range\t0.0\t0.2", "[Text Info.]", "(1,1)(2,1)", "", "Time(sec)\tTask\tMark\tCount\toxyHb\tdeoxyHb\ttotalHb\toxyHb\tdeoxyHb\ttotalHb"]
    + [f"{k / 10}\t0\t{m}\t{k}\t" + "\t".join(str(k + j) for j in range(6 if k else 4)) for k, m in enumerate(("1", "0Z", "2"))]
)


def test_fnirs_export(spark):
    texts = spark.createDataFrame([("a.txt", EXPORT)], "path string, text string")
    head = text_scans.fnirs_headers(texts).first()
    assert (head["data_start"], head["subject_id"], head["date"], head["time"], head["data_type"], head["total_points"]) == (11, "S01", "2024-03-05", "09:08:07Z", "Hb", 3)
    body = text_scans.fnirs_body(texts).orderBy("row").collect()
    assert len(body) == 3 and body[0]["signals"] == [0.0, 1.0, 2.0, 3.0, None, None] and body[2]["mark"] == "2"
    tables = sinks.snirf_tables(texts)
    assert tables["channel"].count() == 6 and tables["sample"].count() == 18
    assert sorted(r["name"] for r in tables["stim"].collect()) == ["Mark_1", "Mark_2"] and tables["aux"].count() == 3
    moved = sinks.without_total(tables)
    assert moved["channel"].count() == 4 and {r["name"] for r in moved["aux"].collect()} == {"COUNT", "HbT_1", "HbT_2"}


def test_other_scans(spark, tmp_path):
    (tmp_path / "x.vhdr").write_text("[Common Infos]\nSamplingInterval=5000\n")
    (tmp_path / "x.vmrk").write_text("Mk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,1001,1,0\nMk3=Stimulus,S 2\nMk4=Stimulus,S 3,x,1,0\n")
    read = lambda suffix: text_scans.whole_texts(spark, str(tmp_path / f"*.{suffix}"))
    out = markers.vmrk_markers(text_scans.vmrk_lines(read("vmrk"), read("vhdr"))).collect()
    assert [(r["reference_time"], r["value"]) for r in out] == [(5.0, "S  1")]
    (tmp_path / "p.csv").write_text("﻿junk\nStart Time,Protocol Type,Other\n00:00:05.00,TaskA,1\n00:00:10.50,,2\nbad,Rest,3\n", encoding="utf-8")
    out = text_scans.protocol_markers(read("csv")).collect()
    assert [(r["reference_time"], r["value"]) for r in out] == [(5.0, "TaskA")]
    rows = spark.createDataFrame([("m.csv", "value,Time(sec),time\na,2.5,9\nb,x,8\n"), ("n.csv", "value\na\n")], "path string, text string")
    out = text_scans.marker_rows(rows).orderBy("path", "row").collect()
    assert [(r["t"], r["value"], r["status"]) for r in out] == [(2.5, "a", None), (None, "b", None), (None, "a", "missing_time_col")]
    place = spark.createDataFrame([("o", 1, "t1", 1.0), ("o", 2, "R1", 2.0), ("o", 3, "T12", 3.0)], "path string, line_no int, Label string, X double")
    assert [(r["num"], r["idx"]) for r in text_scans.optodes(place, "T").orderBy("idx").collect()] == [(1, 1), (12, 2)]
    (tmp_path / "._hidden.csv").write_text("x")
    assert {r["file_name"] for r in text_scans.scan_folder(spark, str(tmp_path)).collect()} == {"x.vhdr", "p.csv"}


def test_median_slope_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 40, 90):
        for values in (rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float)):
            dev = np.sort(rng.integers(0, 50, n).astype(float))
            i, j = np.triu_indices(n, 1)
            use = dev[j] != dev[i]
            want = np.median((values[j] - values[i])[use] / (dev[j] - dev[i])[use]) if use.any() else 1.0
            for held in (1 << 22, 60, 8):
                monkeypatch.setattr(drift, "PAIRS", held)
                assert drift._median_slope(values, dev) == pytest.approx(want, abs=1e-12)


def test_assignment_in_bands(monkeypatch):
    """The choices of long series are kept in blocks of rows; the result is the same."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (np.sort(rng.choice(200, rng.integers(0, 40), replace=False) / 4.0) for _ in range(2))
        whole = matching.assign_all(a, b), matching.assign_most(a, b, 2.0)
        monkeypatch.setattr(matching, "CELLS", 64)
        parts = matching.assign_all(a, b), matching.assign_most(a, b, 2.0)
        monkeypatch.setattr(matching, "CELLS", 1 << 26)
        assert all((x == y).all() for w, p in zip(whole, parts, strict=True) for x, y in zip(w, p, strict=True))
