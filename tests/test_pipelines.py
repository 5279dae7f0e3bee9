"""The jobs behind the command line, from files to written results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoweave import cli
from tempoweave.plans import pipelines as jobs
from tempoweave.sources import text_scans
from tests.test_markers import EXPORT


def test_marker_jobs(spark, tmp_path):
    src = tmp_path / "marks"
    src.mkdir()
    (src / "a_marker.csv").write_text("reference_time,value\n" + "".join(f"{t},x\n" for t in (1.0, 1.2, 5, 9)))
    (src / "b_marker.csv").write_text("reference_time,value\n" + "".join(f"{t},x\n" for t in (1.1, 5.1, 9.1)))
    (src / "c_marker.csv").write_text("value\nx\n")
    status = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in jobs.clean_markers(spark, str(src), str(tmp_path / "clean")).collect()}
    assert status == {"a_marker.csv": "cleaned", "b_marker.csv": "cleaned", "c_marker.csv": "missing_time_col"}
    written = spark.read.option("header", "true").csv(str(tmp_path / "clean"))
    assert written.count() == 6 and {(r["file"], r["value"]) for r in written.collect()} == {("a_marker.csv", "x"), ("b_marker.csv", "x")}
    (src / "deep").mkdir()
    (src / "deep" / "a_marker.csv").write_text('"note, quoted",reference_time\n' + "".join(f'"n, {t}",{t}\n' for t in (2.0, 4.0, 4.5)))
    jobs.clean_markers(spark, str(src), str(tmp_path / "again"))
    deep = spark.read.option("header", "true").csv(str(tmp_path / "again" / "file=deep%2Fa_marker.csv")).collect()
    assert [(r["note, quoted"], r["reference_time"]) for r in deep] == [("n, 2.0", "2.0"), ("n, 4.0", "4.0")]
    (src / "deep" / "a_marker.csv").unlink()
    series = jobs.marker_series(spark, [str(src / "a_marker.csv"), str(src / "b_marker.csv")])
    wide, meta = jobs.match_devices(series, ["a", "b"], str(tmp_path / "match"), drift=None)
    assert wide.count() == 4 and meta.first()["n_devices"] == 2
    drifts = spark.createDataFrame([("a", 0.0, 1.0, "x"), ("b", 0.0, 1.0, "x")], "device string, offset double, scale double, method string")
    changes = spark.createDataFrame([("b", 0.1)], "device string, change double")
    wide, report = jobs.rematch_with_offsets(series, drifts, changes, ["a", "b"])
    assert {r["device"]: r["change"] for r in report.collect()} == {"a": 0.0, "b": 0.1}
    assert wide.filter("abs(a_time - b_time) < 1e-9").count() == 3
    with pytest.raises(ValueError):
        jobs.match_devices(series, ["a"])
    data = tmp_path / "Data" / "raw" / "ecg"
    data.mkdir(parents=True)
    (data / "a.csv").write_text("x")
    (data / "20251101060part1.acq").write_text("x")
    rows = {r["file_name"]: r for r in jobs.marker_inventory(spark, str(tmp_path / "Data"), str(src)).collect()}
    assert rows["a.csv"]["n_markers"] == 4 and rows["a.csv"]["device"] == "ecg" and rows["b_marker.csv"]["n_markers"] == 3
    names = spark.createDataFrame([(f"d/{n}",) for n in ("20251101060part1.acq", "20251102060part1.acq", "other.csv")], "path string")
    assert sorted(r["new_name"] for r in jobs.bids_renames(names).collect()) == ["sub-060_ses-01_task-rest_ecg.acq", "sub-060_ses-01_task-rest_ecg_1.acq"]


def test_crops_by_metadata(spark):
    """The consensus range and each device's own drift decide; the reference stays whole."""
    times = {"a": [0.0, 10.0, 20.0, 30.0], "b": [5.0, 15.0, 25.0, 35.0]}
    series = spark.createDataFrame([(1, d, t) for d, own in times.items() for t in own], "subject long, device string, t double")
    _, meta = jobs.match_devices(series, ["a", "b"], drift="linear")
    row = meta.first()
    assert row["drift_by_device"]["a"]["method"] == "reference" and row["drift_by_device"]["b"]["offset"] == -5.0 and (row["lo"], row["hi"]) == (0.0, 40.0)
    samples = spark.createDataFrame([(1, d, f"{d}.csv", i, float(i), 1.0) for d in "ab" for i in range(60)] + [(2, "a", "x.csv", 0, 0.0, 1.0)], "subject long, device string, file_name string, i long, t double, x double")
    cut = jobs.crop_with_metadata(samples, "ecg", meta, reference="a").groupBy("device").agg(F.count("t").alias("n"), F.min("t").alias("lo")).collect()
    assert {r["device"]: (r["n"], r["lo"]) for r in cut} == {"a": (60, 0.0), "b": (41, 0.0)}
    assert jobs.crop_with_metadata(samples, "fnirs", meta).filter("device = 'a'").count() == 40
    with pytest.raises(ValueError):
        jobs.crop_with_metadata(samples, "x", meta)


def test_encodings(spark, tmp_path):
    (tmp_path / "a_marker.csv").write_bytes("reference_time,value\n1.0,时间\n3.0,y\n".encode("gbk"))
    (tmp_path / "b_marker.csv").write_bytes(b"\xef\xbb\xbfreference_time,value\n1.0,x\n3.0,y\n")
    (tmp_path / "c_marker.csv").write_bytes(b"reference_time,value\n")
    status = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["n_kept"]) for r in jobs.clean_markers(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert status == {"a_marker.csv": ("cleaned", 2), "b_marker.csv": ("cleaned", 2), "c_marker.csv": ("deleted_empty", 0)}


def test_wide_samples(spark):
    rows = spark.createDataFrame([("a", "x,\"y, z\"\n1,2\n3,bad"), ("b", "1,2\n3,4")], "path string, text string")
    out = {(r["path"], r["sample_idx"], r["channel"]): r["x"] for r in text_scans.wide_samples(rows).collect()}
    assert out == {("a", 0, "x"): 1.0, ("a", 0, "y, z"): 2.0, ("a", 1, "x"): 3.0, ("a", 1, "y, z"): None, ("b", 0, "ch1"): 1.0, ("b", 0, "ch2"): 2.0, ("b", 1, "ch1"): 3.0, ("b", 1, "ch2"): 4.0}


def test_fnirs_to_quality(spark, tmp_path):
    rng, rows = np.random.default_rng(1), 200
    head, _ = EXPORT.split("\n0.0\t", 1)
    body = [f"{k / 4}\t0\t0\t{k}\t" + "\t".join(f"{v:.4f}" for v in rng.normal(10, 1, 6)) for k in range(rows)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.txt").write_text(head + "\n" + "\n".join(body))
    (tmp_path / "src.csv").write_text("Label,X,Y,Z\nT1,0,0,0\nT2,1,0,0\n")
    tables = jobs.convert_fnirs(spark, str(tmp_path / "in"), str(tmp_path / "out"), sources=str(tmp_path / "src.csv"))
    assert tables["source"].count() == 2 and spark.read.parquet(str(tmp_path / "out" / "sample")).count() == 4 * rows
    out = jobs.assess(jobs.table_signals({n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("channel", "sample")}), 4.0)
    assert out["pre"].count() == out["post"].count() == 4 and out["pairs"].count() == 2
    run = out["runs"].first()
    assert run["n_channels"] == 4 and 0 <= run["run_score"] <= 1 and out["overall"].count() == 4
    assert jobs.plot_data(out, jobs.table_signals({n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("channel", "sample")}))["heatmap"].count() == 4
    jobs.write_all({"runs": out["runs"]}, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q" / "runs")).count() == 1


def test_ecg_and_crops(spark, tmp_path):
    rows = spark.createDataFrame([(c, i, float(i)) for c in ("ECG 1", "Input 2") for i in range(100)], "channel string, sample_idx long, x double")
    out = jobs.convert_ecg(rows, 100.0, str(tmp_path / "ecg"), "rec_ecg", target=50.0)
    assert out.count() == 100 and {r["group"] for r in out.collect()} == {"ecg", "input"}
    assert (tmp_path / "ecg" / "rec_ecg.csv").exists() and (tmp_path / "ecg" / "rec_input.csv").exists()
    samples = spark.createDataFrame([("sub-001_ses-01_task-rest_ecg.csv", i, i / 10, 1.0) for i in range(100)], "file_name string, i long, t double, x double")
    offsets = spark.createDataFrame([("sub-001_ses-01_task-rest_ecg.csv", 1.0, 10.0)], "file_name string, offset double, sfreq double")
    cut = jobs.crop_recordings(samples, "ecg", 3.0, 4.0, offsets, task="film")
    assert cut.agg(F.count("t"), F.min("t")).first()[0] == 11 and cut.first()["file_name"] == "sub-001_ses-01_task-film_ecg.csv"
    assert jobs.crop_recordings(samples, "eeg", 3.0, 4.0, offsets).count() == 10
    with pytest.raises(ValueError):
        jobs.crop_recordings(samples, "ecg", 4.0, 4.0, offsets)
    assert jobs.convert_eeg(rows, ["channel"], 100.0, target=100.05) is rows
    assert jobs.convert_eeg(rows, ["channel"], 100.0, target=50.0).count() == 100


def test_command_line(capsys):
    for group in ("fnirs", "ecg", "eeg", "marker", "quality"):
        with pytest.raises(SystemExit) as end:
            cli.main([group, "--help"])
        assert end.value.code == 0
    with pytest.raises(SystemExit) as end:
        cli.main(["marker", "unknown"])
    assert end.value.code == 2
    capsys.readouterr()
