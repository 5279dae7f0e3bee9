"""Spectra and filters against closed forms, range joins against brute force, streams against batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tempoweave import queries as core
from tempoweave.functions.scores import METRICS, metric_score, tier
from tempoweave.operators import markers, quality, spectral
from tempoweave.plans.range_join import band_join
from tempoweave.streaming.markers import clean_stream, edge_stream


def test_welch_finds_power_where_it_is():
    fs, n = 10.0, 4096
    t = np.arange(n) / fs
    x = 3 * np.sin(2 * np.pi * 1.25 * t)
    f, p = spectral.welch(x, fs)
    assert f[p.argmax()] == 1.25 and abs(np.trapezoid(p, f) - x.var()) < 0.1
    noise = np.random.default_rng(0).normal(size=20000)
    f, p = spectral.welch(noise, 1.0)
    assert abs(p[1:-1].mean() - 2) < 0.1  # white noise of variance 1 at one sample a second


def test_filters():
    fs, t = 4.0, np.arange(2000) / 4.0
    slow, middle, fast = (np.sin(2 * np.pi * f * t) for f in (0.001, 0.08, 1.0))
    for work in (spectral.iir_band, spectral.fir_band):
        y = work(5 + slow + middle + fast, fs, 0.01, 0.2)[400:-400]
        assert np.abs(y - middle[400:-400]).max() < 0.12
    assert spectral.filter_method(100, 4.0, 0.01) == "iir_butterworth_order4" and spectral.filter_method(100, 4.0, 0.05) == "fir_auto" and spectral.filter_method(2000, 4.0, 0.01) == "fir_auto"
    y = spectral.fft_resampled(np.sin(2 * np.pi * 3 * np.arange(64) / 64), 32)
    assert np.allclose(y, np.sin(2 * np.pi * 3 * np.arange(32) / 32))


def test_motion_repair():
    t = np.arange(600) / 4.0
    clean = np.sin(2 * np.pi * 0.05 * t)
    jump = clean + np.where(t > 70, 8.0, 0.0)
    fixed = spectral.tddr(jump, 4.0)
    assert fixed.std() < 0.5 * jump.std() and np.corrcoef(fixed, clean)[0, 1] > 0.8


def test_scores(spark):
    row = spark.range(1).select(metric_score(F.lit(0.1), "lower_better", 0.1, 3.0), metric_score(F.lit(9.0), "lower_better", 0.1, 3.0), metric_score(F.lit(5.5), "higher_better", 1.0, 10.0), metric_score(F.lit(-1.0), "pair_corr", 0, 0), metric_score(F.lit(0.0), "pair_corr", 0, 0), metric_score(F.lit(1.0), "var_ratio", 0, 0), metric_score(F.lit(4.0), "var_ratio", 0, 0), metric_score(F.lit(20.0), "band_metric", 0, 0), metric_score(F.lit(None).cast("double"), "lower_better", 0, 1), metric_score(F.lit(1.0), "?", 0, 1), tier(F.lit(0.7))).first()
    assert [x if isinstance(x, str) else round(x, 4) for x in row] == [1.0, 0.0, 0.5, 1.0, 0.5, 1.0, 0.0, 0.1, 0.0, 0.5, "good"]


def test_short_and_flat_channels(spark):
    rows = [(1, "a", "hbo", "p", i, 5.0) for i in range(20)] + [(1, "b", "hbr", "p", i, float(i % 3)) for i in range(20)] + [(1, "c", "hbo", "q", i, float(i)) for i in range(5)] + [(1, "c", "hbo", "q", 9, float("nan"))]
    signals = spark.createDataFrame(rows, "recording int, channel string, ch_type string, pair_base string, sample_idx long, x double")
    out = {r["channel"]: r for r in quality.comprehensive_assessment(signals, 4.0).collect()}
    assert out["a"]["bad_flat"] and out["b"]["bad_final"] and not out["b"]["bad_flat"]
    assert out["c"]["cv"] is None and out["c"]["bad_nan"] and out["c"]["hbo_hbr_corr"] is None and out["a"]["hbo_hbr_corr"] is None
    basic = {r["channel"]: r for r in quality.basic_assessment(signals).collect()}
    assert basic["a"]["bad_flat"] and basic["a"]["bad_final"] and basic["b"]["bad_final"]
    assert spectral.spectral_row(np.arange(5.0), 4.0)[0] != spectral.spectral_row(np.arange(5.0), 4.0)[0]


def test_band_join(spark):
    rng = np.random.default_rng(7)
    a, b = (rng.uniform(-20, 20, 60).round(2).tolist() for _ in range(2))
    left = spark.createDataFrame([(k % 2, x) for k, x in enumerate(a)], "k int, l double")
    right = spark.createDataFrame([(k % 2, x) for k, x in enumerate(b)], "k int, r double")
    out = sorted((r["k"], r["l"], r["r"]) for r in band_join(left, right, ["k"], left_t="l", right_t="r", band=1.5).collect())
    assert out == sorted((i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and abs(x - y) <= 1.5)


def test_streams(spark, tmp_path):
    rows = [(k % 2, t) for k in range(2) for t in (0.0, 0.3, 0.8, 2.0, 2.5, 4.0)]
    parts = [[r for r in rows if r[1] < 1], [r for r in rows if r[1] >= 1]]

    def run(name, parts, schema, work):
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / str(n)))
        out = []
        for n in range(len(parts)):  # one file a batch, in order
            out.append(str(tmp_path / name / str(n)))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        query = work(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        query.processAllAvailable()
        query.stop()
        return spark.sql(f"SELECT * FROM {name}").collect()

    out = run("cleaned", parts, "k long, t double", lambda s: clean_stream(s, ["k"]))
    batch = markers.clean_greedy(spark.createDataFrame(rows, "k long, t double"), ["k"]).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch))
    volts = [(1, i, v) for i, v in enumerate([1.0, 0.1, 0.0, 5.0, 5.1, 0.0])]
    out = run("edges", [volts[:4], volts[4:]], "s long, i long, v double", lambda s: edge_stream(s, ["s"], fs=1.0))
    batch = markers.edge_markers(spark.createDataFrame(volts, "s long, i long, v double"), ["s"], fs=1.0).collect()
    assert sorted(r["i"] for r in out) == sorted(r["i"] for r in batch)


def test_full_scores_hold_all_ten_metrics(spark):
    q, d = core.queries(), "/root/testdata/sf0.001"
    names = [m[0] for m in METRICS]
    parts = {(r["recording"], r["pair_base"]): r for r in q["metric_scores_full"](spark, d).collect()}
    scores = q["composite_score_full"](spark, d).collect()
    assert len(scores) == len(parts) > 0
    for r in scores:
        row = parts[r["recording"], r["pair_base"]]
        assert abs(r["composite_score"] - sum(row[n] * w for n, *_, w in METRICS)) < 5e-5
    assert {f"mean_{n}" for n in names[:7]} <= set(q["quality_run_summary_full"](spark, d).columns)


def test_gaps_keep_places(spark):
    """Samples keep their places over a gap, and what is far from it is as without one."""
    x = np.sin(np.arange(200) / 9.0)
    whole = spark.createDataFrame([(0, "c", i, float(v)) for i, v in enumerate(x)], "recording long, channel string, sample_idx long, x double")
    gap = whole.filter("sample_idx NOT BETWEEN 100 AND 109")
    for work in (lambda s: spectral.smart_filter(s, ["recording", "channel"], 4.0, 0.05, 0.5), lambda s: spectral.motion_repair(s, ["recording", "channel"], 4.0)):
        full, left = ({r["sample_idx"]: r["x"] for r in work(s).collect()} for s in (whole, gap))
        assert set(left) == set(range(200)) - set(range(100, 110))
    half = {r["sample_idx"] for r in spectral.fft_resample(gap, ["recording", "channel"], 4.0, 2.0).collect()}
    assert half == set(range(100))


def test_last_channel_of_a_type_pairs(spark):
    rows = [(1, c, k, "p", i, v * (i % 5)) for c, k, v in (("c9", "hbo", 1.0), ("c10", "hbo", -1.0), ("c2", "hbr", 1.0)) for i in range(20)]
    signals = spark.createDataFrame(rows, "recording long, channel string, ch_type string, pair_base string, sample_idx long, x double")
    assert quality.haemoglobin_pairs(signals.select("recording", "channel", "ch_type", "pair_base").distinct()).first()["hbo"] == "c10"
    assert quality.pair_metrics(signals).first()["hbo_hbr_corr"] < -0.99
