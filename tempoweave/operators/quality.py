"""Signal quality: statistics, gates, scores, and paradigm metrics.

signals: recording, channel, ch_type (hbo or hbr), pair_base, sample_idx, x.
Every statistic of a channel needs its samples together once; windows and
aggregates below share that one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.functions.scores import METRICS, metric_score, tier
from tempoweave.plans.range_join import range_join

KEYS = ["recording", "channel"]
EPS = 1e-8


def _finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x)


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    """Correlation of two columns that are null together; null without spread."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def time_metrics(signals: DataFrame, fs: float, *, keys: list[str] = KEYS) -> DataFrame:
    """Per channel: n, nan_ratio, near_flatline, range, cv, tsnr, rdi, drift, mad; null below 10 finite samples."""
    order, every = W.partitionBy(*keys).orderBy("sample_idx"), W.partitionBy(*keys)
    total = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    rows = signals.filter(_finite("x")).select(*keys, "sample_idx", "x")
    rows = rows.withColumn("k", (F.row_number().over(order) - 1) / F.lit(float(fs))).withColumn("dx", F.abs(F.col("x") - F.lag("x").over(order))).withColumn("middle", F.expr("percentile(x, 0.5)").over(every))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.expr("percentile(abs(x - middle), 0.5)").alias("mad"), F.expr("percentile(dx, 0.5)").alias("step"), _ratio(F.covar_samp("k", "x"), F.var_pop("k")).alias("slope"),
    )
    out = total.join(stats, keys, "left")
    enough = F.col("n") >= 10
    values = {
        "near_flatline": (F.col("hi") - F.col("lo") < 1e-6).cast("int"),
        "range": F.col("hi") - F.col("lo"),
        "cv": F.col("sigma") / (F.abs("mu") + EPS),
        "tsnr": F.abs("mu") / (F.col("sigma") + EPS),
        "rdi": F.col("step") / (F.col("mad") + EPS),
        "drift": F.abs(F.coalesce("slope", F.lit(0.0))) / (F.col("sigma") + EPS),
        "mad": F.col("mad"),
    }
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), (1 - F.coalesce("n", F.lit(0)) / F.col("n_all")).alias("nan_ratio"), *(F.when(enough, v).alias(k) for k, v in values.items()))


def _last(channels: DataFrame, kind: str, value: str) -> Column:
    """The value at the last channel of a type: by `position` where that is given, else by name, numbers in order."""
    place = F.struct("position") if "position" in channels.columns else F.struct(F.length("channel"), F.col("channel"))
    return F.max_by(F.when(F.col("ch_type") == kind, F.col(value)), F.when(F.col("ch_type") == kind, place))


def haemoglobin_pairs(channels: DataFrame) -> DataFrame:
    """recording, pair_base, hbo, hbr of bases with both types (of several channels of a type the last)."""
    sides = channels.groupBy("recording", "pair_base").agg(_last(channels, "hbo", "channel").alias("hbo"), _last(channels, "hbr", "channel").alias("hbr"))
    return sides.filter("hbo IS NOT NULL AND hbr IS NOT NULL")


def pair_metrics(signals: DataFrame) -> DataFrame:
    """Per pair: correlation, ratio of deviations and correlation of differences over jointly finite samples (of several channels of a type the last's); null below 10."""
    keys = ["recording", "pair_base"]
    rows = signals.filter(F.col("ch_type").isin("hbo", "hbr")).groupBy(*keys, "sample_idx").agg(_last(signals, "hbo", "x").alias("a"), _last(signals, "hbr", "x").alias("b")).filter(_finite("a") & _finite("b"))
    order = W.partitionBy(*keys).orderBy("sample_idx")
    rows = rows.withColumn("da", F.col("a") - F.lag("a").over(order)).withColumn("db", F.col("b") - F.lag("b").over(order))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), correlation("a", "b").alias("r"), correlation("da", "db").alias("dr"), F.stddev_pop("da").alias("sda"), F.stddev_pop("db").alias("sdb"))
    enough = F.col("n") >= 10
    return stats.select(
        *keys, "n",
        F.when(enough & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("r")).alias("hbo_hbr_corr"),
        F.when(enough, F.col("sa") / (F.col("sb") + EPS)).alias("hbo_hbr_var_ratio"),
        F.when((F.col("n") >= 11) & (F.col("sda") > 0) & (F.col("sdb") > 0), F.col("dr")).alias("hbo_hbr_deriv_corr"),
    )


def with_bad_pairs(channels: DataFrame, bad: str, out: str = "bad_final") -> DataFrame:
    """Adds whether a channel or its partner is bad (a channel without a base counts alone)."""
    paired = F.max(F.coalesce(F.col(bad), F.lit(False)).cast("int")).over(W.partitionBy("recording", "pair_base")) == 1
    return channels.withColumn(out, F.when(F.col("pair_base").isNotNull(), paired).otherwise(F.coalesce(F.col(bad), F.lit(False))))


def basic_assessment(signals: DataFrame) -> DataFrame:
    """Per channel: nan_ratio, std, mad, ptp, deriv_mad, deriv_std, hbo_hbr_corr, deriv_mad_robust_z and the flags bad_nan, bad_flat, bad_jump, bad_corr, bad_final."""
    keys = [*KEYS, "ch_type", "pair_base"]
    order, every = W.partitionBy(*KEYS).orderBy("sample_idx"), W.partitionBy(*KEYS)
    x = F.when(_finite("x"), F.col("x"))
    rows = signals.select(*keys, "sample_idx", x.alias("x")).withColumn("dx", F.col("x") - F.lag("x").over(order))
    rows = rows.withColumn("mx", F.expr("percentile(x, 0.5)").over(every)).withColumn("md", F.expr("percentile(dx, 0.5)").over(every))
    stats = rows.groupBy(*keys).agg(
        (1 - F.count("x") / F.count(F.lit(1))).alias("nan_ratio"), F.stddev_pop("x").alias("std"), F.expr("percentile(abs(x - mx), 0.5)").alias("mad"), (F.max("x") - F.min("x")).alias("ptp"),
        F.expr("percentile(abs(dx - md), 0.5)").alias("deriv_mad"), F.stddev_pop("dx").alias("deriv_std"),
    )
    both = signals.filter(_finite("x")).groupBy("recording", "pair_base", "sample_idx").agg(F.max(F.when(F.col("ch_type") == "hbo", F.col("x"))).alias("a"), F.max(F.when(F.col("ch_type") == "hbr", F.col("x"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    corr = both.groupBy("recording", "pair_base").agg(F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), correlation("a", "b")).alias("hbo_hbr_corr"))
    run = W.partitionBy("recording")
    out = stats.join(corr, ["recording", "pair_base"], "left").withColumn("middle", F.expr("percentile(deriv_mad, 0.5)").over(run)).withColumn("spread", F.expr("percentile(abs(deriv_mad - middle), 0.5)").over(run))
    z = F.when(F.col("spread") > 0, 0.6745 * (F.col("deriv_mad") - F.col("middle")) / F.nullif(F.col("spread"), F.lit(0.0)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("deriv_mad_robust_z", z).withColumn("bad_nan", flag(F.col("nan_ratio") > 0.05)).withColumn("bad_flat", flag(F.col("std") < 1e-8)).withColumn("bad_jump", flag(F.col("deriv_mad_robust_z") > 5)).withColumn("bad_corr", flag(F.col("hbo_hbr_corr") > 0.3))
    out = out.withColumn("bad_any", F.col("bad_nan") | F.col("bad_flat") | F.col("bad_jump") | F.col("bad_corr"))
    return with_bad_pairs(out, "bad_any").drop("middle", "spread")


def comprehensive_assessment(signals: DataFrame, fs: float, spectral: DataFrame | None = None) -> DataFrame:
    """Per channel the time metrics, spectral ones if given (recording, channel, ...), the pair metrics, and the hard gates."""
    names = signals.select(*KEYS, "ch_type", "pair_base").distinct()
    out = names.join(time_metrics(signals, fs), KEYS)
    if spectral is not None:
        out = out.join(spectral, KEYS, "left")
    out = out.join(pair_metrics(signals).drop("n"), ["recording", "pair_base"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("bad_flat", flag(F.col("near_flatline") == 1)).withColumn("bad_cv", flag(F.col("cv") > 5)).withColumn("bad_rdi", flag(F.col("rdi") > 10)).withColumn("bad_nan", flag(F.col("nan_ratio") > 0.05))
    out = out.withColumn("bad_hard", F.col("bad_flat") | F.col("bad_cv") | F.col("bad_rdi") | F.col("bad_nan"))
    return with_bad_pairs(out, "bad_hard")


def run_summary(assessed: DataFrame, metrics: list[str]) -> DataFrame:
    """Per recording the numbers of channels and bad ones, and mean and median of each metric."""
    return assessed.groupBy("recording").agg(
        F.count(F.lit(1)).alias("n_channels"), F.sum((F.col("ch_type") == "hbo").cast("int")).alias("n_hbo"), F.sum((F.col("ch_type") == "hbr").cast("int")).alias("n_hbr"),
        F.sum(F.col("bad_final").cast("int")).alias("n_bad_channels"), F.avg(F.col("bad_final").cast("double")).alias("bad_channel_fraction"),
        *(F.avg(m).alias(f"mean_{m}") for m in metrics), *(F.expr(f"percentile({m}, 0.5)").alias(f"median_{m}") for m in metrics),
    )


def composite_scores(assessed: DataFrame, metrics: tuple = METRICS) -> DataFrame:
    """Per complete pair the weighted mean of its scores: those of the channels' metrics averaged over both, and of the pair's own."""
    own = {"pair_corr": "hbo_hbr_corr", "var_ratio": "hbo_hbr_var_ratio", "deriv_pair": "hbo_hbr_deriv_corr"}
    scored = assessed.filter(F.col("ch_type").isin("hbo", "hbr"))
    by = scored.groupBy("recording", "pair_base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ch_type").alias("types"), *(F.avg(metric_score(F.col(own.get(name, name)), kind, low, high)).alias(name) for name, kind, low, high, _ in metrics))
    total = sum(w for *_, w in metrics)
    score = sum((F.col(name) * w for name, *_, w in metrics), F.lit(0.0)) / total
    out = by.filter("n = 2 AND types = 2").withColumn("composite_score", score)
    return out.select("recording", "pair_base", *(m[0] for m in metrics), "composite_score", tier(F.col("composite_score")).alias("quality_tier"))


def run_scores(pairs: DataFrame, *, trim: float = 0.1) -> DataFrame:
    """Per recording the mean of its pairs' scores without the extremes on either side."""
    order = W.partitionBy("recording").orderBy("composite_score", "pair_base")
    rows = pairs.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("recording"))).withColumn("cut", F.floor(F.col("n") * trim))
    kept = rows.filter("k > cut AND k <= n - cut OR 2 * cut >= n")
    out = kept.groupBy("recording").agg(F.avg("composite_score").alias("run_score"), F.first("n").alias("n_channels_scored"))
    return out.select("recording", "run_score", tier(F.col("run_score")).alias("run_tier"), "n_channels_scored")


def channel_scores(assessed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """1 for a good channel, 0 for a bad one, and the recording's share of good ones; where filtering leaves no bad channel, those from before it count."""
    keys, bad = ["recording", "channel"], F.col("bad_final")
    rows = assessed.select(*keys, "bad_final")
    if before is not None:
        rows = rows.join(before.select(*keys, F.col("bad_final").alias("bad_before")), keys, "left")
        bad = F.when(F.max("bad_final").over(W.partitionBy("recording")), bad).otherwise(F.coalesce("bad_before", F.lit(False)))
    good = (~F.col("bad")).cast("double")
    return rows.withColumn("bad", bad).select(*keys, good.alias("channel_score"), F.avg(good).over(W.partitionBy("recording")).alias("overall_score"))


def best_pairs(assessed: DataFrame, *, share: float = 0.05) -> DataFrame:
    """Per recording the best pairs (at least one) by mean tSNR among those with two good channels."""
    pairs = assessed.groupBy("recording", "pair_base").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("bad_final").cast("int")).alias("bad"), F.when(F.count("tsnr") == F.count(F.lit(1)), F.avg("tsnr")).otherwise(0.0).alias("score"))
    pairs = pairs.filter("n = 2 AND bad = 0")
    nth = F.row_number().over(W.partitionBy("recording").orderBy(F.desc("score"), "pair_base"))
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(W.partitionBy("recording")) * share))
    return pairs.withColumn("place", nth).withColumn("most", most).filter("place <= most").select("recording", "pair_base", "score", F.col("place").cast("long").alias("place"))


def task_events(signals: DataFrame, events: DataFrame, fs: float, artifacts: DataFrame | None = None, *, baseline: float = 5.0, response: float = 10.0, tau_cnr: float = 0.5, tau_drift: float = 0.1) -> DataFrame:
    """Per recording, pair and event: cnr_hbo, cnr_hbr and good.

    events: recording, event, onset; artifacts: recording, start, end (seconds).  Windows are clipped to the recording; one of fewer than 3 samples makes the event bad, with null contrasts.
    """
    sizes = signals.groupBy("recording").agg((F.max("sample_idx") + 1).alias("n"))
    at = F.bround(F.col("onset") * fs, 0).cast("long")
    spans = events.join(sizes, "recording").withColumn("o", at)
    spans = spans.select("recording", "event", "o", F.greatest(F.lit(0), F.col("o") - round(baseline * fs)).alias("b0"), F.least("n", "o").alias("b1"), F.least(F.col("n"), F.col("o") + round(response * fs)).alias("r1"))
    small = (F.col("b1") - F.col("b0") < 3) | (F.col("r1") - F.col("o") < 3)
    spans = spans.withColumn("small", small).withColumn("first", F.col("b0")).withColumn("last", F.col("r1") - 1)
    rows = range_join(signals.filter(F.col("pair_base").isNotNull()).select("recording", "pair_base", "ch_type", "sample_idx", "x"), spans.filter("NOT small"), ["recording"], point="sample_idx", low="first", high="last", width=float(max(1, round((baseline + response) * fs))))
    before = F.when(F.col("sample_idx") < F.col("b1"), F.col("x"))
    after = F.when(F.col("sample_idx") >= F.col("o"), F.col("x"))
    k = F.when(F.col("sample_idx") < F.col("b1"), (F.col("sample_idx") - F.col("b0")) / fs)
    per = rows.groupBy("recording", "event", "pair_base", "ch_type").agg((F.abs(F.avg(before) - F.avg(after)) / F.sqrt(F.var_pop(before) + F.var_pop(after) + EPS)).alias("cnr"), F.abs(_ratio(F.covar_samp(k, before), F.var_pop(k))).alias("slope"))
    both = per.groupBy("recording", "event", "pair_base").agg(*(F.max(F.when(F.col("ch_type") == c, F.col(v))).alias(f"{v}_{c}") for v in ("cnr", "slope") for c in ("hbo", "hbr")))
    every = spans.select("recording", "event", "b0", "r1", "small").join(signals.filter(F.col("pair_base").isNotNull()).select("recording", "pair_base").distinct(), "recording")
    out = every.join(both, ["recording", "event", "pair_base"], "left")
    hit = F.lit(False)
    if artifacts is not None:
        marks = artifacts.select("recording", F.bround(F.col("start") * fs, 0).alias("a0"), F.bround(F.col("end") * fs, 0).alias("a1"))
        met = spans.join(marks, "recording").filter("NOT (a1 < b0 OR a0 > r1)").select("recording", "event").distinct().withColumn("hit", F.lit(True))
        out, hit = out.join(met, ["recording", "event"], "left"), F.coalesce(F.col("hit"), F.lit(False))
    weak = (F.col("cnr_hbo") < tau_cnr) & (F.col("cnr_hbr") < tau_cnr)
    steep = (F.col("slope_hbo") > tau_drift) | (F.col("slope_hbr") > tau_drift)
    good = ~F.col("small") & ~F.coalesce(weak, F.lit(False)) & ~F.coalesce(steep, F.lit(False)) & ~hit
    return out.select("recording", "event", "pair_base", "cnr_hbo", "cnr_hbr", good.alias("good"))


def task_metrics(per_event: DataFrame) -> DataFrame:
    """Per recording and pair the median contrasts, the share of good events and their number."""
    return per_event.groupBy("recording", "pair_base").agg(F.expr("percentile(cnr_hbo, 0.5)").alias("median_cnr_hbo"), F.expr("percentile(cnr_hbr, 0.5)").alias("median_cnr_hbr"), F.avg(F.col("good").cast("double")).alias("good_event_fraction"), F.count(F.lit(1)).alias("n_events"))


def _reliability(data: np.ndarray) -> float:
    """Correlation of the two halves' channel correlations; NaN below three pairs of channels or without spread."""
    half = data.shape[1] // 2
    with np.errstate(all="ignore"):
        upper = np.triu_indices(len(data), 1)
        a, b = (np.clip(np.nan_to_num(np.corrcoef(h)[upper]), -1, 1) for h in (data[:, :half], data[:, half:]))
    return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and a.std() and b.std() else np.nan


def resting_metrics(signals: DataFrame, bad_channels: DataFrame | None = None, bad_segments: DataFrame | None = None) -> DataFrame:
    """Per recording split_half_reliability_hbo and _hbr, mean_reliability and retained_duration_fraction.

    bad_channels: recording, channel; bad_segments: recording, start, end (sample indices, end exclusive).  Null with fewer than two channels or ten samples.
    """
    sizes = signals.groupBy("recording").agg(F.countDistinct("sample_idx").alias("n"))
    rows = signals.filter(F.col("ch_type").isin("hbo", "hbr"))
    if bad_channels is not None:
        rows = rows.join(bad_channels.select("recording", "channel"), ["recording", "channel"], "left_anti")
    if bad_segments is not None:
        lost = range_join(rows.select("recording", "sample_idx").distinct(), bad_segments.withColumn("last", F.col("end") - 1), ["recording"], point="sample_idx", low="start", high="last", width=1024.0).select("recording", "sample_idx").distinct()
        rows = rows.join(lost, ["recording", "sample_idx"], "left_anti")
    arrays = rows.groupBy("recording", "ch_type", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "x"))), lambda s: s["x"]).alias("x"))
    stacks = arrays.groupBy("recording").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("ch_type") == c, F.struct("channel", "x")))), lambda s: s["x"]).alias(c) for c in ("hbo", "hbr")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                sides, kept = [], 0
                for c in ("hbo", "hbr"):
                    data = np.array(batch.column(c)[row].as_py() or [], float)
                    fine = data.ndim == 2 and len(data) >= 2 and data.shape[1] >= 10
                    sides.append(_reliability(data) if fine else np.nan)
                    kept = max(kept, data.shape[1] if data.ndim == 2 else 0)
                mean = float(np.nanmean(sides)) if not np.isnan(sides).all() else np.nan
                out.append((*sides, mean, kept))
            columns = np.array(out, float).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("recording"), *(pa.array(c, mask=np.isnan(c)) for c in columns)], names=["recording", "split_half_reliability_hbo", "split_half_reliability_hbr", "mean_reliability", "kept"])

    kind = dict(stacks.dtypes)["recording"]
    found = stacks.mapInArrow(run, f"recording {kind}, split_half_reliability_hbo double, split_half_reliability_hbr double, mean_reliability double, kept double")
    return found.join(sizes, "recording").select("recording", "split_half_reliability_hbo", "split_half_reliability_hbr", "mean_reliability", (F.col("kept") / F.col("n")).alias("retained_duration_fraction"))


def resample_linear(samples: DataFrame, keys: list[str], fs: float, target: float, *, index: str = "sample_idx", x: str = "x") -> DataFrame:
    """Linear interpolation onto int(n * target / fs) samples, held at the end: a join of each new sample with its two neighbours."""
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.withColumn("m", F.floor(F.col("n") * target / fs)).filter("m > 0").withColumn("new_idx", F.explode(F.expr("sequence(0L, m - 1)")))
    at = F.col("new_idx") / F.lit(float(target)) * F.lit(float(fs))
    grid = grid.withColumn("at", F.least(at, F.col("n") - 1.0)).withColumn("lo", F.floor("at")).withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1)).withColumn("part", F.col("at") - F.col("lo"))
    near = lambda side: samples.select(*keys, F.col(index).cast("long").alias(side), F.col(x).alias("x_" + side))
    out = grid.join(near("lo"), [*keys, "lo"]).join(near("hi"), [*keys, "hi"])
    return out.select(*keys, F.col("new_idx").alias(index), (F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * F.col("part")).alias(x))
