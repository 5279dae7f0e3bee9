"""Queries on signal quality, spectra and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweave.catalog import Catalog
from tempoweave.functions.naming import pair_base
from tempoweave.functions.scores import METRICS
from tempoweave.operators import quality as ops
from tempoweave.operators import report, spectral
from tempoweave.sources.driver_tables import FS, SIGNALS_SQL, signals, table

C = Catalog()
KEYS = ["recording", "channel"]


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


TIME_SQL = """d1 AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY channel ORDER BY sample_idx)) AS dx, median(x) OVER (PARTITION BY channel) AS mid, sample_idx / 4.0::DOUBLE AS k FROM sig),
tm AS (SELECT recording, channel, ch_type, pair_base, count(*) AS n, 0.0::DOUBLE AS nan_ratio, CASE WHEN max(x) - min(x) < 1e-6 THEN 1 ELSE 0 END AS near_flatline, max(x) - min(x) AS range, stddev_pop(x) / (abs(avg(x)) + 1e-8) AS cv, abs(avg(x)) / (stddev_pop(x) + 1e-8) AS tsnr,
 median(dx) / (median(abs(x - mid)) + 1e-8) AS rdi, abs(covar_samp(k, x) / var_pop(k)) / (stddev_pop(x) + 1e-8) AS drift, median(abs(x - mid)) AS mad FROM d1 GROUP BY ALL)"""
PAIR_SQL = """pj AS (SELECT recording, pair_base, sample_idx, max(CASE WHEN ch_type = 'hbo' THEN x END) AS a, max(CASE WHEN ch_type = 'hbr' THEN x END) AS b FROM sig GROUP BY ALL),
pd AS (SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM pj WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY pair_base ORDER BY sample_idx)),
pm AS (SELECT recording, pair_base, count(*) AS n, corr(a, b) AS hbo_hbr_corr, stddev_pop(a) / (stddev_pop(b) + 1e-8) AS hbo_hbr_var_ratio, corr(da, db) AS hbo_hbr_deriv_corr FROM pd GROUP BY ALL)"""


@C.query(f"WITH {SIGNALS_SQL}, {TIME_SQL} SELECT recording, channel, n, round(nan_ratio, 6) AS nan_ratio, near_flatline, round(range, 6) AS range, round(cv, 4) AS cv, round(tsnr, 6) AS tsnr, round(rdi, 5) AS rdi, round(drift, 6) AS drift, round(mad, 6) AS mad FROM tm")
def signal_time_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = ops.time_metrics(signals(spark, d), FS)
    return _round(_round(_round(out, 6, "nan_ratio", "range", "tsnr", "drift", "mad"), 5, "rdi"), 4, "cv")


@C.query(f"WITH {SIGNALS_SQL}, {PAIR_SQL} SELECT recording, pair_base, n, round(hbo_hbr_corr, 6) AS hbo_hbr_corr, round(hbo_hbr_var_ratio, 6) AS hbo_hbr_var_ratio, round(hbo_hbr_deriv_corr, 6) AS hbo_hbr_deriv_corr FROM pm")
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.pair_metrics(signals(spark, d)), 6, "hbo_hbr_corr", "hbo_hbr_var_ratio", "hbo_hbr_deriv_corr")


BASIC_SQL = f"""WITH {SIGNALS_SQL}, e AS (SELECT *, x - lag(x) OVER (PARTITION BY channel ORDER BY sample_idx) AS dx, median(x) OVER (PARTITION BY channel) AS mx FROM sig), e2 AS (SELECT *, median(dx) OVER (PARTITION BY channel) AS md FROM e),
st AS (SELECT recording, channel, ch_type, pair_base, stddev_pop(x) AS std, median(abs(x - mx)) AS mad, max(x) - min(x) AS ptp, median(abs(dx - md)) AS deriv_mad, stddev_pop(dx) AS deriv_std FROM e2 GROUP BY ALL),
pj AS (SELECT recording, pair_base, sample_idx, max(CASE WHEN ch_type = 'hbo' THEN x END) AS a, max(CASE WHEN ch_type = 'hbr' THEN x END) AS b FROM sig GROUP BY ALL), pc AS (SELECT recording, pair_base, corr(a, b) AS r FROM pj WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
z1 AS (SELECT st.*, r, median(deriv_mad) OVER (PARTITION BY st.recording) AS mid FROM st LEFT JOIN pc ON pc.pair_base = st.pair_base), z2 AS (SELECT *, median(abs(deriv_mad - mid)) OVER (PARTITION BY recording) AS sp FROM z1),
z3 AS (SELECT *, CASE WHEN sp > 0 THEN 0.6745 * (deriv_mad - mid) / sp END AS z FROM z2),
fl AS (SELECT *, coalesce(std < 1e-8, false) AS bad_flat, coalesce(z > 5, false) AS bad_jump, coalesce(r > 0.3, false) AS bad_corr FROM z3), fi AS (SELECT *, bool_or(bad_flat OR bad_jump OR bad_corr) OVER (PARTITION BY recording, pair_base) AS bad_final FROM fl)"""


@C.query(BASIC_SQL + " SELECT recording, channel, round(std, 6) AS std, round(mad, 6) AS mad, round(ptp, 6) AS ptp, round(deriv_mad, 6) AS deriv_mad, round(deriv_std, 6) AS deriv_std, round(r, 6) AS hbo_hbr_corr, round(z, 4) AS deriv_mad_robust_z, bad_flat, bad_jump, bad_corr, bad_final FROM fi")
def quality_basic(spark: SparkSession, d: str) -> DataFrame:
    out = ops.basic_assessment(signals(spark, d)).select(*KEYS, "std", "mad", "ptp", "deriv_mad", "deriv_std", "hbo_hbr_corr", "deriv_mad_robust_z", "bad_flat", "bad_jump", "bad_corr", "bad_final")
    return _round(_round(out, 6, "std", "mad", "ptp", "deriv_mad", "deriv_std", "hbo_hbr_corr"), 4, "deriv_mad_robust_z")


@C.query(BASIC_SQL + " SELECT recording, channel, CASE WHEN bad_final THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS channel_score, round(avg(CASE WHEN bad_final THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) OVER (PARTITION BY recording), 6) AS overall_score FROM fi")
def channel_overall_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.channel_scores(ops.basic_assessment(signals(spark, d))), 6, "overall_score")


@C.query(BASIC_SQL + " SELECT sig2.recording, sig2.channel, CASE WHEN bad_final IS NULL THEN 0.5::DOUBLE WHEN bad_final THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM (SELECT DISTINCT recording, channel FROM sig) sig2 LEFT JOIN (SELECT * FROM fi WHERE ch_type = 'hbo') f ON f.channel = sig2.channel")
def channel_heatmap(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return report.heat_map(s.select(*KEYS).distinct(), ops.basic_assessment(s).filter("ch_type = 'hbo'"))


def _bad(spark: SparkSession, d: str) -> DataFrame:
    channels = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("recording"), F.concat(F.lit("ch"), F.col("vec_id").cast("string")).alias("channel"), F.when(F.col("vec_id") % 2 == 0, "hbo").otherwise("hbr").alias("ch_type"), F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2).cast("string")).alias("pair_base"), "label")
    return channels.withColumn("bad", F.col("label") == 3)


@C.query("SELECT vec_id // 50 AS recording, 'ch' || vec_id AS channel, label = 3 AS bad, bool_or(label = 3) OVER (PARTITION BY vec_id // 2) AS bad_final FROM embeddings")
def bad_pair_expand(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_bad_pairs(_bad(spark, d), "bad").select(*KEYS, "bad", "bad_final")


@C.query("SELECT vec_id // 50 AS recording, 'S' || (vec_id // 2) AS pair_base, 'S' || (vec_id // 2) || CASE WHEN vec_id % 2 = 0 THEN ' hbo' ELSE '_hbr' END AS channel FROM embeddings")
def channel_pairing(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    name = F.concat(F.lit("S"), F.floor(v / 2).cast("string"), F.when(v % 2 == 0, " hbo").otherwise("_hbr"))
    return table(spark, d, "embeddings").select(F.floor(v / 50).alias("recording"), pair_base(name).alias("pair_base"), name.alias("channel"))


COMPRE_SQL = f"""WITH {SIGNALS_SQL}, {TIME_SQL}, {PAIR_SQL},
ca AS (SELECT tm.*, hbo_hbr_corr, hbo_hbr_var_ratio, hbo_hbr_deriv_corr, bool_or(near_flatline = 1 OR cv > 5 OR rdi > 10) OVER (PARTITION BY tm.recording, tm.pair_base) AS bad_final FROM tm LEFT JOIN pm ON pm.pair_base = tm.pair_base)"""


@C.query(COMPRE_SQL + " SELECT recording, channel, round(tsnr, 6) AS tsnr, round(hbo_hbr_corr, 6) AS hbo_hbr_corr, cv > 5 AS bad_cv, rdi > 10 AS bad_rdi, bad_final FROM ca")
def quality_comprehensive(spark: SparkSession, d: str) -> DataFrame:
    out = ops.comprehensive_assessment(signals(spark, d), FS).select(*KEYS, "tsnr", "hbo_hbr_corr", "bad_cv", "bad_rdi", "bad_final")
    return _round(out, 6, "tsnr", "hbo_hbr_corr")


@C.query(COMPRE_SQL + " SELECT recording, count(*) AS n_channels, sum(CASE WHEN ch_type = 'hbo' THEN 1 ELSE 0 END)::BIGINT AS n_hbo, sum(CASE WHEN ch_type = 'hbr' THEN 1 ELSE 0 END)::BIGINT AS n_hbr, sum(CASE WHEN bad_final THEN 1 ELSE 0 END)::BIGINT AS n_bad_channels, round(avg(CASE WHEN bad_final THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS bad_channel_fraction, round(avg(tsnr), 6) AS mean_tsnr, round(avg(rdi), 5) AS mean_rdi, round(median(tsnr), 6) AS median_tsnr, round(median(rdi), 5) AS median_rdi FROM ca GROUP BY recording")
def quality_run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = ops.run_summary(ops.comprehensive_assessment(signals(spark, d), FS), ["tsnr", "rdi"])
    return _round(_round(out, 6, "bad_channel_fraction", "mean_tsnr", "median_tsnr"), 5, "mean_rdi", "median_rdi")


CLIP = "greatest(0.0, least(1.0, {0}))"
SCORE_SQL = COMPRE_SQL + f""", sc AS (SELECT recording, pair_base, {CLIP.format('(3.0 - cv) / 2.9')} AS s_cv, {CLIP.format('(tsnr - 1.0) / 9.0')} AS s_tsnr, {CLIP.format('(5.0 - rdi) / 4.9')} AS s_rdi, {CLIP.format('(0.5 - drift) / 0.49')} AS s_drift,
  {CLIP.format('(0.8 - hbo_hbr_corr) / 1.6')} AS s_pair, {CLIP.format('(2 - abs(log2(hbo_hbr_var_ratio + 1e-8))) / 1.5')} AS s_var, {CLIP.format('(0.8 - hbo_hbr_deriv_corr) / 1.6')} AS s_deriv FROM ca),
cp AS (SELECT recording, pair_base, (0.10 * avg(s_cv) + 0.15 * avg(s_tsnr) + 0.15 * avg(s_rdi) + 0.10 * avg(s_drift) + 0.10 * avg(s_pair) + 0.10 * avg(s_var) + 0.10 * avg(s_deriv)) / 0.80 AS score FROM sc GROUP BY ALL HAVING count(*) = 2)"""
#: the metrics of the time domain and of pairs
TIME_METRICS = tuple(m for m in METRICS if m[0] not in ("spectral_entropy", "mayer_ratio", "resp_ratio"))
TIER_SQL = "CASE WHEN {0} < 0.5 THEN 'poor' WHEN {0} < 0.7 THEN 'fair' WHEN {0} < 0.85 THEN 'good' ELSE 'excellent' END"


def _composite(spark: SparkSession, d: str) -> DataFrame:
    return ops.composite_scores(ops.comprehensive_assessment(signals(spark, d), FS), TIME_METRICS)


@C.query(SCORE_SQL + f" SELECT recording, pair_base, round(score, 5)::DOUBLE AS composite_score, {TIER_SQL.format('score')} AS quality_tier FROM cp")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return _round(_composite(spark, d).select("recording", "pair_base", "composite_score", "quality_tier"), 5, "composite_score")


@C.query(SCORE_SQL + " SELECT recording, pair_base, round(avg(s_cv), 5)::DOUBLE AS cv, round(avg(s_tsnr), 5)::DOUBLE AS tsnr, round(avg(s_rdi), 5)::DOUBLE AS rdi, round(avg(s_drift), 5)::DOUBLE AS drift, round(avg(s_pair), 5)::DOUBLE AS pair_corr, round(avg(s_var), 5)::DOUBLE AS var_ratio, round(avg(s_deriv), 5)::DOUBLE AS deriv_pair FROM sc GROUP BY ALL HAVING count(*) = 2")
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    names = [m[0] for m in TIME_METRICS]
    return _round(_composite(spark, d).select("recording", "pair_base", *names), 5, *names)


@C.query(SCORE_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score, pair_base) AS k, count(*) OVER (PARTITION BY recording) AS n FROM cp), t AS (SELECT * FROM k WHERE (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)) OR 2 * floor(n * 0.1) >= n), r AS (SELECT recording, avg(score) AS run_score, any_value(n) AS n_channels_scored FROM t GROUP BY ALL)
SELECT recording, round(run_score, 5)::DOUBLE AS run_score, {TIER_SQL.format('run_score')} AS run_tier, n_channels_scored FROM r""")
def run_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.run_scores(_composite(spark, d)), 5, "run_score")


@C.query(COMPRE_SQL.replace("CAST(x AS DOUBLE) AS x", "CAST(x AS DOUBLE) + 1 AS x") + """, g AS (SELECT recording, pair_base, avg(tsnr) AS score FROM ca GROUP BY ALL HAVING count(*) = 2 AND NOT bool_or(bad_final)), p AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, pair_base) AS place, count(*) OVER (PARTITION BY recording) AS n FROM g)
SELECT recording, pair_base, round(score, 6) AS score, place FROM p WHERE place <= greatest(1, floor(n * 0.05))""")
def best_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    level = signals(spark, d).withColumn("x", F.col("x") + 1)  # about a level, so that some pairs pass the gates
    return _round(ops.best_pairs(ops.comprehensive_assessment(level, FS)), 6, "score")


# ---------------------------------------------------------------- spectra


def _psd_sql(name: str, window: str) -> str:
    """Density of 64-sample channels by a plain discrete Fourier transform."""
    w = {"hann": "(0.5 - 0.5 * cos(2 * pi() * sample_idx / 64))", "hamming": "(0.54 - 0.46 * cos(2 * pi() * sample_idx / 64))"}[window]
    return f"""{name}w AS (SELECT recording, channel, sample_idx, (x - avg(x) OVER (PARTITION BY channel)) * {w} AS y, {w} * {w} AS ww FROM sig),
{name}f AS (SELECT recording, channel, f.k, sum(y * cos(2 * pi() * f.k * sample_idx / 64)) AS re, sum(y * sin(2 * pi() * f.k * sample_idx / 64)) AS im, sum(ww) AS s FROM {name}w, (SELECT unnest(range(33)) AS k) f GROUP BY ALL),
{name} AS (SELECT recording, channel, k, k / 16.0::DOUBLE AS freq, (re * re + im * im) / (4.0 * s) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS psd FROM {name}f)"""


@C.query(f"WITH {SIGNALS_SQL}, {_psd_sql('ps', 'hann')} SELECT recording, channel, freq, round(psd, 7) AS psd FROM ps")
def psd_welch(spark: SparkSession, d: str) -> DataFrame:
    return _round(spectral.power_spectrum(signals(spark, d), KEYS, FS), 7, "psd")


def _band(name: str, low: float, high: float) -> str:
    return f"(SELECT coalesce(sum((a.psd + b.psd) / 2 * (b.freq - a.freq)), 0.0) FROM {name} a JOIN {name} b ON a.channel = b.channel AND b.k = a.k + 1 WHERE a.channel = c.channel AND a.freq >= {low} AND b.freq < {high})"


@C.query(f"""WITH {SIGNALS_SQL}, {_psd_sql('ps', 'hann')}, q AS (SELECT channel, psd / sum(psd) OVER (PARTITION BY channel) AS q FROM ps WHERE psd > 0), en AS (SELECT channel, -sum(q * ln(q + 1e-8)) AS e FROM q GROUP BY ALL), c AS (SELECT DISTINCT recording, channel FROM sig),
b AS (SELECT c.recording, c.channel, {_band('ps', 0.01, 0.08)} AS l, {_band('ps', 0.08, 0.15)} AS m, {_band('ps', 0.15, 0.40)} AS r FROM c)
SELECT b.recording, b.channel, round(e, 6) AS spectral_entropy, round(l, 7)::DOUBLE AS power_low, round(m, 7)::DOUBLE AS power_mayer, round(r, 7)::DOUBLE AS power_resp, round(m / (l + r + 1e-8), 6)::DOUBLE AS mayer_ratio FROM b JOIN en ON en.channel = b.channel""")
def spectral_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.spectral_metrics(signals(spark, d), KEYS, FS).drop("resp_ratio")
    return _round(_round(out, 7, "power_low", "power_mayer", "power_resp"), 6, "spectral_entropy", "mayer_ratio")


#: the bands' and entropy's table with the ratios, under names of their own
SPECTRAL_SQL = f"""{_psd_sql('ps', 'hann')}, q AS (SELECT channel, psd / sum(psd) OVER (PARTITION BY channel) AS q FROM ps WHERE psd > 0), en AS (SELECT channel, -sum(q * ln(q + 1e-8)) AS spectral_entropy FROM q GROUP BY ALL), c AS (SELECT DISTINCT recording, channel FROM sig),
bp AS (SELECT c.recording, c.channel, {_band('ps', 0.01, 0.08)} AS l, {_band('ps', 0.08, 0.15)} AS m, {_band('ps', 0.15, 0.40)} AS r FROM c),
sp AS (SELECT bp.recording, bp.channel, spectral_entropy, m / (l + r + 1e-8) AS mayer_ratio, r / (l + m + 1e-8) AS resp_ratio FROM bp LEFT JOIN en ON en.channel = bp.channel),
cs AS (SELECT ca.*, spectral_entropy, mayer_ratio, resp_ratio FROM ca LEFT JOIN sp ON sp.channel = ca.channel)"""
BAND = "CASE WHEN {0} >= 0.1 AND {0} <= 10 THEN 1 - 0.9::DOUBLE * abs(log10({0} + 1e-8)) / 2 ELSE 0.1::DOUBLE END"
FULL_PARTS = {
    "cv": CLIP.format("(3.0 - cv) / 2.9"), "tsnr": CLIP.format("(tsnr - 1.0) / 9.0"), "rdi": CLIP.format("(5.0 - rdi) / 4.9"), "drift": CLIP.format("(0.5 - drift) / 0.49"),
    "spectral_entropy": CLIP.format("(3.0 - spectral_entropy) / 2.5"), "mayer_ratio": BAND.format("mayer_ratio"), "resp_ratio": BAND.format("resp_ratio"),
    "pair_corr": CLIP.format("(0.8 - hbo_hbr_corr) / 1.6"), "var_ratio": CLIP.format("(2 - abs(log2(hbo_hbr_var_ratio + 1e-8))) / 1.5"), "deriv_pair": CLIP.format("(0.8 - hbo_hbr_deriv_corr) / 1.6"),
}
FULL_SOURCES = {"pair_corr": "hbo_hbr_corr", "var_ratio": "hbo_hbr_var_ratio", "deriv_pair": "hbo_hbr_deriv_corr"}
FULL_SQL = f"""{COMPRE_SQL}, {SPECTRAL_SQL}, sf AS (SELECT recording, pair_base, {', '.join(f"CASE WHEN {FULL_SOURCES.get(n, n)} IS NULL THEN 0.0::DOUBLE ELSE {x} END AS s_{n}" for n, x in FULL_PARTS.items())} FROM cs),
af AS (SELECT recording, pair_base, {', '.join(f"avg(s_{n}) AS {n}" for n in FULL_PARTS)} FROM sf GROUP BY ALL HAVING count(*) = 2),
cp AS (SELECT *, 0.10::DOUBLE * cv + 0.15::DOUBLE * tsnr + 0.15::DOUBLE * rdi + 0.10::DOUBLE * drift + 0.10::DOUBLE * spectral_entropy + 0.05::DOUBLE * mayer_ratio + 0.05::DOUBLE * resp_ratio + 0.10::DOUBLE * pair_corr + 0.10::DOUBLE * var_ratio + 0.10::DOUBLE * deriv_pair AS score FROM af)"""


def _assessed_full(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return ops.comprehensive_assessment(s, FS, spectral.spectral_metrics(s, KEYS, FS))


@C.query(FULL_SQL + f" SELECT recording, pair_base, round(score, 5)::DOUBLE AS composite_score, {TIER_SQL.format('score')} AS quality_tier FROM cp")
def composite_score_full(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.composite_scores(_assessed_full(spark, d)).select("recording", "pair_base", "composite_score", "quality_tier"), 5, "composite_score")


@C.query(FULL_SQL + f" SELECT recording, pair_base, {', '.join(f'round({n}, 5)::DOUBLE AS {n}' for n in FULL_PARTS)} FROM cp")
def metric_scores_full(spark: SparkSession, d: str) -> DataFrame:
    names = [m[0] for m in METRICS]
    return _round(ops.composite_scores(_assessed_full(spark, d)).select("recording", "pair_base", *names), 5, *names)


@C.query(FULL_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score, pair_base) AS k, count(*) OVER (PARTITION BY recording) AS n FROM cp), t AS (SELECT * FROM k WHERE (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)) OR 2 * floor(n * 0.1) >= n), r AS (SELECT recording, avg(score) AS run_score, any_value(n) AS n_channels_scored FROM t GROUP BY ALL)
SELECT recording, round(run_score, 5)::DOUBLE AS run_score, {TIER_SQL.format('run_score')} AS run_tier, n_channels_scored FROM r""")
def run_trimmed_mean_full(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.run_scores(ops.composite_scores(_assessed_full(spark, d))), 5, "run_score")


SUMMARY_METRICS = {"cv": 3, "tsnr": 6, "rdi": 5, "drift": 6, "spectral_entropy": 6, "mayer_ratio": 6, "resp_ratio": 0, "hbo_hbr_corr": 6, "hbo_hbr_var_ratio": 6, "hbo_hbr_deriv_corr": 6}


@C.query(f"{COMPRE_SQL}, {SPECTRAL_SQL} SELECT recording, count(*) AS n_channels, sum(CASE WHEN ch_type = 'hbo' THEN 1 ELSE 0 END)::BIGINT AS n_hbo, sum(CASE WHEN ch_type = 'hbr' THEN 1 ELSE 0 END)::BIGINT AS n_hbr, sum(CASE WHEN bad_final THEN 1 ELSE 0 END)::BIGINT AS n_bad_channels, round(avg(CASE WHEN bad_final THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS bad_channel_fraction, {', '.join(f'round(avg({m}), {k})::DOUBLE AS mean_{m}, round(median({m}), {k})::DOUBLE AS median_{m}' for m, k in SUMMARY_METRICS.items())} FROM cs GROUP BY recording")
def quality_run_summary_full(spark: SparkSession, d: str) -> DataFrame:
    out = _round(ops.run_summary(_assessed_full(spark, d), list(SUMMARY_METRICS)), 6, "bad_channel_fraction")
    for m, k in SUMMARY_METRICS.items():
        out = _round(out, k, f"mean_{m}", f"median_{m}")
    return out


@C.query(f"{COMPRE_SQL}, {SPECTRAL_SQL} SELECT recording, channel, round(spectral_entropy, 6) AS spectral_entropy, round(mayer_ratio, 6)::DOUBLE AS mayer_ratio, round(resp_ratio, 0)::DOUBLE AS resp_ratio FROM sp")
def spectral_ratios(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.spectral_metrics(signals(spark, d), KEYS, FS).select(*KEYS, "spectral_entropy", "mayer_ratio", "resp_ratio")
    return _round(_round(out, 6, "spectral_entropy", "mayer_ratio"), 0, "resp_ratio")


SNR_SQL = f"""WITH {SIGNALS_SQL}, {_psd_sql('ps0', 'hamming')}, ps AS (SELECT * FROM ps0 WHERE freq >= 0.01 AND freq <= 0.5), dx AS (SELECT recording, channel, x, x - lag(x) OVER (PARTITION BY channel ORDER BY sample_idx) AS d FROM sig), c AS (SELECT recording, channel, stddev_pop(x) AS sx, stddev_pop(d) AS sd FROM dx GROUP BY ALL),
sn AS (SELECT recording, channel, 20 * log10(sx / sd) AS t_db, 10 * log10({_band('ps', 0.01, 0.2)} / {_band('ps', 0.2, 0.5)}) AS p_db FROM c)"""


def _snr(spark: SparkSession, d: str) -> DataFrame:
    return spectral.signal_to_noise(signals(spark, d), KEYS, FS)


@C.query(SNR_SQL + " SELECT recording, channel, round(t_db, 5) AS snr_time_db, round(p_db, 4) AS snr_psd_db FROM sn")
def snr_db(spark: SparkSession, d: str) -> DataFrame:
    return _round(_round(_snr(spark, d), 5, "snr_time_db"), 4, "snr_psd_db")


@C.query(SNR_SQL + f", {TIME_SQL} SELECT tm.recording, tm.channel, round(tsnr, 6) AS tsnr, round(t_db, 5) AS snr_time_db FROM tm LEFT JOIN sn ON sn.channel = tm.channel")
def quality_snr_join(spark: SparkSession, d: str) -> DataFrame:
    out = ops.time_metrics(signals(spark, d), FS).select(*KEYS, "tsnr").join(_snr(spark, d).select(*KEYS, "snr_time_db"), KEYS, "left")
    return _round(_round(out, 6, "tsnr"), 5, "snr_time_db")


@C.query(f"""WITH {SIGNALS_SQL}, {TIME_SQL}, e AS (SELECT recording, tsnr, min(tsnr) OVER (PARTITION BY recording) AS lo, max(tsnr) OVER (PARTITION BY recording) AS hi FROM tm)
SELECT recording, CAST(CASE WHEN hi > lo THEN least(30, floor((tsnr - lo) / ((hi - lo) / 30)) + 1) ELSE 1 END AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY ALL""")
def snr_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(ops.time_metrics(signals(spark, d), FS), ["recording"], "tsnr")


@C.query(f"WITH {SIGNALS_SQL}, s AS (SELECT recording, pair_base, stddev_pop(CASE WHEN ch_type = 'hbo' THEN x END) AS a, stddev_pop(CASE WHEN ch_type = 'hbr' THEN x END) AS b FROM sig GROUP BY ALL) SELECT recording, round(regr_slope(b, a), 5) AS slope, round(regr_intercept(b, a), 6) AS intercept, round(corr(a, b), 5) AS r, count(*) AS n FROM s GROUP BY recording")
def hbo_hbr_regression(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c: F.stddev_pop(F.when(F.col("ch_type") == c, F.col("x")))
    pairs = signals(spark, d).groupBy("recording", "pair_base").agg(side("hbo").alias("a"), side("hbr").alias("b"))
    return _round(_round(report.regression(pairs, ["recording"], "a", "b"), 5, "slope", "r"), 6, "intercept")


@C.query(f"""WITH {SIGNALS_SQL}, ev AS (SELECT r.recording, e.event, e.o FROM (SELECT DISTINCT recording FROM sig) r, (SELECT unnest([1, 2, 3]) AS event, unnest([2, 24, 40]) AS o) e),
w AS (SELECT *, greatest(0, o - 20) AS b0, least(64, o + 40) AS r1, o - greatest(0, o - 20) < 3 AS small FROM ev),
j AS (SELECT w.recording, w.event, s.pair_base, s.ch_type, avg(CASE WHEN sample_idx < o THEN x END) AS mb, avg(CASE WHEN sample_idx >= o THEN x END) AS mr, var_pop(CASE WHEN sample_idx < o THEN x END) AS vb, var_pop(CASE WHEN sample_idx >= o THEN x END) AS vr,
  covar_samp(CASE WHEN sample_idx < o THEN (sample_idx - b0) / 4.0::DOUBLE END, CASE WHEN sample_idx < o THEN x END) / var_pop(CASE WHEN sample_idx < o THEN (sample_idx - b0) / 4.0::DOUBLE END) AS sl
  FROM w JOIN sig s ON s.recording = w.recording AND sample_idx >= b0 AND sample_idx < r1 WHERE NOT small GROUP BY ALL),
c AS (SELECT recording, event, pair_base, max(CASE WHEN ch_type = 'hbo' THEN abs(mb - mr) / sqrt(vb + vr + 1e-8) END) AS co, max(CASE WHEN ch_type = 'hbr' THEN abs(mb - mr) / sqrt(vb + vr + 1e-8) END) AS cr, max(abs(sl)) AS sl FROM j GROUP BY ALL)
SELECT p.recording, w.event, p.pair_base, round(co, 5) AS cnr_hbo, round(cr, 5) AS cnr_hbr, NOT small AND NOT coalesce(co < 0.5 AND cr < 0.5, false) AND NOT coalesce(sl > 0.1, false) AND NOT (w.event > 1 AND p.recording % 2 = 0) AS good
FROM (SELECT DISTINCT recording, pair_base FROM sig) p JOIN w ON w.recording = p.recording LEFT JOIN c ON c.recording = w.recording AND c.event = w.event AND c.pair_base = p.pair_base""")
def task_cnr(spark: SparkSession, d: str) -> DataFrame:
    return _round(_task(spark, d), 5, "cnr_hbo", "cnr_hbr")


def _task(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    runs = s.select("recording").distinct()
    events = runs.select("recording", F.explode(F.array(*(F.struct(F.lit(k).alias("event"), F.lit(o).alias("onset")) for k, o in ((1, 0.5), (2, 6.0), (3, 10.0))))).alias("e")).select("recording", "e.*")
    artifacts = runs.filter("recording % 2 = 0").select("recording", F.lit(15.0).alias("start"), F.lit(15.5).alias("end"))
    return ops.task_events(s, events, FS, artifacts)


@C.query(f"""WITH t AS ({C.statements["task_cnr"].replace("round(co, 5)", "co").replace("round(cr, 5)", "cr")}) SELECT recording, pair_base, round(median(cnr_hbo), 5) AS median_cnr_hbo, round(median(cnr_hbr), 5) AS median_cnr_hbr,
round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 5) AS good_event_fraction, count(*) AS n_events FROM t GROUP BY ALL""")
def task_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.task_metrics(_task(spark, d)), 5, "median_cnr_hbo", "median_cnr_hbr", "good_event_fraction")


@C.query(f"""WITH {SIGNALS_SQL}, p AS (SELECT a.recording, a.ch_type, a.channel AS i, b.channel AS j, corr(CASE WHEN a.sample_idx < 32 THEN a.x END, CASE WHEN a.sample_idx < 32 THEN b.x END) AS r1, corr(CASE WHEN a.sample_idx >= 32 THEN a.x END, CASE WHEN a.sample_idx >= 32 THEN b.x END) AS r2
  FROM sig a JOIN sig b ON a.recording = b.recording AND a.ch_type = b.ch_type AND a.sample_idx = b.sample_idx AND a.channel < b.channel GROUP BY ALL), c AS (SELECT recording, ch_type, corr(r1, r2) AS r FROM p GROUP BY ALL)
SELECT recording, round(max(CASE WHEN ch_type = 'hbo' THEN r END), 5) AS split_half_reliability_hbo, round(max(CASE WHEN ch_type = 'hbr' THEN r END), 5) AS split_half_reliability_hbr, round(avg(r), 5) AS mean_reliability, 1.0::DOUBLE AS retained_duration_fraction FROM c GROUP BY recording""")
def resting_split_half(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.resting_metrics(signals(spark, d)), 5, "split_half_reliability_hbo", "split_half_reliability_hbr", "mean_reliability")


@C.query(f"""WITH {SIGNALS_SQL}, g AS (SELECT recording, channel, unnest(range(40)) AS k FROM (SELECT DISTINCT recording, channel FROM sig)), p AS (SELECT *, least(k / 2.5::DOUBLE * 4.0, 63.0::DOUBLE) AS pos FROM g), q AS (SELECT *, CAST(floor(pos) AS BIGINT) AS lo, least(CAST(floor(pos) AS BIGINT) + 1, 63) AS hi FROM p)
SELECT q.recording, q.channel, q.k AS sample_idx, round(a.x + (b.x - a.x) * (pos - lo), 6) AS x FROM q JOIN sig a ON a.channel = q.channel AND a.sample_idx = lo JOIN sig b ON b.channel = q.channel AND b.sample_idx = hi""")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return _round(ops.resample_linear(signals(spark, d), KEYS, FS, 2.5), 6, "x")


@C.query(f"WITH {SIGNALS_SQL} SELECT recording, channel, CASE WHEN count(*) / 4.0 < 300 THEN 'iir_butterworth_order4' ELSE 'fir_auto' END AS method FROM sig GROUP BY ALL")
def smart_filter_policy(spark: SparkSession, d: str) -> DataFrame:
    n = signals(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*KEYS, spectral.filter_policy(F.col("n"), FS, 0.01).alias("method"))


def _section_sql(name: str, source: str, edge: float, kind: str, k: int, back: bool, order: int = 4) -> str:
    """One second-order Butterworth section over lists, forwards or from the end, from the steady state of the first sample."""
    b = "[1.0, -2.0, 1.0]" if kind == "high" else "[kk, 2 * kk, kk]"
    return f"""{name}c AS (SELECT recording, channel, {"list_reverse(ys)" if back else "ys"} AS xs, kk, q, {b}::DOUBLE[] AS b0 FROM {source}, (SELECT tan(pi() * {edge} / {FS}) * tan(pi() * {edge} / {FS}) AS kk, 2 * sin(pi() * {2 * k + 1} / {2 * order}) * tan(pi() * {edge} / {FS}) AS q)),
{name}p AS (SELECT recording, channel, xs, [v / (1 + q + kk) for v in b0] AS b, [2 * (kk - 1) / (1 + q + kk), (1 - q + kk) / (1 + q + kk)] AS a FROM {name}c),
{name}s AS (SELECT recording, channel, xs, a, b, 0 AS i, []::DOUBLE[] AS ys, (b[2] + b[3] - (a[1] + a[2]) * list_sum(b) / (1 + a[1] + a[2])) * xs[1] AS s1, (b[3] - a[2] * list_sum(b) / (1 + a[1] + a[2])) * xs[1] AS s2 FROM {name}p
  UNION ALL SELECT recording, channel, xs, a, b, i + 1, list_append(ys, b[1] * xs[i + 1] + s1), b[2] * xs[i + 1] - a[1] * (b[1] * xs[i + 1] + s1) + s2, b[3] * xs[i + 1] - a[2] * (b[1] * xs[i + 1] + s1) FROM {name}s WHERE i < len(xs)),
{name} AS (SELECT recording, channel, {"list_reverse(ys)" if back else "ys"} AS ys FROM {name}s WHERE i = len(xs))"""


def _filter_sql() -> str:
    """The band pass over 27 samples of odd padding on both sides: a high and a low pass of order 4, each section forwards and back."""
    parts, source = [], "f0"
    for edge, kind in ((0.01, "high"), (0.2, "low")):
        for k in range(2):
            for back in (False, True):
                name = f"f_{kind}_{k}_{int(back)}"
                parts.append(_section_sql(name, source, edge, kind, k, back))
                source = name
    return f"""WITH RECURSIVE {SIGNALS_SQL}, x0 AS (SELECT recording, channel, list(x ORDER BY sample_idx) AS x FROM sig GROUP BY ALL),
f0 AS (SELECT recording, channel, list_concat(list_concat([2 * x[1] - x[28 - j] for j in range(0, 27)], x), [2 * x[64] - x[64 - j] for j in range(1, 28)]) AS ys FROM x0), {", ".join(parts)}
SELECT recording, channel, unnest(range(64)) AS sample_idx, round(unnest(ys[28:91]), 5) + 0.0::DOUBLE AS x FROM {source}"""


@C.query(_filter_sql())
def smart_filter(spark: SparkSession, d: str) -> DataFrame:
    return _round(spectral.smart_filter(signals(spark, d), KEYS, FS), 5, "x").withColumn("x", F.col("x") + 0.0)


@C.query(f"""WITH RECURSIVE {SIGNALS_SQL}, x0 AS (SELECT recording, channel, list(x ORDER BY sample_idx) AS x, avg(x) AS mean FROM sig GROUP BY ALL), z0 AS (SELECT recording, channel, [v - mean for v in x] AS z FROM x0),
t0 AS (SELECT recording, channel, list_concat(list_concat([2 * z[1] - z[10 - j] for j in range(0, 9)], z), [2 * z[64] - z[64 - j] for j in range(1, 10)]) AS ys FROM z0),
{_section_sql("t1", "t0", 0.5, "low", 0, False, 2)}, {_section_sql("t2", "t1", 0.5, "low", 0, True, 2)},
sl AS (SELECT recording, channel, ys[10:73] AS slow FROM t2), dd AS (SELECT recording, channel, [slow[k + 1] - slow[k] for k in range(1, 64)] AS d FROM sl),
it AS (SELECT recording, channel, d, [1.0::DOUBLE for v in d] AS w, 'inf'::DOUBLE AS mu, 0 AS n, false AS done FROM dd
  UNION ALL SELECT recording, channel, d, CASE WHEN sigma = 0 THEN w ELSE [CASE WHEN abs(v - m) / (sigma * 4.685) < 1 THEN pow(1 - pow(abs(v - m) / (sigma * 4.685), 2), 2) ELSE 0.0::DOUBLE END for v in d] END, m, n + 1, sigma = 0 OR abs(mu - m) < 1e-12 * greatest(abs(m), abs(mu))
    FROM (SELECT *, 1.4826::DOUBLE * list_median([abs(v - m) for v in d]) AS sigma FROM (SELECT *, list_sum([w[k] * d[k] for k in range(1, len(d) + 1)]) / list_sum(w) AS m FROM it WHERE NOT done AND n < 50))),
la AS (SELECT recording, channel, arg_max(w, n) AS w, arg_max(mu, n) AS mu, any_value(d) AS d FROM it GROUP BY ALL),
fx AS (SELECT recording, channel, list_concat([0.0::DOUBLE], [list_sum([w[j] * (d[j] - mu) for j in range(1, k + 1)]) for k in range(1, 64)]) AS f FROM la),
o AS (SELECT x0.recording, x0.channel, [f[k] - list_avg(f) + x[k] - slow[k] for k in range(1, 65)] AS y FROM x0 JOIN sl ON sl.channel = x0.channel JOIN fx ON fx.channel = x0.channel)
SELECT recording, channel, unnest(range(64)) AS sample_idx, round(unnest(y), 5) + 0.0::DOUBLE AS x FROM o""")
def tddr(spark: SparkSession, d: str) -> DataFrame:
    return _round(spectral.motion_repair(signals(spark, d), KEYS, FS), 5, "x").withColumn("x", F.col("x") + 0.0)
