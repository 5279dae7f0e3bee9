"""Scores from 0 to 1 of signal metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric, kind, anchors, weight.
METRICS = (
    ("cv", "lower_better", 0.1, 3.0, 0.10),
    ("tsnr", "higher_better", 1.0, 10.0, 0.15),
    ("rdi", "lower_better", 0.1, 5.0, 0.15),
    ("drift", "lower_better", 0.01, 0.5, 0.10),
    ("spectral_entropy", "lower_better", 0.5, 3.0, 0.10),
    ("mayer_ratio", "band_metric", 0.01, 10.0, 0.05),
    ("resp_ratio", "band_metric", 0.01, 10.0, 0.05),
    ("pair_corr", "pair_corr", -0.8, 0.8, 0.10),
    ("var_ratio", "var_ratio", 0.5, 2.0, 0.10),
    ("deriv_pair", "pair_corr", -0.8, 0.8, 0.10),
)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def metric_score(value: Column, kind: str, low: float, high: float) -> Column:
    """The score of a metric's value; a missing one scores 0, an unknown kind 0.5."""
    if kind == "lower_better":
        score = _clip((high - value) / (high - low))
    elif kind == "higher_better":
        score = _clip((value - low) / (high - low))
    elif kind == "pair_corr":
        score = _clip((0.8 - value) / 1.6)
    elif kind == "var_ratio":
        score = _clip((2 - F.abs(F.log2(value + 1e-8))) / 1.5)
    elif kind == "band_metric":
        score = F.when((value >= 0.1) & (value <= 10), 1 - 0.9 * F.abs(F.log10(value + 1e-8)) / 2).otherwise(0.1)
    else:
        score = F.lit(0.5)
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def tier(score: Column) -> Column:
    return F.when(score < 0.5, "poor").when(score < 0.7, "fair").when(score < 0.85, "good").otherwise("excellent")
