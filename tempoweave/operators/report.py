"""Data behind the quality plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int = 30) -> DataFrame:
    """Per key and bin (1 to bins, equal widths between least and greatest): n."""
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = rows.filter(F.col(value).isNotNull()).join(ends, keys)
    width = (F.col("hi") - F.col("lo")) / bins
    nth = F.when(width > 0, F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / width) + 1)).otherwise(1)
    return placed.groupBy(*keys, nth.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def regression(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key slope, intercept and correlation of y over x."""
    return pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n"))


def heat_map(channels: DataFrame, flags: DataFrame) -> DataFrame:
    """Score of every channel: 1 good, 0 bad, 0.5 unknown."""
    return channels.join(flags.select("recording", "channel", "bad_final"), ["recording", "channel"], "left").select("recording", "channel", F.when(F.col("bad_final").isNull(), 0.5).when(F.col("bad_final"), 0.0).otherwise(1.0).alias("score"))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """All floating columns rounded half to even."""
    return df.select(*(F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
