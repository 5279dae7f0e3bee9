"""Joins on ranges without comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], *, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range of the same keys with low <= point <= high.

    Ranges are listed in each bucket of `width` that they touch, so the join is
    an equi-join on keys and bucket; a width near the usual range is best.
    """
    bucket = lambda c: F.floor(c / F.lit(width))
    listed = ranges.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    placed = points.filter(F.col(point).isNotNull()).withColumn("_bucket", bucket(F.col(point)))
    return placed.join(listed, [*keys, "_bucket"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], *, left_t: str, right_t: str, band: float) -> DataFrame:
    """Pairs of the same keys whose times differ by at most `band`."""
    near = right.withColumn("_low", F.col(right_t) - F.lit(band) * 1.000001).withColumn("_high", F.col(right_t) + F.lit(band) * 1.000001)
    return range_join(left, near, keys, point=left_t, low="_low", high="_high", width=2 * band).filter(F.abs(F.col(left_t) - F.col(right_t)) <= band).drop("_low", "_high")


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt out by key over all tasks: for work that costs far more than the bytes of its rows suggest, which adaptive plans would put into a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
