"""Offsets by hand, shared time ranges, and cropping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets_of_devices(devices: DataFrame, spec: DataFrame, keys: list[str]) -> DataFrame:
    """Each device (in order of `position`, from 0) with its entry of the key's `offsets` array; missing entries are 0, more entries than devices are an error."""
    many = F.size("offsets") > F.count(F.lit(1)).over(W.partitionBy(*keys))
    offset = F.when(many, F.raise_error(F.lit("more offsets than devices")).cast("double")).otherwise(F.coalesce(F.get(F.col("offsets"), F.col("position").cast("int")), F.lit(0.0)))
    return devices.join(spec, keys, "left").withColumn("offset", offset).drop("offsets")


def adjusted_offsets(drifts: DataFrame, changes: DataFrame, keys: list[str], *, add: bool = False) -> DataFrame:
    """Drift rows with offsets replaced by (or, with add, increased by) `change`; others stay as they are, missing ones become the identity."""
    both = drifts.join(changes, keys, "left")
    base = F.coalesce("offset", F.lit(0.0))
    changed = F.col("change").isNotNull()
    offset = F.when(changed, base + F.col("change") if add else F.col("change")).otherwise(base)
    method = F.coalesce("method", F.lit("no_correction"))
    return both.select(*keys, offset.alias("offset"), F.coalesce("scale", F.lit(1.0)).alias("scale"), F.when(changed, F.concat(method, F.lit("_manual_adjust"))).otherwise(method).alias("method"))


def offset_report(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new offset and scale of the devices of either side, and what changed."""
    a = before.select(*keys, F.col("offset").alias("old_offset"), F.col("scale").alias("old_scale"))
    b = after.select(*keys, F.col("offset").alias("new_offset"), F.col("scale").alias("new_scale"))
    return a.join(b, keys, "full_outer").withColumn("change", F.coalesce("new_offset", F.lit(0.0)) - F.coalesce("old_offset", F.lit(0.0)))


def aligned_range(devices: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the consensus range where there is one, else the range that all devices share (lo, hi); none if it is empty."""
    out = devices.groupBy(*keys).agg(F.max("consensus_lo").alias("c_lo"), F.max("consensus_hi").alias("c_hi"), F.max("lo").alias("d_lo"), F.min("hi").alias("d_hi"))
    given = F.col("c_lo").isNotNull() & F.col("c_hi").isNotNull()
    out = out.select(*keys, F.when(given, F.col("c_lo")).otherwise(F.col("d_lo")).alias("lo"), F.when(given, F.col("c_hi")).otherwise(F.col("d_hi")).alias("hi"))
    return out.filter("lo < hi")


def crop_to_shortest(timeline: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Long timeline (keys, device, cons_id, t, weight) shifted to the start of the device with the shortest range, times outside that range removed.

    ranges: keys, device, position, lo, hi.  A removed time loses its weight; one that was missing keeps it.
    """
    shortest = ranges.groupBy(*keys).agg(F.min_by(F.struct("device", "lo", "hi"), F.struct((F.col("hi") - F.col("lo")).alias("d"), "position")).alias("ref"))
    out = timeline.join(ranges.select(*keys, "device", F.col("lo").alias("dev_lo")), [*keys, "device"]).join(shortest, keys)
    moved = F.when(F.col("device") == F.col("ref.device"), F.col("t")).otherwise(F.col("t") + (F.col("ref.lo") - F.col("dev_lo")))
    inside = (moved >= F.col("ref.lo")) & (moved <= F.col("ref.hi"))
    gone = F.col("t").isNotNull() & ~inside
    return out.select(*keys, "device", "cons_id", F.when(inside, moved).alias("t"), F.when(gone, 0.0).otherwise(F.col("weight")).alias("weight"))


def crop_closed(samples: DataFrame, keys: list[str], *, t: str = "t") -> DataFrame:
    """Samples with start - offset <= t <= end - offset, their time from that start (the rule for ECG); columns start, end, offset."""
    a, b = F.col("start") - F.col("offset"), F.col("end") - F.col("offset")
    return samples.filter((F.col(t) >= a) & (F.col(t) <= b)).withColumn(t, F.col(t) - a)


def crop_by_index(samples: DataFrame, keys: list[str], *, index: str = "i") -> DataFrame:
    """Samples from int(a * sfreq) up to but not including int(b * sfreq), within the recording (the rule for EEG); columns start, end, offset, sfreq."""
    a = F.greatest(F.lit(0), ((F.col("start") - F.col("offset")) * F.col("sfreq")).cast("long"))
    b = ((F.col("end") - F.col("offset")) * F.col("sfreq")).cast("long")
    return samples.filter((F.col(index) >= a) & (F.col(index) < b)).withColumn("new_" + index, F.col(index) - a)


def crop_half_open(samples: DataFrame, keys: list[str], *, t: str = "t") -> DataFrame:
    """Samples with a <= t < b, all if there are none, their time from the first one kept (the rule for fNIRS); columns start, end, offset."""
    inside = (F.col(t) >= F.col("start") - F.col("offset")) & (F.col(t) < F.col("end") - F.col("offset"))
    by = W.partitionBy(*keys)
    out = samples.withColumn("inside", inside).withColumn("some", F.max("inside").over(by)).filter("inside OR NOT some")
    return out.withColumn(t, F.col(t) - F.min(t).over(by)).drop("inside", "some")


def crop_metadata(crops: DataFrame, keys: list[str], parameters: dict[str, str]) -> DataFrame:
    """Per key the JSON that a crop leaves: its parameters, the devices that were cropped with their ranges and offsets, and the metadata of the matching that it followed.

    crops: device, lo, hi, offset, meta (JSON text or null).
    """
    device = F.struct(F.col("device").alias("name"), F.array("lo", "hi").alias("range"), "offset")
    given = F.struct(*(F.lit(v).alias(k) for k, v in sorted(parameters.items())))
    out = crops.groupBy(*keys).agg(F.array_sort(F.collect_list(device)).alias("devices"), F.first("meta", ignorenulls=True).alias("meta"))
    return out.select(*keys, F.to_json(F.struct(given.alias("crop_parameters"), F.col("devices").alias("devices_cropped"), F.col("meta").alias("original_matched_metadata"))).alias("json"))
