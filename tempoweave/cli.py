"""Command line: fnirs, ecg, eeg, marker and quality jobs over folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tempoweave.functions.times import offset_list
from tempoweave.plans import pipelines as jobs
from tempoweave.sources import text_scans

METHODS = {"hungarian": "hungarian", "mincostflow": "min_cost_flow", "sinkhorn": "sinkhorn"}


def _tables(spark: SparkSession, folder: str) -> dict:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("channel", "sample")}


def _fnirs(spark, a):
    jobs.convert_fnirs(spark, a.input, a.output, a.sources, a.detectors, patch=not a.no_patch)


def _fnirs_patch(spark, a):
    from tempoweave.sources import sinks

    tables = {n: spark.read.parquet(f"{a.input}/{n}") for n in ("meta", "channel", "sample", "stim", "aux")}
    sinks.write_tables(sinks.without_total(tables), a.output)


def _ecg(spark, a):
    """CSV of one column per channel."""
    rows = text_scans.wide_samples(text_scans.whole_texts(spark, a.input)).select("sample_idx", "channel", "x")
    jobs.convert_ecg(rows, a.input_rate, a.output, a.base, target=a.sampling_rate)


def _eeg(spark, a):
    """Signals of Parquet (recording, channel, sample_idx, x)."""
    jobs.convert_eeg(spark.read.parquet(a.input), ["recording", "channel"], a.input_rate, target=a.sampling_rate).write.mode("overwrite").parquet(a.output)


def _extract(spark, a):
    out = jobs.extract_markers(spark, a.input, a.type, fs=a.fs, tolerance=a.tolerance, header=a.header)
    out.write.mode("overwrite").option("header", "true").csv(a.output)


def _clean(spark, a):
    jobs.markers.status_histogram(jobs.clean_markers(spark, a.input, a.output, min_rows=a.min_rows, min_interval=a.min_interval, remove_start=a.remove_start)).show()


def _info(spark, a):
    jobs.marker_inventory(spark, a.data, a.input, a.output)


def _match(spark, a):
    jobs.match_devices(jobs.marker_series(spark, a.files), a.devices, a.output, method=METHODS[a.method], max_time_diff=a.max_time_diff, sigma=a.sigma, drift=None if a.no_drift else a.drift_method)


def _manual(spark, a):
    series = jobs.marker_series(spark, a.files)
    given = spark.range(1).select(offset_list(F.lit(a.offsets)).alias("o")).first()["o"]
    if given is None or len(given) > len(a.devices):
        raise SystemExit("offsets: one number per device, in order")
    drifts = spark.createDataFrame([(d, 0.0, 1.0, "no_correction") for d in a.devices], "device string, offset double, scale double, method string")
    changes = spark.createDataFrame(list(zip(a.devices, given, strict=False)), "device string, change double")
    wide, report = jobs.rematch_with_offsets(series, drifts, changes, a.devices, add=a.add, method=METHODS[a.method], max_time_diff=a.max_time_diff, sigma=a.sigma)
    wide.write.mode("overwrite").option("header", "true").csv(f"{a.output}/timeline")
    report.show()


def _crop(spark, a):
    offsets = spark.read.parquet(a.offsets) if a.offsets else spark.createDataFrame([], "file_name string, offset double, sfreq double")
    jobs.crop_recordings(spark.read.parquet(a.input), a.kind, a.start, a.end, offsets, task=a.taskname).write.mode("overwrite").parquet(a.output)


def _crop_shortest(spark, a):
    rows, ranges = spark.read.parquet(a.input), spark.read.parquet(a.ranges)
    jobs.crop.crop_to_shortest(rows, ranges, ["subject"]).write.mode("overwrite").parquet(a.output)


def _quality(spark, a):
    signals = jobs.table_signals(_tables(spark, a.input))
    out = jobs.assess(signals, a.rate, low=a.l_freq, high=a.h_freq, target=a.resample, repair=not a.no_tddr)
    keep = {"resting": ("resting", "best"), "visualize": ()}.get(a.part, tuple(out))
    jobs.write_all({k: out[k] for k in keep} | (jobs.plot_data(out, signals) if a.part == "visualize" else {}), a.output)


def _rename(spark, a):
    files = text_scans.scan_folder(spark, a.input).select("path")
    jobs.bids_renames(files).write.mode("overwrite").option("header", "true").csv(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tempoweave", description=__doc__)
    groups = top.add_subparsers(required=True, metavar="group")

    def group(name):
        return groups.add_parser(name).add_subparsers(required=True, metavar="command")

    def command(at, name, run, *options, **defaults):
        p = at.add_parser(name)
        for flags, kw in (((("input",), {}), (("output",), {})) + options):
            p.add_argument(*flags, **kw)
        p.set_defaults(run=run, **defaults)
        return p

    def opt(flag, default=None, kind=None, **kw):
        return (flag,), {"default": default, "type": kind or (type(default) if default is not None else str)} | kw

    def flag(name):
        return (name,), {"action": "store_true"}

    at = group("fnirs")
    for name in ("convert", "batch"):
        command(at, name, _fnirs, opt("--sources"), opt("--detectors"), flag("--no-patch"))
    command(at, "patch", _fnirs_patch)
    at = group("ecg")
    for name in ("convert", "batch"):
        command(at, name, _ecg, opt("--base", "recording"), opt("--input-rate", 250.0), opt("--sampling-rate", 250.0))
    at = group("eeg")
    for name in ("convert", "batch"):
        command(at, name, _eeg, opt("--input-rate", 250.0), opt("--sampling-rate", None, float, nargs="?", const=250.0))
    at = group("marker")
    for name in ("extract", "batch"):
        command(at, name, _extract, opt("--type", "biopac", choices=["biopac", "brainvision", "fnirs"]), opt("--fs", 500.0), opt("--tolerance", 0.2), opt("--header"))
    command(at, "clean", _clean, opt("--min-rows", 2), opt("--min-interval", 1.0), flag("--remove-start"))
    command(at, "info", _info, opt("--data", "Data"))
    matching = (opt("--devices", None, str, nargs="+", required=True), opt("--files", None, str, nargs="+", required=True), opt("--method", "hungarian", choices=sorted(METHODS)), opt("--max-time-diff", 3.0), opt("--sigma", 0.75))
    command(at, "match", _match, *matching, flag("--no-drift"), opt("--drift-method", "linear", choices=["linear", "theil_sen"]))
    command(at, "manual-match", _manual, *matching, opt("--offsets", ""), flag("--add"))
    command(at, "crop", _crop_shortest, opt("--ranges", None, str, required=True))
    for name in ("matchcrop", "matchcrop-aligned"):
        command(at, name, _crop, opt("--kind", "ecg", choices=["ecg", "eeg", "fnirs"]), opt("--start", None, float, required=True), opt("--end", None, float, required=True), opt("--offsets"), opt("--taskname"))
    command(at, "rename", _rename)
    at = group("quality")
    for name, part in (("assess", "all"), ("batch", "all"), ("assess-with-metadata", "all"), ("batch-with-metadata", "all"), ("resting-metrics", "resting"), ("visualize", "visualize"), ("visualize-batch", "visualize")):
        command(at, name, _quality, opt("--rate", 4.0), opt("--l-freq", 0.01), opt("--h-freq", 0.2), opt("--resample", 4.0), flag("--no-tddr"), part=part)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tempoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
