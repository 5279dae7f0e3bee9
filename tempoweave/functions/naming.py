"""What file names and paths say: device, subject, session, task, BIDS names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword in a name, device; the first that fits counts.
NAME_KEYWORDS = (("nirs", "fnirs"), ("eeg", "eeg"), ("ecg", "ecg"), ("ekg", "ecg"), ("eda", "eda"), ("gsr", "eda"), ("emg", "emg"), ("resp", "resp"))
#: Directory names that mean a device, in the order in which parts of a name are looked for.
DIRECTORIES = (("ecg", "ecg"), ("eeg", "eeg"), ("fnirs", "fnirs"), ("nirs", "fnirs"), ("eda", "eda"), ("emg", "emg"), ("resp", "resp"))
#: Export formats by extension.
FORMATS = ((".set", "eeglab"), (".cdt", "curry"), (".dap", "curry"), (".dat", "curry"), (".rs3", "curry"), (".cef", "curry"))


def _first_fit(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), otherwise)


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (or where the group is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot is not one."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def device_from_name(name: Column) -> Column:
    low = F.lower(name)
    return _first_fit([(low.contains(k), F.lit(d)) for k, d in NAME_KEYWORDS], F.lit("unknown"))


def device_from_path(path: Column) -> Column:
    """A directory named like a device, else one whose name contains a device, else what the file name says."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.create_map(*(F.lit(x) for pair in DIRECTORIES for x in pair))
    exact = F.get(F.filter(folders, lambda p: p.isin(*(k for k, _ in DIRECTORIES))), 0)
    within = F.get(F.filter(F.transform(folders, lambda p: _first_fit([(p.contains(k), F.lit(d)) for k, d in DIRECTORIES], F.lit(None).cast("string"))), lambda d: d.isNotNull()), 0)
    return F.coalesce(F.try_element_at(named, exact), within, device_from_name(F.element_at(F.split(path, "/"), -1)))


def _padded(digits: Column, width: int) -> Column:
    """Zero padding that never cuts."""
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def _two(digits: Column) -> Column:
    """The number without leading zeros, then at least two digits."""
    return _padded(F.regexp_replace(digits, r"^0+(?=\d)", ""), 2)


BIDS = r"(?i)^sub-(\d+)_ses-(\d+)_task-(\w+)_(\w+)$"
DATED = r"(?i)^(\d{8})(\d{3})(?:part(\d+)|_(\d{1,2}))?(?:_|$)"
SEGMENT = r"(?i)^([A-Za-z]{4})_(\d{3})_SEG_(\d+)(?:_|$)"
SUBJECT = r"^(\d{3})(?:_|$)"


def parsed_name(name: Column) -> Column:
    """Struct of subject_id, session_label, sequence_id, project, filename_style and device of a file name."""
    s = stem(name)
    device = device_from_name(name)
    mod = F.lower(F.regexp_extract(s, BIDS, 4))
    bids_device = _first_fit([(mod.isin("fnirs", "nirs"), F.lit("fnirs")), (mod == "eeg", F.lit("eeg")), (mod.isin("ecg", "ekg"), F.lit("ecg"))], device)

    def row(subject, session, sequence, project, style, device_=device) -> Column:
        none = F.lit(None).cast("string")
        values = (subject, session, sequence, none if project is None else project, none if style is None else F.lit(style), device_)
        return F.struct(*(v.alias(n) for v, n in zip(values, ("subject_id", "session_label", "sequence_id", "project", "filename_style", "device"), strict=True)))

    project = F.upper(_group(s, r"^([A-Za-z]{4})_"))
    loose = row(
        F.coalesce(_group(s, r"(?:^|_)(\d{3})(?:_|$)"), F.lit("unknown")),
        F.coalesce(_group(s, r"^(\d{8})"), project, F.lit("unknown")),
        F.coalesce(_two(_group(s, r"(?i)(?:^|_)SEG_(\d+)(?:_|$)")), F.lit("01")),
        project,
        "unmatched",
    )
    ses = _padded(F.regexp_extract(s, BIDS, 2), 2)
    seg = F.upper(F.regexp_extract(s, SEGMENT, 1))
    return _first_fit(
        [
            (s.rlike(BIDS), row(_padded(F.regexp_extract(s, BIDS, 1), 3), F.concat(F.lit("ses-"), ses), ses, None, "bids", bids_device)),
            (s.rlike(DATED), row(F.regexp_extract(s, DATED, 2), F.regexp_extract(s, DATED, 1), F.coalesce(_two(_group(s, DATED, 3)), _two(_group(s, DATED, 4)), F.lit("01")), None, "date_subject")),
            (s.rlike(SEGMENT), row(F.regexp_extract(s, SEGMENT, 2), seg, _two(F.regexp_extract(s, SEGMENT, 3)), seg, "project_subject_seg")),
            (s.rlike(SUBJECT), row(F.regexp_extract(s, SUBJECT, 1), F.lit("unknown"), F.lit("01"), None, "subject_only")),
        ],
        loose,
    )


def bids_name(name: Column, task_of_folder: Column | None = None) -> Column:
    """The BIDS stem of a legacy name (with a `_marker` or `_input` ending kept), or null if it is no such name."""
    folder = F.lit("") if task_of_folder is None else F.coalesce(task_of_folder, F.lit(""))
    s = stem(name)
    ending = F.regexp_extract(s, r"(_(?:input_marker|marker|input))$", 1)
    s = F.regexp_replace(s, r"_(?:input_marker|marker|input)$", "")
    build = lambda subject, session, task, mod: F.concat(F.lit("sub-"), _padded(subject, 3), F.lit("_ses-"), _two(session), F.lit("_task-"), task, F.lit("_" + mod), ending)
    fnirs, ecg = r"^(\d{8})(\d{3})_(\d+)$", r"(?i)^(\d{8})(\d{3})part(\d+)$"
    eeg, picture = r"(?i)^([A-Za-z]{4})_(\d{3})_SEG_(\d+)(?:_(.+))?$", r"^([A-Za-z]{4})_(\d{3})$"
    given = F.coalesce(_group(s, eeg, 4), F.nullif(folder, F.lit("")))
    task = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.coalesce(given, F.lit("rest"))), r"(\D+)\d+$", "$1"), F.lit("")), F.lit("rest"))
    return _first_fit(
        [
            (s.rlike(fnirs), build(F.regexp_extract(s, fnirs, 2), F.regexp_extract(s, fnirs, 3), F.lit("rest"), "fnirs")),
            (s.rlike(ecg), build(F.regexp_extract(s, ecg, 2), F.regexp_extract(s, ecg, 3), F.lit("rest"), "ecg")),
            (s.rlike(eeg), build(F.regexp_extract(s, eeg, 2), F.regexp_extract(s, eeg, 3), task, "eeg")),
            (s.rlike(picture), build(F.regexp_extract(s, picture, 2), F.lit("0"), F.lower(F.coalesce(F.nullif(folder, F.lit("")), F.lit("picture"))), "eeg")),
        ],
        F.lit(None).cast("string"),
    )


def join_key(file_name: Column) -> Column:
    """The lower-case stem that data and marker files share: without `_input_marker`, `_marker` or `_input`."""
    return F.regexp_replace(F.lower(stem(file_name)), r"_(?:input_marker|marker|input)$", "")


def task_of(name: Column) -> Column:
    return _group(name, r"_task-([^_]+)_")


def with_task(name: Column, task: str) -> Column:
    """The name with another task, before the next underscore, dot or end."""
    return F.regexp_replace(name, r"_task-[^_.]+(?=_|\.|$)", f"_task-{task}")


def file_type(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.array_contains(parts, "marker"), "marker").when(F.array_contains(parts, "convert"), "convert").otherwise("raw")


def input_format(path: Column) -> Column:
    """Reader of an EEG file by extension; null where there is none."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return _first_fit([(ext == e, F.lit(f)) for e, f in FORMATS] + [(ext == ".fdt", F.lit("eeglab"))], F.lit(None).cast("string"))


def channel_name(name: Column) -> Column:
    """Lower case, without blanks, brackets, underscores and hyphens."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s()\[\]_\-]", "")


def channel_group(name: Column) -> Column:
    low = channel_name(name)
    return _first_fit([(low.contains(k), F.lit(k)) for k in ("ecg", "eeg", "egg", "input")], F.lit("other"))


def processed_label(label: Column) -> Column:
    key = F.trim(label)
    return F.when(F.lower(key) == "oxyhb", "HbO").when(F.lower(key) == "deoxyhb", "HbR").when(F.lower(key) == "totalhb", "HbT").when(F.lower(key) == "dod", "dOD").otherwise(F.coalesce(F.nullif(key, F.lit("")), F.lit("ProcessedData")))


def pair_base(name: Column) -> Column:
    """The channel's name without its haemoglobin type."""
    for part in (" hbo", " hbr", "_hbo", "_hbr"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def device_type(name: Column) -> Column:
    """Type by the recording's ending."""
    low = F.lower(name)
    return F.when(low.contains("_input") | low.contains("_ecg"), "ecg").when(low.contains("_eeg"), "eeg").when(low.contains("_fnirs"), "fnirs").otherwise("unknown")
