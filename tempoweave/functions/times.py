"""Times of day, dates, offsets and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms_seconds(text: Column) -> Column:
    """`hh:mm:ss.ff` as seconds; null unless there are three numeric parts."""
    p = F.split(F.trim(text), ":")
    return F.when(F.size(p) == 3, F.get(p, 0).try_cast("double") * 3600 + F.get(p, 1).try_cast("double") * 60 + F.get(p, 2).try_cast("double"))


def iso_date(text: Column) -> Column:
    """`y/m/d` or `y-m-d` anywhere in the text as `yyyy-mm-dd`, else `unknown`."""
    pattern = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    part = lambda k: F.lpad(F.regexp_extract(text, pattern, k), 2, "0")
    day = F.concat_ws("-", F.regexp_extract(text, pattern, 1), part(2), part(3))
    return F.when(~text.contains("*") & text.rlike(pattern) & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day).otherwise("unknown")


def iso_time(text: Column) -> Column:
    """`h:m:s[.f][zone]` or `hhmmss[.f]` as `hh:mm:ss[.f]zone` (Z by default), else `unknown`."""
    s = F.trim(text)
    long = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    short = r"^(\d{2})(\d{2})(\d{2})(\.\d+)?$"
    pick = lambda k: F.when(s.rlike(long), F.regexp_extract(s, long, k)).otherwise(F.regexp_extract(s, short, k))
    number = lambda k: pick(k).try_cast("int")
    zone = F.when(s.rlike(long), F.coalesce(F.nullif(F.regexp_extract(s, long, 5), F.lit("")), F.lit("Z"))).otherwise("Z")
    fine = (s.rlike(long) | s.rlike(short)) & (number(1) <= 23) & (number(2) <= 59) & (number(3) <= 59)
    two = lambda k: F.lpad(pick(k), 2, "0")
    return F.when(fine, F.concat(two(1), F.lit(":"), two(2), F.lit(":"), two(3), pick(4), zone)).otherwise("unknown")


def offset_list(spec: Column) -> Column:
    """A JSON array, the values of a JSON object, or a comma list (blanks skipped) as doubles; null for `device:offset` pairs."""
    s = F.trim(spec)
    from_list = F.from_json(s, "array<double>")
    from_map = F.map_values(F.from_json(s, "map<string,double>"))
    plain = F.transform(F.filter(F.split(s, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    return F.when(s.startswith("["), from_list).when(s.startswith("{"), from_map).when(s.contains(":"), F.lit(None).cast("array<double>")).otherwise(plain)


def offset_map(spec: Column) -> Column:
    """`dev:1.5,dev2:-0.3` or a JSON object as device to offset."""
    s = F.trim(spec)
    pairs = F.str_to_map(s, F.lit(","), F.lit(":"))
    plain = F.transform_values(F.transform_keys(pairs, lambda k, v: F.trim(k)), lambda k, v: F.trim(v).try_cast("double"))
    return F.when(s.startswith("{"), F.from_json(s, "map<string,double>")).otherwise(plain)


def fixed(x: Column, digits: int, sign: str = "") -> Column:
    """The number with that many places, rounded from its exact binary value (ties to even) as in C and Python, null if it is null; `format_string` rounds the shortest decimal form half up (1.0005 to 1.001, not 1.000)."""
    return F.udf(lambda v: None if v is None else format(v, f"{sign}.{digits}f"), "string")(x)
