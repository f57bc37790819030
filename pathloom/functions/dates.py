"""Date, time and datetime formats that a string fits, as an Arrow function over distinct strings.

A value is cut once into a date's head, if it has one, and the rest; the head's numbers say which dates it can be, the
rest is one time or none. So no format is tried: each comes out of the parts.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest value and fewest digits that can be a date, and its characters (fixed values).
LONGEST, FEWEST_DIGITS = 40, 3
PLAUSIBLE = re.compile(r"[0-9A-Za-z][0-9A-Za-z :.,/+\-]*")
#: Names of months and days, by which %b, %B and %a are told (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Dates: year first; year last; month by name, day, year; day, month by name, year, maybe after a weekday. Then the rest.
HEAD = re.compile(r"(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})|([A-Za-z]{3,}) (\d{1,2}), (\d{4})|(?:([A-Za-z]{3}), )?(\d{1,2}) ([A-Za-z]{3,}) (\d{4}))?(.*)", re.ASCII)
#: Times: separator from the date, hour, minute, second, fraction, half of the day, zone.
TAIL = re.compile(r"(T|, | )?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?( [AaPp][Mm])?(Z| ?[+-]\d{2}:?\d{2})?", re.ASCII)


def _exists(year: int, month: int, day: int) -> bool:
    return year >= 1 and 1 <= month <= 12 and 1 <= day <= monthrange(max(year, 1), month)[1]


def _month(name: str) -> int:
    """Number of a month by its name, short (three letters) or whole; 0 for none."""
    names = [m[:3] for m in MONTHS] if len(name) == 3 else list(MONTHS)
    return names.index(name.lower()) + 1 if name.lower() in names else 0


def _dates(g: tuple[str | None, ...]) -> list[str]:
    """Formats of the date at the head of a value, by its groups: those whose day exists."""
    if g[0]:
        return [f"%Y{g[1]}%m{g[1]}%d"] if _exists(int(g[0]), int(g[2]), int(g[3])) else []
    if g[7]:
        a, sep, b, year = int(g[4]), g[5], int(g[6]), int(g[7])
        found = [f"%d{sep}%m{sep}%Y"] if _exists(year, b, a) else []
        return found + ([f"%m{sep}%d{sep}%Y"] if sep != "." and _exists(year, a, b) else [])
    if g[8]:
        return [("%b" if len(g[8]) == 3 else "%B") + " %d, %Y"] if _exists(int(g[10]), _month(g[8]), int(g[9])) else []
    weekday, day, name, year = g[11], int(g[12]), g[13], int(g[14])
    if not _exists(year, _month(name), day) or (weekday and (weekday.lower() not in DAYS or len(name) != 3)):
        return []
    return [("%a, " if weekday else "") + ("%d %b %Y" if len(name) == 3 else "%d %B %Y")]


def _time(text: str) -> tuple[str, str, str] | None:
    """(separator, format, zone's format) of a time; fractions of n digits are written %<n>f."""
    m = TAIL.fullmatch(text)
    if not m:
        return None
    separator, hour, minute, second, fraction, half, zone = m.groups()
    offset = int(re.sub(r"\D", "", zone or "") or 0)
    right = int(hour) <= 23 if not half else 1 <= int(hour) <= 12 and not fraction
    if not right or int(minute) > 59 or int(second or 0) > 59 or offset >= 2400 or offset % 100 > 59:
        return None
    written = ("%I" if half else "%H") + ":%M" + (":%S" if second else "") + (f".%{len(fraction)}f" if fraction else "") + (" %p" if half else "")
    return separator or "", written, "" if not zone else "Z" if zone == "Z" else " %z" if zone[0] == " " else "%z"


def formats_of(value: str) -> tuple[str | None, list[str]]:
    """(shape, sorted formats) of a stripped string: datetime, date, time or none."""
    if len(value) > LONGEST or not PLAUSIBLE.fullmatch(value) or len(re.sub(r"[^0-9]", "", value)) < FEWEST_DIGITS:
        return None, []
    *groups, rest = HEAD.fullmatch(value).groups()
    has_date = any(groups)
    days = _dates(tuple(groups)) if has_date else []
    if has_date and not rest:
        return ("date" if days else None), sorted(days)
    time = _time(rest)
    if time is None or bool(time[0]) != has_date or (not has_date and time[2]):
        return None, []
    fits = [d + "".join(time) for d in days] if has_date else [time[1]]
    return (("datetime" if has_date else "time") if fits else None), sorted(fits)


@F.pandas_udf(T.StructType([T.StructField("shape", T.StringType()), T.StructField("fits", T.ArrayType(T.StringType()))]))
def date_fits(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Shape and fitting formats of each stripped string; each distinct value of a batch is looked at once."""
    for series in values:
        known = {v: formats_of(v) if isinstance(v, str) else (None, []) for v in series.unique()}
        yield pd.DataFrame({"shape": [known[v][0] for v in series], "fits": [known[v][1] for v in series]})


def strptime_format(fmt: Column) -> Column:
    """A format as it is given to strptime: %<n>f is %f there."""
    return F.regexp_replace(fmt, "%[1-6]f", "%f")
