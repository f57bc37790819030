from __future__ import annotations

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pathloom.functions import dates
from pathloom.functions import paths as P
from pathloom.functions import shapes as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "shape"),
    [
        ("", "empty"), ("   ", "empty"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("a@b.co", "email"), ("http://x.y/z", "url"), ("1700000000", "unix_timestamp"),
        ("1700000000000", "unix_timestamp"), ("12", "numeric"), ("-1.5e3", "numeric"), (".5", "numeric"), ("Étage", "alpha"), ("a1", "alphanumeric"), ("a b", "text"), ("99999999999999999999", "numeric"),
    ],
)
def test_string_shapes(spark, value, shape):
    assert one(spark, S.string_shape(F.col("v"), F.lit(False)), v=value) == shape


def test_id_keys_are_not_timestamps(spark):
    for name, is_id in (("id", True), ("user_id", True), ("userId", True), ("ID", True), ("paid", False), ("identity", False)):
        assert one(spark, S.is_id_key(F.col("n")), n=name) == is_id
    assert one(spark, S.string_shape(F.col("v"), F.lit(True)), v="1700000000") == "numeric"
    assert one(spark, S.number_shape(F.col("v"), F.lit(False)), v=1.7e9) == "unix_timestamp"
    assert one(spark, S.number_shape(F.col("v"), F.lit(True)), v=1.7e9) == "plain"


def test_masks(spark):
    assert one(spark, S.mask(F.col("v")), v="anna@example.com") == "axxx@xxxxxxx.xxx"
    assert one(spark, S.mask_name(F.col("v")), v="johndoe_1234") == "xs0"
    assert one(spark, S.pattern_of(F.col("v")), v="message_12_3.json") == "message_{n}_{n}.json"


def test_cells(spark):
    for cell, kind in (("0", "integer"), ("+7", "integer"), ("007", "string"), ("1.", "string"), ("1.e3", "string"), ("1.5", "number"), (".5", "number"), ("1e3", "number"), ("e5", "string"), ("TRUE", "boolean"), ("x", "string"), ("", "string")):
        assert one(spark, S.cell_type(F.col("c")), c=cell) == kind


def test_types_and_comparable_forms(spark):
    assert one(spark, S.type_union(F.array(F.lit("number"), F.lit("integer"), F.lit("null")))) == ["null", "number"]
    assert one(spark, S.comparable("type", F.col("t")), t="string|null|array") == "array|string"
    assert one(spark, S.comparable("shape", F.col("t")), t="mixed") == ""


@pytest.mark.parametrize(
    ("value", "shape", "fits"),
    [
        ("2026-01-02", "date", ["%Y-%m-%d"]), ("01/02/2026", "date", ["%d/%m/%Y", "%m/%d/%Y"]), ("31/01/2026", "date", ["%d/%m/%Y"]), ("31/02/2026", None, []),
        ("2024-05-01T10:20:30Z", "datetime", ["%Y-%m-%dT%H:%M:%SZ"]), ("2024-05-01 10:20:30.123", "datetime", ["%Y-%m-%d %H:%M:%S.%3f"]), ("12:30 PM", "time", ["%I:%M %p"]), ("10:20", "time", ["%H:%M"]),
        ("Mon, 05 Feb 2024 10:00:00 +0000", "datetime", ["%a, %d %b %Y %H:%M:%S %z"]), ("20240101", None, []), ("hello", None, []), ("May 5, 2024", "date", ["%b %d, %Y"]),
    ],
)
def test_dates(spark, value, shape, fits):
    found = one(spark, dates.date_fits(F.col("v")), v=value)
    assert (found.shape, found.fits) == (shape, fits)
    for fmt in fits:
        datetime.strptime(value, one(spark, dates.strptime_format(F.lit(fmt))))


def test_dates_are_those_of_every_format(spark):
    """Each value against strptime with all formats that are made of the known dates, separators, times and zones."""
    days = ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%a, %d %b %Y")
    times = ("%H:%M", "%H:%M:%S", "%H:%M:%S.%f", "%I:%M %p", "%I:%M:%S %p")
    formats = [*days, *times, *(d + s + t + z for d in days for s in ("T", " ", ", ") for t in times for z in ("", "Z", "%z", " %z"))]
    rng = random.Random(6)
    moment = lambda: datetime(rng.choice([1999, 2000, 2024, 2023]), rng.choice([1, 2, 5, 12]), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6), timezone(timedelta(minutes=rng.randrange(-700, 700))))
    values = {moment().strftime(f) for f in formats} | {v[:-1] + rng.choice("09Z") for v in [moment().strftime(f) for f in formats]}
    values |= {"2023-02-29", "2024-02-29", "31.04.2024", "00/01/2024", "24:00", "12:60", "13:00 PM", "0:00 AM", "1:05:61", "2024-01-01T10:00+24:00", "0000-01-01", "Foo 01, 2024", "Xyz, 01 Feb 2024"}
    known = [(f, re.compile("".join(re.escape(c) if i % 2 == 0 else WIDTHS[c] for i, c in enumerate(re.split("%(.)", f))))) for f in formats]
    got = {r.v: r.f for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", dates.date_fits(F.col("v"))["fits"].alias("f")).collect()}
    for v in values:
        want = set()
        for f, widths in known:
            if widths.fullmatch(v):
                try:
                    datetime.strptime(v, f)
                except ValueError:
                    continue
                fraction = re.search(r":\d\d\.(\d+)", v) if "%f" in f else None
                want.add(f.replace("%f", f"%{len(fraction[1])}f") if fraction else f)
        assert got[v] == sorted(want), v


WIDTHS = {"Y": r"\d{4}", "m": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "I": r"\d{1,2}", "M": r"\d{2}", "S": r"\d{2}", "f": r"\d{1,6}", "p": "[AaPp][Mm]", "z": r"[+-]\d{2}:?\d{2}", "b": "[A-Za-z]{3}", "B": "[A-Za-z]{4,}", "a": "[A-Za-z]{3}"}


def test_paths(spark):
    assert one(spark, P.join(F.col("p"), F.col("n")), p="/a", n="x/y~z") == "/a/x~1y~0z"
    assert one(spark, P.unescape(F.col("n")), n="x~1y~0z") == "x/y~z"
    with pytest.raises(Exception, match="invalid path segment"):
        one(spark, P.unescape(F.col("n")), n="x~2")
    assert one(spark, P.ancestors(F.col("p")), p="/a/[]/b") == ["/a", "/a/[]", "/a/[]/b"]
    assert one(spark, P.row_key(F.col("p")), p="/a/[]/[]") == "/a"
    assert one(spark, P.enclosing_list(F.col("p")), p="/a/[]/b/[]/c") == "/a/[]/b"
    assert one(spark, P.enclosing_list(F.col("p")), p="/a/b") is None
    assert one(spark, P.within(F.col("p"), F.lit("/a")), p="/ab") is False
    for path, hit in (("/a/x1/c", True), ("/a/x1/y/c", False), ("/b/x1/c", False)):
        assert one(spark, P.matches(F.col("p"), ["/a/x?/*"]), p=path) == hit
    assert one(spark, P.matches(F.col("p"), ["/[!a]/[xy]"]), p="/b/y") is True
