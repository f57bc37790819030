"""Semantic shapes of values, masks of names, and cell typing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of shapes.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"(?U)^[A-Za-z][A-Za-z0-9+.-]*://\S+$"
NUMERIC = r"(?U)^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: A token: letters and digits, sixteen or more (fixed value).
TOKEN = r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_-]{16,}$"
#: Unicode's white space (fixed value).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Plausible unix seconds: from 1990 on, before 2100.
UNIX_LOW, UNIX_HIGH, UNIX_DIGITS = 631152000, 4102444800, 17
#: Shapes that say nothing, and those whose samples are masked (fixed values).
NOISE = ("mixed", "empty")
MASKED_SHAPES = ("email", "url", "text", "alphanumeric", "uuid")


def strip(value: Column) -> Column:
    """A text without white space at its ends, by its ends alone."""
    return F.btrim(value, F.lit(WHITE))


def is_id_key(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce((low == "id") | low.endswith("_id") | name.rlike("[a-z0-9]Id$"), F.lit(False))


def unix_unit(value: Column) -> Column:
    """s, ms or us if a number is a plausible timestamp in that unit."""
    out = F.lit(None).cast("string")
    for unit, factor in (("us", 1_000_000), ("ms", 1_000), ("s", 1)):
        out = F.when((value >= F.lit(UNIX_LOW * factor)) & (value < F.lit(UNIX_HIGH * factor)), unit).otherwise(out)
    return out


def number_shape(value: Column, id_key: Column) -> Column:
    return F.when(~id_key & unix_unit(value).isNotNull(), "unix_timestamp").otherwise("plain")


def digits_unit(text: Column, id_key: Column) -> Column:
    """The unit of a string of digits that is a plausible timestamp."""
    plain = text.rlike(r"^[0-9]+$") & (F.length(text) <= UNIX_DIGITS) & ~id_key
    return F.when(plain, unix_unit(F.expr("1L") * F.try_to_number(text, F.lit("9" * UNIX_DIGITS)).cast("long")))


def string_shape(value: Column, id_key: Column, date_shape: Column | None = None) -> Column:
    """The first shape that fits a string; date_shape: what date detection found, if anything."""
    return stripped_shape(strip(value), id_key, date_shape)


def stripped_shape(text: Column, id_key: Column, date_shape: Column | None = None) -> Column:
    """The shape of a text that is stripped already: as a column of its own it is stripped once, not in every case."""
    out = F.when(text == "", "empty").when((F.length(text) == 36) & text.rlike(UUID), "uuid").when(text.rlike(EMAIL), "email").when(text.rlike(URL), "url")
    if date_shape is not None:
        out = out.when(date_shape.isNotNull(), date_shape)
    return (
        out.when(digits_unit(text, id_key).isNotNull(), "unix_timestamp")
        .when(text.rlike(NUMERIC), "numeric")
        .when(text.rlike(r"^\p{L}+$"), "alpha")
        .when(text.rlike(r"^[\p{L}\p{N}]+$"), "alphanumeric")
        .otherwise("text")
    )


def mask(value: Column) -> Column:
    """First character kept, other letters x and digits 0."""
    rest = F.regexp_replace(F.regexp_replace(F.substr(value, F.lit(2)), r"\p{L}", "x"), r"\p{Nd}", "0")
    return F.concat(F.left(value, F.lit(1)), rest)


def pattern_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\p{Nd}+", "{n}")


def mask_name(name: Column) -> Column:
    """Runs of letters, digits and other characters as x, 0 and s."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\p{L}", "x"), r"\p{Nd}", "0"), "[^x0]", "s")
    return F.regexp_replace(kinds, r"(.)\1+", "$1")


def is_variable_key(key: Column, date_shape: Column | None = None) -> Column:
    """A key that is data by its shape alone."""
    shape = string_shape(key, F.lit(False), date_shape)
    return key.rlike(r"^\p{Nd}+$") | key.rlike(TOKEN) | shape.isin("uuid", "email", "url", "datetime", "date", "time")


def cell_type(cell: Column) -> Column:
    """The JSON type of a CSV cell: numbers without leading zeros, booleans in any case, else text."""
    return (
        F.when(cell.rlike("^[+-]?(0|[1-9][0-9]*)$"), "integer")
        .when(cell.rlike(r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "number")
        .when(F.lower(cell).isin("true", "false"), "boolean")
        .otherwise("string")
    )


def type_union(types: Column) -> Column:
    """Sorted distinct types; number takes in integer."""
    whole = F.array_sort(F.array_distinct(types))
    return F.when(F.array_contains(whole, "number"), F.array_remove(whole, "integer")).otherwise(whole)


def comparable(field: str, value: Column) -> Column:
    """The form in which a field is compared; the empty string for what only reflects the data."""
    if field == "type":
        parts = F.filter(F.split(value, r"\|"), lambda t: (t != "") & (t != "null"))
        return F.array_join(F.array_sort(parts), "|")
    return F.when(value.isin(*NOISE), "").otherwise(value) if field == "shape" else value
