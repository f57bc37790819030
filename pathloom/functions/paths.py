"""Schema paths as column expressions: RFC 6901 pointers whose item segment is ``[]``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "[]"


def escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape(segment: Column) -> Column:
    """The name behind a segment; a tilde that escapes nothing is an error."""
    name = F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.when(segment.rlike("~(?:[^01]|$)"), F.raise_error(F.concat(F.lit("invalid path segment: "), segment))).otherwise(name)


def join(parent: Column, name: Column) -> Column:
    return F.concat(parent, F.lit("/"), escape(name))


def segments(path: Column) -> Column:
    """Raw segments; the root has none."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(path, "/"), 2, 100_000))


def parent(path: Column) -> Column:
    return F.when(path == "", F.lit(None)).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def within(path: Column, root: Column) -> Column:
    """Whether path is root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """Every prefix of path from its first segment to itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def row_key(path: Column) -> Column:
    """A list and its items share a row."""
    return F.regexp_replace(path, r"(?:/\[\])+$", "")


def enclosing_list(path: Column) -> Column:
    """The row of the list that path is a field of, or null."""
    found = F.regexp_extract(path, r"^(.*)/\[\]/", 1)
    return F.when(path.rlike(r"^.*/\[\]/"), row_key(found))


def glob(pattern: str) -> str:
    """The regular expression of a path rule: each segment a glob of stars, question marks and classes."""
    out = []
    for segment in pattern.split("/"):
        text, i = "", 0
        while i < len(segment):
            c = segment[i]
            close = segment.find("]", i + 2) if c == "[" else -1
            if c == "*":
                text += "[^/]*"
            elif c == "?":
                text += "[^/]"
            elif close > 0:
                body = segment[i + 1 : close].replace("\\", "\\\\")
                text += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = close
            else:
                text += re.escape(c)
            i += 1
        out.append(text)
    return "^" + "/".join(out) + "$"


def matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | path.rlike(glob(pattern))
    return out
