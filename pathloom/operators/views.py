"""What the explorer and review pages show: rows of a tree, labels, filters on text, and the JSON skeleton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P

#: Words for kinds and types (fixed values).
KIND_WORDS = {"container": "archive", "folder": "folder", "media": "media file", "unmatched": "unreadable file"}
TYPE_WORDS = {"string": ("text", "texts"), "integer": ("integer", "integers"), "number": ("number", "numbers"), "boolean": ("true/false", "true/false values"), "object": ("object", "objects"), "array": ("list", "lists")}


def _types(type_label: Column) -> Column:
    return F.filter(F.split(F.coalesce(type_label, F.lit("")), r"\|"), lambda t: (t != "") & (t != "null"))


def _words(types: Column, form: int) -> Column:
    pairs = [x for t, words in TYPE_WORDS.items() for x in (F.lit(t), F.lit(words[form]))]
    known = F.create_map(*pairs)
    return F.array_join(F.transform(types, lambda t: F.coalesce(F.try_element_at(known, t), t)), " or ")


def plain_label(kind: Column, type_label: Column, path: Column, item_type: Column, empty: Column, single: Column) -> Column:
    """A node in plain words: what a list holds, a group of keys, a value, or what a file is."""
    types, items = _types(type_label), _types(item_type)
    nullable = F.array_contains(F.split(F.coalesce(type_label, F.lit("")), r"\|"), "null")
    or_empty = F.when(nullable, " (or empty)").otherwise("")
    listed = F.when(F.size(items) > 0, F.concat(F.lit("list of "), _words(items, 1))).when(single, "empty list").otherwise("list (always empty so far)")

    def value(of: Column, may_be_empty: Column, has_no_keys: Column) -> Column:
        group = F.when(F.endswith(path, F.lit("/[]")), "object").otherwise("group of keys")
        without = F.concat(group, F.when(single, " (empty)").otherwise(" (always empty so far)"))
        is_group = (F.size(of) == 1) & (of[0] == "object")
        words = F.when(is_group & has_no_keys, without).when(is_group, F.concat(group, may_be_empty)).otherwise(F.concat(_words(of, 0), may_be_empty))
        return F.when((F.size(of) == 0) & (may_be_empty != ""), "empty").when(F.size(of) == 0, "").otherwise(words)

    is_list = F.array_contains(types, "array")
    label = F.when(is_list & (F.size(types) == 1), F.concat(listed, or_empty))
    label = label.when(is_list, F.concat(listed, F.lit(" or "), value(F.array_remove(types, "array"), F.lit(""), F.lit(False))))
    label = label.otherwise(value(types, or_empty, empty))
    out = F.lit(None).cast("string")
    for k, word in KIND_WORDS.items():
        out = F.when(kind == k, word).otherwise(out)
    return F.when(out.isNotNull(), out).when((kind == "file") & (label != ""), F.concat(F.lit("file: "), label)).when(kind == "file", "file").otherwise(label)


def type_badge(type_label: Column, shape: Column) -> Column:
    """list, a telling shape, or the types, with a question mark if the value may be null."""
    types = _types(type_label)
    nullable = F.array_contains(F.split(F.coalesce(type_label, F.lit("")), r"\|"), "null")
    telling = shape.isNotNull() & ~shape.isin("", "plain", "text", "mixed", "empty")
    badge = F.when(F.array_contains(types, "array"), "array").when(telling, shape).otherwise(F.array_join(types, "|"))
    return F.concat(badge, F.when(nullable, "?").otherwise(""))


def muted(rows: DataFrame) -> DataFrame:
    """rows (platform, path, parent_path, kind, type) with muted: leaves that hold nothing of their own."""
    parents = rows.select("platform", F.col("parent_path").alias("path")).where("path is not null").distinct().withColumn("_parent", F.lit(True))
    hollow = F.col("kind").isin("unmatched", "file") | ((F.col("kind") == "data") & F.array_contains(F.split(F.coalesce("type", F.lit("")), r"\|"), "object"))
    return rows.join(parents, ["platform", "path"], "left").withColumn("muted", F.col("_parent").isNull() & (F.col("path") != "") & hollow).drop("_parent")


def matching(rows: DataFrame, text: str) -> DataFrame:
    """Rows (platform, path, name) that hold text in name or path, what lies below them, and the lists above them."""
    q = F.lit(text.lower())
    hits = rows.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), q) | F.contains(F.lower("path"), q)).select("platform", "path")
    below = rows.select("platform", "path", F.explode(P.ancestors(F.col("path"))).alias("up")).join(hits.withColumnRenamed("path", "up"), ["platform", "up"], "left_semi").select("platform", "path")
    above = hits.select("platform", F.explode(P.ancestors(F.col("path"))).alias("path"))
    return rows.join(below.union(above).distinct(), ["platform", "path"], "left_semi")


def tree_rows(rows: DataFrame) -> DataFrame:
    """(platform, row, members, group_path, depth): a list and its items share a row, fields lie below their list."""
    keyed = rows.withColumn("row", P.row_key(F.col("path"))).withColumn("list", P.enclosing_list(F.col("path")))
    out = keyed.groupBy("platform", "row").agg(F.count("*").alias("members"), F.max("list").alias("list"), F.count_if("open").alias("open"))
    lists = F.size(F.filter(P.segments(F.col("row")), lambda s: s == "[]"))
    return out.select("platform", "row", "members", "list", P.parent(F.col("row")).alias("group_path"), lists.alias("depth"), "open")


def group_totals(rows: DataFrame) -> DataFrame:
    """(platform, group_path, n_rows, open, is_first): open rows of each group, and which group opens first."""
    out = rows.groupBy("platform", "group_path").agg(F.count("*").alias("n_rows"), F.sum("open").alias("open"))
    first = F.row_number().over(W.partitionBy("platform").orderBy(F.col("open") == 0, "group_path")) == 1
    return out.withColumn("is_first", first & (F.col("open") > 0))


def skeleton(rows: list[tuple[str, str, str]], focus: str) -> str:
    """The JSON around a path, as text: its ancestors and siblings with types for values.

    rows: (path, parent path, type) of one document in file order, which is schema-sized and read by one person.
    """
    import json

    below: dict[str, list[tuple[str, str]]] = {}
    kinds = {}
    for path, up, kind in rows:
        below.setdefault(up, []).append((path, kind))
        kinds[path] = kind
    chain = {focus[:i] for i in range(1, len(focus)) if focus[i] == "/"} | {focus, ""}

    def text(path: str, kind: str, indent: int) -> str:
        pad = "  " * (indent + 1)
        inside = below.get(path, [])
        if "array" in kind:
            items = [text(p, k, indent + 1) for p, k in inside]
            return f"[\n{pad}{items[0]}\n{'  ' * indent}]" if items and path in chain else "[…]" if items else "[]"
        if "object" in kind or inside:
            if path not in chain:
                return "{…}" if inside else "{}"
            lines = [f"{pad}{json.dumps(p.rpartition('/')[2].replace('~1', '/').replace('~0', '~'), ensure_ascii=False)}: {text(p, k, indent + 1)}" for p, k in inside]
            return "{\n" + ",\n".join(lines) + f"\n{'  ' * indent}}}" if lines else "{}"
        return f"<{kind}>"

    return text("", kinds.get("", "object"), 0)
