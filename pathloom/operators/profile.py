"""Schema inference: occurrences of values aggregated to one node per path with statistics.

Every aggregate is a commutative one, so map-side partial aggregation reduces occurrences to a row per path before the
shuffle; order-dependent parts (sibling position, samples) carry the order as a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import shapes as S
from pathloom.functions.dates import date_fits

THRESHOLD, MAX_SAMPLES = 0.95, 3


def classified(occurrences: DataFrame, with_dates: bool = True) -> DataFrame:
    """occurrences with shape and fits: the formats that a value fits (dates, or the unit of a timestamp)."""
    id_key = S.is_id_key(F.col("name"))
    rows = occurrences.withColumn("_text", F.when(F.col("json_type") == "string", S.strip(F.col("s"))))
    if with_dates:
        # Only what can be a date goes to Python: short, three digits or more, date-like characters.
        maybe = (F.length("_text") <= 40) & F.col("_text").rlike(r"^[0-9A-Za-z][0-9A-Za-z :.,/+\-]*$") & F.col("_text").rlike(r"(?:[0-9][^0-9]*){3}")
        rows = rows.withColumn("_date", date_fits(F.when(maybe, F.col("_text"))))
        found, fits = F.col("_date.shape"), F.col("_date.fits")
    else:
        found, fits = F.lit(None).cast("string"), F.array().cast("array<string>")
    is_number = F.col("json_type").isin("integer", "number")
    shape = F.when(F.col("json_type") == "string", S.stripped_shape(F.col("_text"), id_key, found)).when(is_number, S.number_shape(F.col("n"), id_key))
    unit = F.when(is_number, S.unix_unit(F.col("n"))).otherwise(S.digits_unit(F.col("_text"), id_key))
    rows = rows.withColumn("shape", shape)
    fitting = F.when(F.col("shape") == "unix_timestamp", F.array(unit)).when(F.col("shape").isin("datetime", "date", "time"), fits)
    return rows.withColumn("fits", fitting).drop("_text", "_date")


def dominant(counts: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(keys..., shape) from (keys..., shape, n): the shape of enough of the values that aren't empty, else mixed.

    Of shapes with as many values the first by name wins, which only matters for thresholds of a half or less.
    """
    full = F.sum(F.when(F.col("shape") != "empty", F.col("n")))
    top = F.max(F.when(F.col("shape") != "empty", F.struct(F.col("n"), F.col("shape"))))
    first = F.min_by(F.col("shape"), F.struct(-F.col("n"), F.col("shape"))).alias("_all")
    rows = counts.groupBy(*keys).agg(full.alias("_full"), top["n"].alias("_n"), F.min(F.when(F.col("shape") != "empty", F.struct((-F.col("n")).alias("m"), F.col("shape")))).alias("_top"), first)
    shape = F.when(F.col("_full").isNull(), "empty").when(F.col("_n") / F.col("_full") >= threshold, F.col("_top.shape")).otherwise("mixed")
    return rows.select(*keys, shape.alias("shape"))


def resolved_formats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., format, formats, ambiguous) from (keys..., fits, n) of values of the dominant shape.

    A single format that all values fit is the format; several are ambiguous and all counted in full; without any,
    each value counts for the first of its formats.
    """
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("_total"))
    each = rows.select(*keys, "n", F.explode("fits").alias("f"), (F.element_at("fits", 1) == F.col("f")).alias("_first"))
    per = each.groupBy(*keys, "f").agg(F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(F.col("_first"), F.col("n"))), F.lit(0)).alias("_least"))
    per = per.join(totals, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("_total"), F.struct("f", F.col("_n").alias("n"))))).alias("_common"),
        F.array_sort(F.collect_list(F.when(F.col("_least") > 0, F.struct("f", F.col("_least").alias("n"))))).alias("_each"),
    )
    many = F.size("_common")
    return per.select(
        *keys,
        F.when(many == 1, F.col("_common")[0]["f"]).alias("format"),
        F.when(many > 1, F.col("_common")).when(many == 0, F.col("_each")).alias("formats"),
        (many > 1).alias("ambiguous"),
    )


def _total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda total, c: total + c["n"])


def shape_counts(cells: Column) -> Column:
    """Sorted (shape, n) of cells, an array of (type, shape, fits, n) of one path."""
    names = F.array_sort(F.array_distinct(F.transform(F.filter(cells, lambda c: c["shape"].isNotNull()), lambda c: c["shape"])))
    return F.transform(names, lambda name: F.struct(name.alias("shape"), _total(F.filter(cells, lambda c: c["shape"] == name)).alias("n")))


def dominant_of(shapes: Column, threshold: float = THRESHOLD) -> Column:
    """The dominant shape of sorted (shape, n) counts, by the rule of dominant()."""
    real = F.filter(shapes, lambda s: s["shape"] != "empty")
    top = F.element_at(F.array_sort(F.transform(real, lambda s: F.struct((-s["n"]).alias("m"), s["shape"].alias("shape")))), 1)
    share = -top["m"] / F.greatest(_total(real), F.lit(1))
    return F.when(F.size(shapes) == 0, None).when(F.size(real) == 0, "empty").when(share >= threshold, top["shape"]).otherwise("mixed")


def format_counts(cells: Column, shape: Column) -> tuple[Column, Column, Column]:
    """(total, formats that all values of the shape fit, formats that each value would count for), by the rule of resolved_formats()."""
    rows = F.filter(cells, lambda c: (c["shape"] == shape) & (F.size(c["fits"]) > 0))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda c: c["fits"]))))
    common = F.filter(names, lambda f: F.forall(rows, lambda c: F.array_contains(c["fits"], f)))
    first = F.transform(names, lambda f: F.struct(f.alias("f"), _total(F.filter(rows, lambda c: c["fits"][0] == f)).alias("n")))
    return _total(rows), common, F.filter(first, lambda x: x["n"] > 0)


def nodes(occurrences: DataFrame, threshold: float = THRESHOLD, samples: int = 0, with_dates: bool = True) -> DataFrame:
    """One node per (doc_id, path): position among siblings, types, shape, format, length, range and counts.

    n_count is the number of objects at the parent (of values for items and roots), so n_present < n_count marks an
    optional key. Ranges are given with samples only. Up to samples distinct values are kept, in order of appearance,
    those of identifying shapes masked. Occurrences are read once: they are counted per path, type, shape and fits,
    and all that follows works on these counts, of which a path has a few.
    """
    key = ["doc_id", "path"]
    rows = classified(occurrences.where("json_type <> 'unreadable'"), with_dates).withColumn("number", F.col("n"))
    long = F.col("json_type").isin("string", "array")
    counted = rows.groupBy(*key, "json_type", "shape", "fits").agg(
        F.first("parent_path").alias("parent_path"),
        F.first("name").alias("name"),
        F.min("ord").alias("ord"),
        F.count("*").alias("count"),
        F.min(F.when(long, F.col("size"))).alias("length_min"),
        F.max(F.when(long, F.col("size"))).alias("length_max"),
        F.min("number").alias("range_min"),
        F.max("number").alias("range_max"),
    ).withColumnRenamed("count", "n")
    of_type = lambda t: F.coalesce(F.sum(F.when(F.col("json_type") == t, F.col("n"))), F.lit(0))
    base = counted.groupBy(*key).agg(
        F.first("parent_path").alias("parent_path"),
        F.first("name").alias("name"),
        F.min("ord").alias("_ord"),
        S.type_union(F.collect_set("json_type")).alias("type"),
        F.sum("n").alias("n_present"),
        of_type("null").alias("n_null"),
        of_type("object").alias("n_objects"),
        F.min("length_min").alias("length_min"),
        F.max("length_max").alias("length_max"),
        F.min("range_min").alias("range_min"),
        F.max("range_max").alias("range_max"),
        F.collect_list(F.struct("shape", "fits", "n")).alias("_cells"),
    )
    base = base.withColumn("shapes", shape_counts(F.col("_cells")))
    base = base.withColumn("shape", dominant_of(F.col("shapes"), threshold)).withColumn("shapes", F.when(F.size("shapes") > 0, F.col("shapes")))
    total, common, each = format_counts(F.col("_cells"), F.col("shape"))
    base = base.withColumns({"_total": total, "_common": common, "_each": each})
    everywhere = F.transform("_common", lambda f: F.struct(f.alias("f"), F.col("_total").alias("n")))
    has = F.col("_total") > 0
    base = base.withColumn("format", F.when(F.size("_common") == 1, F.col("_common")[0]))
    base = base.withColumn("formats", F.when(has & (F.size("_common") > 1), everywhere).when(has & (F.size("_common") == 0), F.col("_each")))
    base = base.withColumn("ambiguous", F.when(has, F.size("_common") > 1)).drop("_cells", "_total", "_common", "_each")
    up = base.select("doc_id", F.col("path").alias("parent_path"), F.col("n_objects").alias("_objects"))
    out = base.join(up, ["doc_id", "parent_path"], "left")
    own = F.col("parent_path").isNull() | F.col("path").endswith("/[]")
    position = F.row_number().over(W.partitionBy("doc_id", "parent_path").orderBy("_ord")) - 1
    out = out.withColumn("n_count", F.when(own, F.col("n_present")).otherwise(F.col("_objects"))).withColumn("position", position)
    if samples:
        out = out.join(sampled(rows, samples), key, "left")
    else:
        out = out.drop("range_min", "range_max")
    return out.drop("_ord", "_objects")


def sampled(rows: DataFrame, k: int = MAX_SAMPLES, masked: tuple[str, ...] = S.MASKED_SHAPES) -> DataFrame:
    """(doc_id, path, samples, redacted): the first k values that differ by type and text."""
    scalar = rows.where("json_type in ('string', 'integer', 'number', 'boolean')")
    first = scalar.groupBy("doc_id", "path", "json_type", "s").agg(F.min("ord").alias("ord"), F.first("shape").alias("shape"))
    rank = F.row_number().over(W.partitionBy("doc_id", "path").orderBy("ord"))
    hide = (F.col("json_type") == "string") & F.col("shape").isin(*masked)
    kept = first.withColumn("r", rank).where(F.col("r") <= k).withColumn("v", F.when(hide, S.mask(F.col("s"))).otherwise(F.col("s")))
    return kept.groupBy("doc_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("samples"), F.max(hide).alias("redacted"))


def warnings(found: DataFrame) -> DataFrame:
    """(doc_id, code, path): formats that can't be told apart, and keys that share a path with list items."""
    ambiguous = found.where("ambiguous").select("doc_id", F.lit("ambiguous_date_order").alias("code"), "path")
    reserved = found.where("name = '[]'").select("doc_id", F.lit("reserved_name").alias("code"), "path")
    return ambiguous.union(reserved)


def is_data_point(kind: Column, path: Column, types: Column) -> Column:
    """Nodes that carry meaning: media, values and lists in parsed content, items, and files that are lists."""
    real = F.array_remove(types, "null")
    return (
        F.when(kind == "media", True)
        .when(path.endswith("/[]"), kind == "data")
        .when(kind == "file", F.array_contains(types, "array"))
        .otherwise((kind == "data") & ~((F.size(real) == 1) & F.array_contains(real, "object")))
    )
