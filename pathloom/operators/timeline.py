"""What is new, changed, missing or known in an upload, compared with those requested strictly earlier.

Tables: uploads (platform, upload_id, requested_at, registered, ...), observations (platform, upload_id, location, kind,
type, shape, format, is_data_point). Request dates decide, never the order of registration, so late rows need no
special care: everything is recomputed from first dates, which are minima per key and not joins of all pairs of uploads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.operators.ordering import numbered

FIELDS = ("kind", "type", "shape", "format")
KEY = ["platform", "upload_id", "location"]


def dated(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """observations with their upload's requested_at and registered."""
    return observations.join(uploads.select("platform", "upload_id", "requested_at", "registered"), ["platform", "upload_id"])


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., first_at): when registered uploads first had each key."""
    return rows.where("registered").groupBy(*keys).agg(F.min("requested_at").alias("first_at"))


def new_in(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """Observations (platform, upload_id, location) that no strictly earlier registered upload has."""
    rows = dated(observations, uploads)
    first = first_seen(rows, ["platform", "location"])
    late = F.col("first_at").isNull() | (F.col("first_at") >= F.col("requested_at"))
    return rows.join(first, ["platform", "location"], "left").where(late).select(*KEY)


def long_fields(rows: DataFrame) -> DataFrame:
    """One row per observation and field, in its comparable form."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_no"), S.comparable(f, F.coalesce(F.col(f), F.lit(""))).alias("value")) for i, f in enumerate(FIELDS)))
    return rows.select(*KEY, "requested_at", "registered", F.explode(pairs).alias("x")).select(*KEY, "requested_at", "registered", "x.*")


def changes(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, upload_id, location, field, now, before) of fields whose value no earlier registered upload had.

    Locations that are new don't change; empty values never count. before: the earlier values, sorted, without noise.
    """
    rows = dated(observations, uploads)
    values = long_fields(rows)
    key = ["platform", "location", "field"]
    # before a date: values whose first date is earlier; a location has few different values, not few uploads
    firsts = first_seen(values, [*key, "value"])
    history = firsts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("value", "first_at"))).alias("history"))
    found = values.where("value <> ''").join(history, key)
    earlier = F.filter("history", lambda h: h["first_at"] < F.col("requested_at"))
    found = found.withColumn("earlier", F.transform(earlier, lambda h: h["value"]))
    found = found.where((F.size("earlier") > 0) & ~F.array_contains("earlier", F.col("value")))
    return found.select(*KEY, "field", F.col("value").alias("now"), F.filter("earlier", lambda v: v != "").alias("before"))


def changed_names(change: DataFrame) -> DataFrame:
    """(platform, upload_id, location, fields) with fields in their fixed order."""
    order = F.array(*map(F.lit, FIELDS))
    return change.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("field")).alias("i"), "field"))), lambda x: x["field"]).alias("fields"))


def scopes(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, upload_id, location, scope) of data points: new, or known if nothing changed; others have none."""
    points = observations.where("is_data_point").select(*KEY).distinct()
    new = new_in(observations, uploads).distinct().withColumn("is_new", F.lit(True))
    changed = changes(observations, uploads).select(*KEY).distinct().withColumn("is_changed", F.lit(True))
    rows = points.join(new, KEY, "left").join(changed, KEY, "left")
    return rows.withColumn("scope", F.when(F.col("is_new"), "new").when(F.col("is_changed").isNull(), "known")).where("scope is not null").select(*KEY, "scope")


def missing(locations: DataFrame, observations: DataFrame, uploads: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(platform, upload_id, location) whose annotation the upload has nowhere.

    locations: (platform, location, annotation, path, parent_path). Items of lists that the upload has are only absent;
    matched (platform, upload_id, path) are annotated paths that an unassigned data point likely stands for.
    """
    named = locations.where("annotation is not null")
    present = observations.select(*KEY).join(locations, ["platform", "location"])
    has = present.where("annotation is not null").select("platform", "upload_id", "annotation").distinct()
    wanted = uploads.select("platform", "upload_id").join(named.select("platform", "annotation").distinct(), "platform")
    gone = wanted.join(has, ["platform", "upload_id", "annotation"], "left_anti").join(named, ["platform", "annotation"])
    lists = present.select("platform", "upload_id", F.col("path").alias("parent_path")).distinct()
    items = gone.where(F.endswith(F.col("path"), F.lit("/[]"))).join(lists, ["platform", "upload_id", "parent_path"], "left_semi").select(*KEY)
    gone = gone.join(items, KEY, "left_anti")
    if matched is not None:
        gone = gone.join(matched, ["platform", "upload_id", "path"], "left_anti")
    return gone.select(*KEY)


def latest(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """The observation of each location in the latest registered upload that has it, ties by upload id."""
    rows = dated(observations, uploads).where("registered")
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("platform", "location")]), F.struct("requested_at", "upload_id"))
    return rows.groupBy("platform", "location").agg(last.alias("x")).select("platform", "location", "x.*")


def history(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """Observations of registered uploads numbered by date for each location."""
    rows = dated(observations, uploads).where("registered")
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("platform", "location").orderBy("requested_at", "upload_id")))


def field_counts(rows: DataFrame) -> DataFrame:
    """(platform, location, field, value, n): histogram of each field, empty values left out but for kinds."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in FIELDS))
    return rows.select("platform", "location", F.explode(pairs).alias("x")).where("x.field = 'kind' or x.value <> ''").groupBy("platform", "location", F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def profiles(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row per location: uploads, first and last date, main values (ties by value), variants, shape_hint."""
    rows = dated(observations, uploads).where("registered")
    base = rows.groupBy("platform", "location").agg(F.count_distinct("upload_id").alias("uploads"), F.min("requested_at").alias("first_seen"), F.max("requested_at").alias("last_seen"), F.max("is_data_point").alias("is_data_point"))
    counts = field_counts(rows).groupBy("platform", "location", "field").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("main"), F.count("*").alias("kinds"))
    main = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("main"))), F.lit("")).alias(f"main_{f}") for f in FIELDS]
    variants = F.coalesce(F.sum(F.when(F.col("field") != "kind", F.col("kinds") - 1)), F.lit(0)).alias("variants")
    out = base.join(counts.groupBy("platform", "location").agg(*main, variants), ["platform", "location"])
    hint = F.when(F.col("main_shape").isin("plain", "text"), "").otherwise(F.col("main_shape"))
    return out.withColumn("shape_hint", hint).withColumn("is_list", (F.col("main_kind") == "data") & (S.comparable("type", F.col("main_type")) == "array"))


def with_children(locations: DataFrame, observations: DataFrame) -> DataFrame:
    """(platform, path, has_children, item_types) of locations (platform, path), from what was observed below them.

    observations: (platform, path, parent_path, type) of the uploads that count. item_types: (type, n) of a list's items,
    most first, ties by type. Counts come before the join, so a location of very many observations is one row.
    """
    item = F.endswith("path", F.lit("/[]")) & (F.coalesce("type", F.lit("")) != "")
    counts = observations.where("parent_path is not null").groupBy("platform", F.col("parent_path").alias("path"), F.when(item, F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    types = F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("m"), "type", "n"))))
    below = counts.groupBy("platform", "path").agg(F.transform(types, lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("item_types"), F.lit(True).alias("has_children"))
    none = F.array().cast("array<struct<type: string, n: bigint>>")
    return locations.select("platform", "path").distinct().join(below, ["platform", "path"], "left").select("platform", "path", F.coalesce("has_children", F.lit(False)).alias("has_children"), F.coalesce("item_types", none).alias("item_types"))


def filtered_uploads(uploads: DataFrame, since: str | None = None, until: str | None = None, languages: list[str] | None = None, request_format: str = "", root_format: str = "") -> DataFrame:
    """Registered uploads that pass a filter; both dates inclusive; request_format unknown stands for none given."""
    out = uploads.where("registered")
    if since:
        out = out.where(F.col("requested_at") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.col("requested_at") <= F.lit(until).cast("date"))
    if languages:
        out = out.where(F.col("language").isin(languages))
    if request_format:
        out = out.where(F.col("request_format") == ("" if request_format == "unknown" else request_format))
    return out.where(F.col("root_format") == root_format) if root_format else out


def filtered_observations(observations: DataFrame, uploads: DataFrame) -> DataFrame:
    return observations.join(uploads.select("platform", "upload_id"), ["platform", "upload_id"], "left_semi")


def format_ranking(uploads: DataFrame, column: str) -> DataFrame:
    """(platform, format, n, rank) of registered uploads, most common first, ties by name; none given is unknown."""
    named = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    counts = uploads.where("registered").groupBy("platform", named.alias("format")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("platform").orderBy(F.desc("n"), "format")))


def overview(locations: DataFrame, observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, annotations, uploads, data_points, last_registered): branches are counted apart, then joined."""
    names = locations.where("annotation is not null").groupBy("platform").agg(F.count_distinct("annotation").alias("annotations"))
    counted = uploads.where("registered").groupBy("platform").agg(F.count("*").alias("uploads"), F.max("requested_at").alias("last_registered"))
    points = dated(observations, uploads).where("registered and is_data_point").groupBy("platform").agg(F.count_distinct("location").alias("data_points"))
    every = uploads.select("platform").distinct().join(names, "platform", "left").join(counted, "platform", "left").join(points, "platform", "left")
    return every.na.fill(0, ["annotations", "uploads", "data_points"])


def file_order(locations: DataFrame) -> DataFrame:
    """(platform, path, place): depth first, siblings by position and then path."""
    ups = locations.select("platform", "path", F.posexplode(P.ancestors(F.col("path"))).alias("i", "up"))
    known = locations.select("platform", F.col("path").alias("up"), "position")
    rows = ups.join(known, ["platform", "up"], "left").groupBy("platform", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("position", F.lit(0)).alias("p"), "up"))), lambda x: F.struct(x["p"].alias("p"), x["up"].alias("up"))).alias("order"))
    return numbered(rows, ["platform"], [F.asc("order"), F.asc("path")]).drop("order")


def alphabetical_order(locations: DataFrame) -> DataFrame:
    """(platform, path, place): by parts in lower case, then as they are."""
    parts = F.split("path", "/")
    rows = locations.select("platform", "path", F.transform(parts, F.lower).alias("low"), parts.alias("parts"))
    return numbered(rows, ["platform"], [F.asc("low"), F.asc("parts")]).drop("low", "parts")
