"""The driver's tables read as schemas over time, once as DataFrames and once as SQL.

A platform is an event type, an upload is a day of it, a location is a user: what was observed there is bucketed from
values. Paths come from page addresses; documents with their labels are objects with optional keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import paths as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("ts").cast("date").alias("day"), F.col("user_id").alias("location"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = e.groupBy("platform", "day", "location").agg(F.max("value").alias("v"), F.min("k").alias("k"))
    return rows.select(
        "platform",
        F.col("day").cast("string").alias("upload_id"),
        "location",
        F.lit("data").alias("kind"),
        F.expr("CASE WHEN v >= 100 THEN 'null|number' WHEN v >= 40 THEN 'number' WHEN v >= 39 THEN 'array' ELSE 'integer' END").alias("type"),
        F.expr("CASE k % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'mixed' WHEN 2 THEN 'numeric' WHEN 3 THEN 'empty' ELSE '' END").alias("shape"),
        F.expr("CASE WHEN k % 7 = 0 THEN '%Y-%m-%d' ELSE '' END").alias("format"),
        (F.col("v") < 200).alias("is_data_point"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("ts").cast("date").alias("requested_at")).distinct()
    day = F.dayofmonth("requested_at")
    return days.select(
        "platform",
        F.col("requested_at").cast("string").alias("upload_id"),
        "requested_at",
        (day % 9 != 0).alias("registered"),
        F.expr("CASE day(requested_at) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END").alias("language"),
        F.expr("CASE WHEN day(requested_at) % 4 = 0 THEN '' ELSE 'json' END").alias("request_format"),
        F.expr("CASE WHEN day(requested_at) % 5 < 3 THEN 'zip' ELSE 'csv' END").alias("root_format"),
    )


OBSERVATIONS = """
e AS (SELECT event_type AS platform, CAST(ts AS DATE) AS day, user_id AS location, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT platform, day, location, max(value) AS v, min(k) AS k FROM e GROUP BY ALL),
obs AS (SELECT platform, CAST(day AS VARCHAR) AS upload_id, day AS requested_at, location, 'data' AS kind,
  CASE WHEN v >= 100 THEN 'null|number' WHEN v >= 40 THEN 'number' WHEN v >= 39 THEN 'array' ELSE 'integer' END AS type,
  CASE k % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'mixed' WHEN 2 THEN 'numeric' WHEN 3 THEN 'empty' ELSE '' END AS shape,
  CASE WHEN k % 7 = 0 THEN '%Y-%m-%d' ELSE '' END AS format, v < 200 AS is_data_point, day(day) % 9 <> 0 AS registered FROM g),
up AS (SELECT DISTINCT event_type AS platform, CAST(CAST(ts AS DATE) AS VARCHAR) AS upload_id, CAST(ts AS DATE) AS requested_at, day(ts) % 9 <> 0 AS registered,
  CASE day(ts) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END AS language, CASE WHEN day(ts) % 4 = 0 THEN '' ELSE 'json' END AS request_format,
  CASE WHEN day(ts) % 5 < 3 THEN 'zip' ELSE 'csv' END AS root_format FROM events)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per platform and user: users of the same two last digits share an annotation, every third has none."""
    users = observations(spark, sf_dir).select("platform", "location").distinct()
    path = F.concat(F.lit("/files/u"), (F.col("location") % 10).cast("string"), F.when(F.col("location") % 4 == 0, F.lit("/[]/")).otherwise(F.lit("/")), F.col("location").cast("string"), F.when(F.col("location") % 5 == 0, F.lit("/[]")).otherwise(F.lit("")))
    return users.select("platform", "location", path.alias("path"), F.when(F.col("location") % 3 != 0, F.concat(F.lit("a"), (F.col("location") % 17).cast("string"))).alias("annotation"), (F.col("location") % 11 == 0).alias("ignored")).withColumn("parent_path", P.parent(F.col("path")))


LOCATIONS = """
loc AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent_path FROM (SELECT DISTINCT platform, location,
  '/files/u' || (location % 10) || CASE WHEN location % 4 = 0 THEN '/[]/' ELSE '/' END || location || CASE WHEN location % 5 = 0 THEN '/[]' ELSE '' END AS path,
  CASE WHEN location % 3 <> 0 THEN 'a' || (location % 17) END AS annotation, location % 11 = 0 AS ignored FROM obs))"""


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, platform, path) of page addresses: host and path segments without the query; platform by language."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "").alias("path"))
    return pages.select("page_id", (F.col("page_id") % 3).cast("string").alias("platform"), F.regexp_replace("path", "/+$", "").alias("path"))


URL_PATHS = """
url AS (SELECT page_id, CAST(page_id % 3 AS VARCHAR) AS platform,
  regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/+$', '') AS path FROM pages)"""
#: All prefixes of a path, from the first segment on.
PREFIXES = "unnest(list_transform(range(2, len(string_split({p}, '/')) + 1), lambda i: array_to_string(string_split({p}, '/')[1:i], '/')))"


def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_paths(spark, sf_dir).select("platform", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()


def document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of documents with labels as one object each: doc_id is the source, labels are optional keys."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    cell = lambda path, name, kind, s, n, size: F.struct(F.lit(path).alias("path"), F.lit(name).alias("name"), kind.alias("json_type"), s.cast("string").alias("s"), n.cast("double").alias("n"), size.cast("long").alias("size"))
    none = F.lit(None)
    cells = F.array(
        cell("", None, F.lit("object"), none, none, none),
        cell("/lang", "lang", F.lit("string"), F.col("lang"), none, F.length("lang")),
        cell("/n_chars", "n_chars", F.lit("integer"), F.col("n_chars"), F.col("n_chars"), none),
        F.when(F.col("quality").isNotNull(), cell("/quality", "quality", F.lit("integer"), F.col("quality"), F.col("quality"), none)),
        cell("/text", "text", F.when(F.col("text").isNull(), "null").otherwise("string"), F.col("text"), none, F.length("text")),
    )
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.explode(F.array_compact(cells)).alias("x"))
    return rows.select("doc_id", "x.path", F.when(F.col("x.path") != "", "").alias("parent_path"), "x.name", "ord", "x.json_type", "x.s", "x.n", "x.size")
