"""From exports to schema nodes in one call: read, profiled, normalized, profiled again under the new paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.operators import normalize, profile
from pathloom.sources import archives
from pathloom.sources.staging import staged

FILES = ["size_bytes", "ext", "mime", "mime_source", "modified", "files", "reason", "error", "parser", "encoding", "wrapper", "delimiter", "warning"]


def nodes_of(spark: SparkSession, path: str, limits: archives.Limits = archives.Limits(), samples: int = 0, variable_keys: list[str] = [], keep_keys: list[str] = []) -> DataFrame:  # noqa: B006
    """All nodes of the exports under path: containers, folders and files, and what is in files.

    A file's own value is its node (kind file), with the statistics of its values; what lies below is data. Keys that hold
    data become patterns and their values one; so do a folder's media files of one ending, whose sizes and numbers add up
    and whose name is the commonest mask. Siblings stand by name in folders, and as in the file below files.
    """
    exports = archives.read(spark, path, limits)
    known = exports.nodes.select("doc_id", "path", "name", "kind")
    inside = exports.values.select("doc_id", "path", "name").distinct().join(known.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
    renames = staged(normalize.renames(known.unionByName(inside.withColumn("kind", F.lit("data"))), variable_keys, keep_keys), "schema-renames")
    found = profile.nodes(normalize.normalized_occurrences(exports.values, renames), samples=samples)

    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    moved = exports.nodes.join(renames, ["doc_id", "path"], "left")
    mask = F.when(F.col("new_path").isNotNull(), F.concat(S.mask_name(stem), F.lower(F.coalesce("ext", F.lit(""))))).otherwise(F.col("name"))
    moved = moved.withColumns({"_mask": mask, "path": F.coalesce("new_path", "path")})
    masks = moved.groupBy("doc_id", "path", "_mask").agg(F.sum(F.coalesce("files", F.lit(1))).alias("_n"))
    names = masks.groupBy("doc_id", "path").agg(F.min_by("_mask", F.struct(-F.col("_n"), "_mask")).alias("name"))
    many = F.when((F.count("*") > 1) | (F.count("files") > 0), F.sum(F.coalesce("files", F.lit(1)))).alias("files")
    summed = {"size_bytes": F.sum("size_bytes").alias("size_bytes"), "modified": F.max("modified").alias("modified"), "files": many}
    files = moved.groupBy("doc_id", "path").agg(F.first("kind").alias("kind"), *(summed.get(c, F.first(c, ignorenulls=True).alias(c)) for c in FILES)).join(names, ["doc_id", "path"])
    files = files.withColumn("_place", F.row_number().over(W.partitionBy("doc_id", P.parent(F.col("path"))).orderBy("name", "path")) - 1)

    stats = [c for c in found.columns if c not in ("doc_id", "path", "parent_path", "name", "position")]
    own = files.join(found.select("doc_id", "path", *stats), ["doc_id", "path"], "left").withColumns({"parent_path": P.parent(F.col("path")), "position": F.col("_place")}).drop("_place")
    data = found.join(files.select("doc_id", "path"), ["doc_id", "path"], "left_anti").withColumn("kind", F.lit("data"))
    return own.unionByName(data, allowMissingColumns=True)
