"""Merging the schemas of several documents: presence, unions of types, sums of shapes, widened lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.operators.profile import THRESHOLD, dominant_of
from pathloom.sources.staging import staged

#: Of kinds at one path the first wins: what one export could read beats what another couldn't (fixed order).
KINDS = ("file", "container", "folder", "media", "unmatched")


def presence(nodes: DataFrame) -> DataFrame:
    """(path, documents): in how many documents each path occurs."""
    return nodes.groupBy("path").agg(F.count_distinct("doc_id").alias("documents"))


def without_conflicts(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, path, kind, ...) less the subtrees of kinds that lose against another document's at their path."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ranked = nodes.where(F.col("kind") != "data").withColumn("_rank", rank)
    best = ranked.groupBy("path").agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_worst")).where("_best <> _worst")
    lost = ranked.join(best, "path").where("_rank > _best").select("doc_id", F.col("path").alias("_root"))
    below = nodes.select("doc_id", "path", F.explode(F.array_append(P.ancestors(F.col("path")), F.lit(""))).alias("_root"))
    gone = below.join(lost, ["doc_id", "_root"], "left_semi").select("doc_id", "path").distinct()
    return nodes.join(gone, ["doc_id", "path"], "left_anti")


def merged(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One node per path over all documents of nodes (as from profile.nodes).

    A document that has the parent as an object with keys, but not the key, still counts its objects, so that the key
    shows as optional; below a key that is missing nothing is added. nodes, which are schema-sized, are staged: they are
    looked at five times, and what they were made of once.
    """
    nodes = staged(nodes, "schema-nodes")
    base = nodes.groupBy("path").agg(
        F.min("parent_path").alias("parent_path"),
        F.min("name").alias("name"),
        F.count_distinct("doc_id").alias("documents"),
        S.type_union(F.flatten(F.collect_set("type"))).alias("type"),
        F.sum("n_present").alias("n_present"),
        F.sum("n_null").alias("n_null"),
        F.sum("n_count").alias("_own"),
        F.min("length_min").alias("length_min"),
        F.max("length_max").alias("length_max"),
    )
    keyed = nodes.where("name is not null").select("doc_id", F.col("parent_path").alias("path")).distinct()
    objects = nodes.join(keyed, ["doc_id", "path"], "left_semi").select("doc_id", F.col("path").alias("parent_path"), F.col("n_objects").alias("_objects"))
    every = objects.groupBy("parent_path").agg(F.sum("_objects").alias("_every"))
    # objects of documents that have both parent and key are in the key's own count already
    mine = nodes.where("name is not null").join(objects, ["doc_id", "parent_path"]).groupBy("path").agg(F.sum("_objects").alias("_with"))
    # shapes, and formats with the shape of their node: a few different ones per path, so they meet in one row
    own = F.filter("shapes", lambda x: x["shape"] == F.col("shape"))
    known = F.coalesce("formats", F.when(F.col("format").isNotNull(), F.array(F.struct(F.col("format").alias("f"), own[0]["n"].alias("n")))))
    none = F.lit(None).cast("string")
    long = F.concat(
        F.transform(F.coalesce("shapes", F.array().cast("array<struct<shape: string, n: long>>")), lambda x: F.struct(x["shape"].alias("shape"), none.alias("f"), x["n"].alias("n"))),
        F.transform(F.coalesce(known, F.array().cast("array<struct<f: string, n: long>>")), lambda x: F.struct(F.col("shape").alias("shape"), x["f"].alias("f"), x["n"].alias("n"))),
    )
    found = nodes.select("path", F.explode(long).alias("x")).groupBy("path", F.col("x.shape").alias("shape"), F.col("x.f").alias("f")).agg(F.sum("x.n").alias("n"))
    found = found.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("f").isNull(), F.struct("shape", "n")))).alias("shapes"),
        F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "n", "shape")))).alias("_formats"),
    )
    found = found.withColumn("shape", dominant_of(F.col("shapes"), threshold))
    found = found.withColumn("_formats", F.transform(F.filter("_formats", lambda x: x["shape"] == F.col("shape")), lambda x: F.struct(x["f"].alias("f"), x["n"].alias("n"))))
    many = F.size("_formats")
    found = found.select("path", "shape", "shapes", F.when(many == 1, F.col("_formats")[0]["f"]).alias("format"), F.when(many > 1, F.col("_formats")).alias("formats"))
    out = base.join(every, "parent_path", "left").join(mine, "path", "left").join(found, "path", "left")
    extra = F.when(F.col("name").isNotNull(), F.coalesce(F.col("_every"), F.lit(0)) - F.coalesce(F.col("_with"), F.lit(0))).otherwise(0)
    return out.withColumn("n_count", F.col("_own") + extra).drop("_own", "_every", "_with")


def merged_files(nodes: DataFrame) -> DataFrame:
    """Filesystem fields per path: sizes summed, newest change, first known type, numbers of files and folders.

    Unknown amounts stay unknown only if all are; an ungrouped file counts as one among grouped ones.
    """
    by = W.partitionBy("path").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(by)
    rows = nodes.withColumn("ext", first("ext")).withColumn("mime", first("mime"))
    members = F.when(F.count("files") > 0, F.sum(F.coalesce("files", F.lit(1))))
    newest = [F.max("modified").alias("modified")] if "modified" in nodes.columns else []
    return rows.groupBy("path", "kind").agg(*newest, F.sum("size_bytes").alias("size_bytes"), F.first("ext").alias("ext"), F.first("mime").alias("mime"), members.alias("files"))
