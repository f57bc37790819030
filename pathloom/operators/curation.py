"""Decisions on uploads and proposals, as folds over events and constraint queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.sources.staging import staged

THRESHOLD = 0.3


def duplicates(uploads: DataFrame) -> DataFrame:
    """(platform, upload_id, sha256, copies): uploads whose file another upload of the platform has too."""
    rows = uploads.where("coalesce(sha256, '') <> ''")
    groups = rows.groupBy("platform", "sha256").agg((F.count("*") - 1).alias("copies")).where("copies > 0")
    return rows.join(groups, ["platform", "sha256"]).select("platform", "upload_id", "sha256", "copies")


def decided(uploads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Plausibility of uploads (platform, root_format, upload_id, arrived, sha256, similarity) in order of arrival.

    A file that counts or waits already is a duplicate; the first of its platform and format waits; one that shares too
    little with those that count is unconfirmed; others pass. The first waits until somebody approves it, so the fold
    is over each platform's arrivals; approved (boolean) tells which waiting ones were.

    Two tables say all: when a format starts to count, and when a file starts to count or wait. Each is a minimum over
    rows that the other decides; they are computed in turn until neither changes, which makes at least one more arrival
    right each time. Repeated rows follow each other; missing times and ids come last.
    """
    at = F.struct(F.col("arrived").isNull().alias("a"), F.col("arrived").alias("b"), F.col("upload_id").isNull().alias("c"), F.col("upload_id").alias("d"), F.monotonically_increasing_id().alias("e"))
    fits = F.coalesce((F.col("similarity") >= threshold) & ~F.isnan("similarity"), F.lit(False))
    rows = uploads.select("platform", "root_format", "upload_id", at.alias("at"), F.nullif(F.col("sha256"), F.lit("")).alias("sha256"), fits.alias("fits"), F.coalesce("approved", F.lit(False)).alias("approved"))
    rows = staged(rows, "uploads")

    def with_first(df: DataFrame, firsts: DataFrame, key: str, name: str) -> DataFrame:
        firsts = firsts.select(F.col("platform").alias("_platform"), F.col(key).alias("_key"), F.col("first").alias(name))
        return df.join(firsts, F.col("platform").eqNullSafe(F.col("_platform")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_platform", "_key")

    def first(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy("platform", key).agg(F.min("at").alias("first"))

    counted, was = None, None
    while True:
        stand = rows.where("sha256 is not null")
        if counted is not None:
            stand = with_first(stand, counted, "root_format", "counts_at").where("counts_at is null or at <= counts_at or fits")
        taken = staged(first(stand, "sha256"), "taken")
        free = with_first(rows.where("approved"), taken, "sha256", "taken_at").where("taken_at is null or at <= taken_at")
        counted = staged(first(free, "root_format"), "counted")
        mark = tuple(counted.select(F.count("*"), F.sum(F.xxhash64("platform", "root_format", "first").cast("decimal(38,0)"))).first())
        if mark == was:
            break
        was = mark
    found = with_first(with_first(rows, taken, "sha256", "taken_at"), counted, "root_format", "counts_at")
    early = F.col("counts_at").isNull() | (F.col("at") <= F.col("counts_at"))
    duplicate = F.coalesce(F.col("taken_at") < F.col("at"), F.lit(False))
    state = F.when(duplicate, "duplicate").when(early & F.col("approved"), "approved").when(early, "awaiting").when(~F.col("fits"), "unconfirmed").otherwise("passed")
    reason = F.when(F.col("plausibility").isin("approved", "awaiting"), "first").when(F.col("plausibility") == "unconfirmed", "dissimilar")
    return found.select("platform", F.col("upload_id").cast("string").alias("upload_id"), state.alias("plausibility")).withColumn("reason", reason)


def current_state(proposals: DataFrame) -> DataFrame:
    """The last accepted proposal of each target and kind, by decision time and id: the state that they amount to."""
    rows = proposals.where("status = 'accepted'")
    return rows.groupBy("target", "kind").agg(F.max_by("value", F.struct("decided_at", "proposal_id")).alias("value"), F.max("decided_at").alias("decided_at"), F.count("*").alias("accepted"))


def superseded(proposals: DataFrame) -> DataFrame:
    """Open proposals for a target and kind whose base an acceptance after they were made has changed."""
    last = proposals.where("status = 'accepted'").groupBy("target", "kind").agg(F.max("decided_at").alias("last_at"))
    return proposals.where("status = 'open'").join(last, ["target", "kind"]).where("created_at < last_at").select("proposal_id", "target", "kind")


def withdrawn(proposals: DataFrame) -> DataFrame:
    """Open proposals that their author has replaced by a later one for the same target and kind."""
    by = W.partitionBy("target", "kind", "proposed_by").orderBy(F.desc("created_at"), F.desc("proposal_id"))
    return proposals.where("status = 'open'").withColumn("n", F.row_number().over(by)).where("n > 1").drop("n")


def queue_counts(proposals: DataFrame) -> DataFrame:
    """(platform, n, rank) of open proposals, most first, ties by name."""
    counts = proposals.where("status = 'open'").groupBy("platform").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "platform")))


def unique_names(names: DataFrame) -> DataFrame:
    """(platform, id, name) with repeats of a name numbered from 2, by id."""
    n = F.row_number().over(W.partitionBy("platform", "name").orderBy("id"))
    return names.withColumn("_n", n).withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), "_n", F.lit(")"))).otherwise(F.col("name"))).drop("_n")


def can_represent(observations: DataFrame, locations: DataFrame) -> DataFrame:
    """(platform, location) of list items that are mainly objects, over all observations."""
    items = locations.where(F.endswith(F.col("path"), F.lit("/[]"))).select("platform", "location")
    counts = observations.join(items, ["platform", "location"], "left_semi").where("coalesce(type, '') <> ''").groupBy("platform", "location", "type").agg(F.count("*").alias("n"))
    main = counts.groupBy("platform", "location").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    return main.where(F.array_remove(F.split("type", r"\|"), "null") == F.array(F.lit("object"))).select("platform", "location")


def metadata_candidates(anchors: DataFrame, locations: DataFrame, observations: DataFrame) -> DataFrame:
    """(platform, anchor, path) of data points strictly below each anchor, by ancestors and not by comparing all paths."""
    points = observations.where("is_data_point").select("platform", "location").distinct()
    rows = locations.where("not ignored").join(points, ["platform", "location"], "left_semi")
    ups = rows.select("platform", "path", F.explode(P.ancestors(F.col("path"))).alias("anchor")).where("anchor <> path")
    return ups.join(anchors.select("platform", F.col("path").alias("anchor")), ["platform", "anchor"], "left_semi").select("platform", "anchor", "path").distinct()


def registered(nodes: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locations that nodes (platform, upload_id, path, parent_path, position) add, and the observations by path."""
    seen = nodes.groupBy("platform", "path").agg(F.min_by("parent_path", "upload_id").alias("parent_path"), F.min_by("position", "upload_id").alias("position"))
    return seen.join(locations, ["platform", "path"], "left_anti"), nodes.dropDuplicates(["platform", "upload_id", "path"])


def progress(points: DataFrame) -> DataFrame:
    """(platform, upload_id, decided, total, percent) of data points with annotated or ignored; 100 without any."""
    done = F.count_if(F.col("annotation").isNotNull() | F.col("ignored"))
    out = points.groupBy("platform", "upload_id").agg(done.alias("decided"), F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 100).otherwise(F.bround(F.col("decided") * 100 / F.col("total"), 0)).cast("long"))
