"""What reviewers and curators see of uploads, locations and proposals, and which steps their states allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P

#: Steps of an upload's review: the state they need, the state they lead to (null: the upload is deleted), and who may
#: take them (fixed values).
STEPS = {
    "confirm": ("unconfirmed", "awaiting", "owner"),
    "discard": ("unconfirmed", None, "owner"),
    "approve": ("awaiting", "approved", "staff"),
    "reject": ("awaiting", "rejected", "staff"),
}
#: States in which an upload is part of the collected schema (fixed values).
COUNTED = ("passed", "approved")


def untriaged(points: DataFrame) -> DataFrame:
    """Data points (platform, upload_id, location) that nobody has annotated or ignored."""
    return points.where("is_data_point and annotation is null and not ignored").select("platform", "upload_id", "location")


def without_representation(locations: DataFrame, representations: DataFrame) -> DataFrame:
    """(platform, location) of list items that no representation stands for."""
    items = locations.where(F.endswith("path", F.lit("/[]"))).select("platform", "location")
    return items.join(representations.select("platform", "location"), ["platform", "location"], "left_anti")


def row_counts(points: DataFrame) -> DataFrame:
    """(platform, upload_id, n_rows): rows of an upload's review; a list and its items share one."""
    return points.groupBy("platform", "upload_id").agg(F.count_distinct(P.row_key(F.col("path"))).alias("n_rows"))


def platform_counts(locations: DataFrame, observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, annotations, data_points, untriaged, uploads) for a platform's page; branches are counted apart."""
    counted = uploads.where("registered").groupBy("platform").agg(F.count("*").alias("uploads"))
    seen = observations.join(uploads.where("registered").select("platform", "upload_id"), ["platform", "upload_id"], "left_semi").where("is_data_point").select("platform", "location").distinct()
    points = seen.join(locations, ["platform", "location"]).groupBy("platform").agg(F.count("*").alias("data_points"), F.count_if(F.col("annotation").isNull() & ~F.col("ignored")).alias("untriaged"))
    names = locations.where("annotation is not null").groupBy("platform").agg(F.count_distinct("annotation").alias("annotations"))
    every = uploads.select("platform").distinct()
    for part in (names, points, counted):
        every = every.join(part, "platform", "left")
    return every.na.fill(0)


def shown(rows: DataFrame, wanted: Column) -> DataFrame:
    """Rows (platform, path, ...) that are wanted, with all that lie above them, so that a tree can show them."""
    hits = rows.where(wanted).select("platform", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    return rows.join(hits, ["platform", "path"], "left_semi")


def children_of(locations: DataFrame) -> DataFrame:
    """(platform, path, has_children, item_type) of locations (platform, path, parent_path, type): item_type of lists."""
    below = locations.where("path <> ''").select("platform", F.col("parent_path").alias("path"), F.when(F.endswith("path", F.lit("/[]")), F.col("type")).alias("item"))
    found = below.groupBy("platform", "path").agg(F.lit(True).alias("_has"), F.max("item").alias("item_type"))
    return locations.join(found, ["platform", "path"], "left").select("platform", "path", F.coalesce("_has", F.lit(False)).alias("has_children"), F.coalesce("item_type", F.lit("")).alias("item_type"))


def filter_defaults(uploads: DataFrame) -> DataFrame:
    """(platform, request_format, root_format): the most common request format, and the most common root format within it."""
    named = uploads.where("registered").withColumn("request_format", F.coalesce(F.nullif("request_format", F.lit("")), F.lit("unknown")))
    first = lambda keys, c: W.partitionBy(*keys).orderBy(F.desc("n"), c)
    requests = named.groupBy("platform", "request_format").agg(F.count("*").alias("n"))
    requests = requests.withColumn("r", F.row_number().over(first(["platform"], "request_format"))).where("r = 1").select("platform", "request_format")
    roots = named.join(requests, ["platform", "request_format"]).groupBy("platform", "request_format", "root_format").agg(F.count("*").alias("n"))
    return roots.withColumn("r", F.row_number().over(first(["platform"], "root_format"))).where("r = 1").select("platform", "request_format", "root_format")


def states(uploads: DataFrame) -> DataFrame:
    """(platform, upload_id, counts, finished, can_inspect, can_approve) of uploads (status, plausibility, has_document, registered).

    can_inspect and can_approve: whether the upload's state lets staff do so, can_inspect its uploader too; inspectable()
    and stepped() tell which users may.
    """
    may = {"can_inspect": F.col("has_document") & ~F.col("registered"), "can_approve": F.col("plausibility") == STEPS["approve"][0]}
    return uploads.select("platform", "upload_id", F.col("plausibility").isin(*COUNTED).alias("counts"), F.col("status").isin("done", "failed").alias("finished"), *(c.alias(n) for n, c in may.items()))


def inspectable(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """(upload_id, user) of users (user, upload_id, staff) who may look into an upload (has_document, registered, uploaded_by).

    Only what was parsed and isn't registered can be looked into, by staff and by its uploader.
    """
    open_ = uploads.where("has_document and not registered").select("upload_id", "uploaded_by")
    return users.join(open_, "upload_id").where("staff or user = uploaded_by").select("upload_id", "user")


def stepped(uploads: DataFrame, asked: DataFrame) -> DataFrame:
    """(upload_id, action, plausibility, allowed) of asked (upload_id, action, user, staff) on uploads (plausibility, uploaded_by).

    plausibility is what the step leads to if it may be taken, null if the upload is deleted by it; else it stays.
    """
    rows = asked.join(uploads.select("upload_id", "plausibility", "uploaded_by"), "upload_id")
    allowed, to = F.lit(False), F.col("plausibility")
    for action, (from_, state, who) in STEPS.items():
        right = F.col("staff") if who == "staff" else F.coalesce(F.col("user") == F.col("uploaded_by"), F.lit(False))
        may = (F.col("action") == action) & (F.col("plausibility") == from_) & right
        allowed, to = allowed | may, F.when(may, F.lit(state).cast("string")).otherwise(to)
    return rows.select("upload_id", "action", to.alias("plausibility"), allowed.alias("allowed"))


def stale(proposals: DataFrame) -> DataFrame:
    """Open proposals (proposal_id, target, kind) whose base isn't what the accepted ones amount to now."""
    now = proposals.where("status = 'accepted'").groupBy("target", "kind").agg(F.max_by("value", F.struct("decided_at", "proposal_id")).alias("now"))
    rows = proposals.where("status = 'open'").join(now, ["target", "kind"], "left")
    return rows.where(~F.col("base").eqNullSafe(F.col("now"))).select("proposal_id", "target", "kind")


def waiting(proposals: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, proposals, approvals): open proposals, and uploads that wait for approval."""
    ours = proposals.where("status = 'open'").groupBy("platform").agg(F.count("*").alias("proposals"))
    theirs = uploads.where("plausibility = 'awaiting'").groupBy("platform").agg(F.count("*").alias("approvals"))
    return ours.join(theirs, "platform", "full").na.fill(0)


def open_for(proposals: DataFrame, targets: DataFrame) -> DataFrame:
    """Open proposals for targets (target, kind); a kind of null stands for any."""
    wanted = targets.select("target", F.col("kind").alias("_kind")).distinct()
    rows = proposals.where("status = 'open'").join(wanted, "target").where(F.col("_kind").isNull() | (F.col("_kind") == F.col("kind")))
    return rows.select("proposal_id", "target", "kind").distinct()


def grouped_queue(proposals: DataFrame, names: DataFrame) -> DataFrame:
    """(group, n) of open proposals by what they are for: the name of their target, else the target, whatever the case."""
    rows = proposals.where("status = 'open'").join(names.select("target", "name"), "target", "left")
    return rows.groupBy(F.lower(F.coalesce("name", "target")).alias("group")).agg(F.count("*").alias("n"))


def peers(uploads: DataFrame) -> DataFrame:
    """(platform, upload_id, peers): how many uploads of the same format a new one is compared with, those before it that count."""
    by = W.partitionBy("platform", "root_format").orderBy("arrived").rangeBetween(W.unboundedPreceding, -1)
    return uploads.select("platform", "upload_id", F.coalesce(F.sum(F.col("counts").cast("long")).over(by), F.lit(0)).alias("peers"))


def best_suggestions(suggestions: DataFrame, known: DataFrame) -> DataFrame:
    """(path, known_path, score) over several references: the best score of each, none for paths that a reference knows.

    suggestions: (reference, path, known_path, score); known: (reference, path).
    """
    open_ = suggestions.join(known.select("path").distinct(), "path", "left_anti")
    return open_.groupBy("path", "known_path").agg(F.max("score").alias("score"))


def merged_samples(samples: DataFrame) -> DataFrame:
    """(path, samples) of (path, part, samples): a left fold by part, each step keeping as many values as the longer list has.

    Samples of one list differ, so after each step there are as many as the longest list so far has, and a list that
    isn't longer than all before it adds nothing. Of the lists of one length only the first can matter: a minimum per
    length, and a fold over a few lists per path.
    """
    first = samples.groupBy("path", F.size("samples").alias("_n")).agg(F.min(F.struct("part", "samples")).alias("x"))
    lists = first.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("lists"))
    none = F.array().cast("array<string>")
    step = lambda have, x: F.slice(F.array_distinct(F.concat(have, x["samples"])), 1, F.greatest(F.size(have), F.size(x["samples"])))
    return lists.select("path", F.aggregate("lists", none, step).alias("samples"))


def triage(points: DataFrame, scopes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(platform, upload_id, location, status) of untriaged points: the reason of the best suggestion, else new or seen."""
    best = suggestions.groupBy("platform", "upload_id", "location").agg(F.min_by("reason", "rank").alias("reason"))
    rows = untriaged(points).join(best, ["platform", "upload_id", "location"], "left")
    rows = rows.join(scopes.where("scope = 'new'").select("platform", "upload_id", "location", F.lit("new").alias("fresh")), ["platform", "upload_id", "location"], "left")
    return rows.select("platform", "upload_id", "location", F.coalesce("reason", "fresh", F.lit("seen")).alias("status"))


def children_order(rows: DataFrame) -> DataFrame:
    """(platform, path, place) among siblings: by name in files' folders, names of null first, else by position."""
    by = W.partitionBy("platform", "parent_path").orderBy(F.when(F.col("in_folder"), F.coalesce("name", F.lit(""))).otherwise(F.lit("")), "position", "path")
    return rows.select("platform", "path", (F.row_number().over(by) - 1).alias("place"))
