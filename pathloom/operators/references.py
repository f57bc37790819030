"""What was known before each upload: merged schemas as of every request date, and suggestions against them.

The references of an upload are its platform's registered uploads requested strictly earlier, merged per root format.
They are never merged per upload: a day's uploads are summed up once per path, and running sums over days give the
state of each path after every day. A path's state holds until its next day, so the days that ask for references get
theirs by exploding each state over the days that it covers, which yields the rows that are asked for and no others.

uploads: (platform, upload_id, requested_at, created_at, root_format, registered).
nodes: (platform, upload_id, path, parent_path, kind, name, type, shape, format, position), one row per upload and path;
shapes, an array of (shape, n), is used if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import shapes as S
from pathloom.operators import compare
from pathloom.operators.merge import KINDS
from pathloom.operators.profile import THRESHOLD, dominant_of, is_data_point
from pathloom.sources.staging import staged

TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
SHAPES = ("alpha", "alphanumeric", "date", "datetime", "email", "empty", "numeric", "plain", "text", "time", "unix_timestamp", "url", "uuid")
#: Shapes whose values have a format.
DATED = ("date", "datetime", "time", "unix_timestamp")
RANKS = ("data", *KINDS)
KEY = ["platform", "root_format", "path"]


def daily(uploads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(platform, root_format, path, requested_at, kind, types, cells, newest): what a day's registered uploads add.

    Each part can be merged: kind is a smallest rank, types a set, cells (shape, format, n) sums, newest a largest
    (created_at, upload_id, position, name). Partial sums come before the shuffle, so a busy day is no hot key.
    """
    known = uploads.where("registered").select("platform", "upload_id", "requested_at", "created_at", "root_format")
    rows = nodes.join(known, ["platform", "upload_id"])
    counts = F.col("shapes") if "shapes" in nodes.columns else F.lit(None).cast("array<struct<shape: string, n: bigint>>")
    single = F.when(F.coalesce(F.col("shape"), F.lit("")) != "", F.array(F.struct(F.col("shape"), F.lit(1).cast("long").alias("n"))))
    rows = rows.withColumn("_cell", F.explode_outer(F.coalesce(counts, single)))
    fmt = F.when((F.col("_cell.shape") == F.col("shape")) & F.col("shape").isin(*DATED), F.nullif(F.col("format"), F.lit("")))
    newest = F.struct("created_at", "upload_id", F.col("position").cast("long").alias("position"), "name", "parent_path")
    day = [*KEY, "requested_at"]
    cells = rows.groupBy(*day, F.col("_cell.shape").alias("_shape"), fmt.alias("_format")).agg(
        F.sum("_cell.n").alias("_n"), F.min(F.array_position(F.array(*map(F.lit, RANKS)), F.col("kind"))).alias("_kind"),
        *(F.bool_or(F.coalesce(F.array_contains("type", t), F.lit(False))).alias(f"_is_{t}") for t in TYPES), F.max(newest).alias("_newest"),
    )
    return cells.groupBy(*day).agg(
        F.min("_kind").alias("kind"), *(F.bool_or(f"_is_{t}").alias(f"is_{t}") for t in TYPES), F.max("_newest").alias("newest"),
        F.collect_list(F.when(F.col("_shape").isNotNull(), F.struct(F.col("_shape").alias("shape"), F.col("_format").alias("format"), F.col("_n").alias("n")))).alias("cells"),
    )


def running(days: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """days with the state after each day, and until, the path's next day (null: none).

    A window holds one row a day and path at most, however many uploads there are.
    """
    order = W.partitionBy(*KEY).orderBy("requested_at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    of = lambda s: F.aggregate(F.filter("cells", lambda c: c.shape == s), F.lit(0).cast("long"), lambda total, c: total + c.n)
    formats = lambda s: F.transform(F.filter("cells", lambda c: (c.shape == s) & c.format.isNotNull()), lambda c: c.format)
    out = days.withColumns({f"_n_{s}": F.sum(of(s)).over(upto) for s in SHAPES})
    out = out.withColumns({f"_low_{s}": F.min(F.array_min(formats(s))).over(upto) for s in DATED} | {f"_high_{s}": F.max(F.array_max(formats(s))).over(upto) for s in DATED})
    out = out.withColumns({f"_t_{t}": F.max(f"is_{t}").over(upto) for t in TYPES})
    out = out.withColumns({"_kind": F.min("kind").over(upto), "newest": F.max("newest").over(upto), "until": F.lead("requested_at").over(order)})
    types = S.type_union(F.array_compact(F.array(*(F.when(F.col(f"_t_{t}"), F.lit(t)) for t in TYPES))))
    shapes = F.filter(F.array(*(F.struct(F.lit(s).alias("shape"), F.col(f"_n_{s}").alias("n")) for s in SHAPES)), lambda x: x.n > 0)
    out = out.withColumn("shape", dominant_of(shapes, threshold))
    fmt: Column = F.lit(None).cast("string")
    for s in DATED:
        fmt = F.when((F.col("shape") == s) & (F.col(f"_low_{s}") == F.col(f"_high_{s}")), F.col(f"_low_{s}")).otherwise(fmt)
    kind = F.element_at(F.array(*map(F.lit, RANKS)), F.col("_kind").cast("int"))
    return out.select(*KEY, "requested_at", "until", kind.alias("kind"), types.alias("type"), "shape", fmt.alias("format"), "newest")


def as_of(uploads: DataFrame, nodes: DataFrame, dates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The references of dates (platform, requested_at): (platform, requested_at, root_format, path, kind, name, type, shape, format, position).

    Keys stand as in the newest upload that has them, those of newer uploads before those that only older ones have;
    newest is by created_at, then upload_id. Names are the newest upload's too.
    """
    asked = dates.select("platform", "requested_at").distinct().groupBy("platform").agg(F.array_sort(F.collect_set("requested_at")).alias("_asked"))
    states = running(daily(uploads, nodes), threshold).join(asked, "platform")  # a platform's days: a few thousand
    first = F.size(F.filter("_asked", lambda d: d <= F.col("requested_at"))) + 1
    last = F.when(F.col("until").isNull(), F.size("_asked")).otherwise(F.size(F.filter("_asked", lambda d: d <= F.col("until"))))
    held = states.withColumn("_days", F.when(first <= last, F.slice("_asked", first, last - first + 1))).where("_days is not null")
    rows = held.select("platform", F.explode("_days").alias("requested_at"), "root_format", "path", "kind", "newest.name", "newest.parent_path", "type", "shape", "format", F.struct(F.col("newest.created_at").alias("at"), F.col("newest.upload_id").alias("id")).alias("_at"), F.col("newest.position").alias("_place"))
    siblings = W.partitionBy("platform", "requested_at", "root_format", "parent_path").orderBy(F.desc("_at"), "_place", "path")
    return rows.withColumn("position", F.row_number().over(siblings) - 1).drop("_at", "_place", "parent_path")


def unknown_points(uploads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(platform, upload_id, path) of data points that no registered upload requested earlier has, of uploads with references."""
    known = uploads.where("registered").select("platform", "upload_id", "requested_at")
    seen = nodes.join(known, ["platform", "upload_id"]).groupBy("platform", "path").agg(F.min("requested_at").alias("_since"))
    started = known.groupBy("platform").agg(F.min("requested_at").alias("_start"))
    rows = nodes.where(is_data_point(F.col("kind"), F.col("path"), F.col("type"))).join(known, ["platform", "upload_id"]).join(started, "platform").where("_start < requested_at")
    return rows.join(seen, ["platform", "path"]).where("_since >= requested_at").select("platform", "upload_id", "requested_at", "path")


def suggested(uploads: DataFrame, nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(platform, upload_id, path, known_path, reason, score, rank) for every registered upload's unknown data points.

    An upload is compared with its references of each root format, but meets only what of them its own nodes may
    correspond to, so that the work grows with the candidates, not with uploads times references. Of a known path that several give, the best score
    counts, none for paths that one of them knows; better ones come first, ties by root format, then as found. Only
    uploads with unknown data points get references at all; only: (platform, upload_id) of those that are wanted.
    """
    open_ = unknown_points(uploads, nodes)
    if only is not None:
        open_ = open_.join(only.select("platform", "upload_id").distinct(), ["platform", "upload_id"], "left_semi")
    open_ = staged(open_, "unknown-points")
    asking = open_.select("platform", "upload_id", "requested_at").distinct()
    schema = ["platform", "requested_at", "root_format"]
    before = compare.placed(as_of(uploads, nodes, asking), schema).withColumn("of", F.to_json(F.struct(*schema)))
    before = staged(before.select(*schema, "of", "path", *compare.SUMMARY, "position", "place"), "references")
    formats = before.select(*schema, "of").distinct()
    pairs = asking.join(formats, ["platform", "requested_at"]).withColumn("pair", F.to_json(F.struct("platform", "upload_id", "root_format")))
    new = staged(nodes.join(pairs, ["platform", "upload_id"]).select("pair", "of", "path", *compare.SUMMARY, "position"), "uploads-nodes")
    known = compare.relevant(before.drop(*schema), new)
    found = compare.suggestions(known, new).withColumn("_of", F.from_json("pair", "platform string, upload_id string, root_format string"))
    rows = found.select("_of.*", "path", "known_path", "reason", "score", "rank").join(open_.select(F.col("platform").cast("string"), F.col("upload_id").cast("string"), "path"), ["platform", "upload_id", "path"], "left_semi")
    one = ["platform", "upload_id", "path"]
    best = rows.groupBy(*one, "known_path").agg(F.min(F.struct((-F.col("score")).alias("s"), "root_format", "rank", "reason")).alias("b"))
    order = W.partitionBy(*one).orderBy("b")
    return best.select(*one, "known_path", F.col("b.reason").alias("reason"), (-F.col("b.s")).alias("score"), (F.row_number().over(order) - 1).alias("rank"))


def affected(uploads: DataFrame, late: DataFrame) -> DataFrame:
    """(platform, upload_id) whose references change when late (platform, upload_id) are registered: they and later ones."""
    of_late = uploads.join(late.select("platform", "upload_id").distinct(), ["platform", "upload_id"])
    since = of_late.groupBy("platform").agg(F.min("requested_at").alias("_since"))
    later = uploads.where("registered").join(since, "platform").where("requested_at > _since").select("platform", "upload_id")
    return later.unionByName(of_late.select("platform", "upload_id")).distinct()


def suggested_again(stored: DataFrame, uploads: DataFrame, nodes: DataFrame, late: DataFrame) -> DataFrame:
    """stored suggestions after late uploads were registered: theirs and those of later ones anew, all others as they are."""
    changed = staged(affected(uploads, late), "affected")
    keys = changed.select(F.col("platform").cast("string"), F.col("upload_id").cast("string"))
    return stored.join(keys, ["platform", "upload_id"], "left_anti").unionByName(suggested(uploads, nodes, changed))


def annotation_choices(suggestions: DataFrame, locations: DataFrame) -> DataFrame:
    """(platform, upload_id, path, annotation, reason, score, via, rank): the annotations that suggestions lead to.

    locations: (platform, path, annotation). Each annotation is offered once, for its best suggestion; best first.
    """
    named = locations.where("annotation is not null").select("platform", F.col("path").alias("known_path"), "annotation")
    one = ["platform", "upload_id", "path"]
    first = suggestions.join(named, ["platform", "known_path"]).groupBy(*one, "annotation").agg(F.min(F.struct("rank", "reason", "score", F.col("known_path").alias("via"))).alias("b"))
    return first.select(*one, "annotation", "b.reason", "b.score", "b.via", (F.row_number().over(W.partitionBy(*one).orderBy("b.rank", "annotation")) - 1).alias("rank"))


def path_rules(rules: DataFrame) -> DataFrame:
    """(platform, variable_keys, keep_keys) of rules (platform, kind, pattern), sorted: a platform's parser options."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("pattern"))))
    return rules.groupBy("platform").agg(of("variable_key").alias("variable_keys"), of("keep_key").alias("keep_keys"))
