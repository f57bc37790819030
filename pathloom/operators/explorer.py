"""Data points as a tree to look at: roots, groups, rows and sections, and what each row says.

A root is the deepest file above a group, over all uploads of a platform; a group is the parent of its rows; a list and
its items share a row, and the fields of a list's items are rows below it. All parts are joins on ancestors of paths, of
which a path has a few, and aggregates; no part needs a platform's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import paths as P
from pathloom.operators import views
from pathloom.operators.profile import is_data_point
from pathloom.sources.staging import staged

#: Between the keys of a row's name, and values shown in a row (fixed values).
CHAIN, PREVIEW = " › ", 1


# --- where a group sits -------------------------------------------------------------------------------------------


def places(groups: DataFrame, kinds: DataFrame, root_names: DataFrame) -> DataFrame:
    """(platform, path, root, title, crumbs) of group paths: the root that each is under, and the keys in between.

    groups: (platform, path). kinds: (platform, path, kind) of all uploads; a path may have had several, and is a file if
    one upload has it as one. root_names: (platform, root_name), what a single file's tree is called.
    The root is the deepest file among a path and what is above it; keys at the top are a single file's, whose root is
    "". Without either it is the group's own folder. title: (name, last) of the root's parts; crumbs: (name, is_key) of
    what is between root and group, a list's item being its list's name with [].
    """
    one = ["platform", "path"]
    asked = groups.select(*one).distinct()
    ups = asked.select(*one, F.posexplode(P.ancestors(F.col("path"))).alias("at", "up"))
    known = kinds.groupBy("platform", F.col("path").alias("up")).agg(F.bool_or(F.col("kind") == "file").alias("is_file"), F.bool_or(F.col("kind") == "data").alias("is_key"))
    seen = ups.where("path <> ''").join(known, ["platform", "up"], "left").withColumns({"is_file": F.coalesce("is_file", F.lit(False)), "is_key": F.coalesce("is_key", F.lit(False))})
    steps = seen.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("at", "up", "is_file", "is_key"))).alias("steps"))
    rows = asked.join(steps, one, "left").join(root_names, "platform", "left")
    steps_ = F.coalesce("steps", F.array().cast("array<struct<at: int, up: string, is_file: boolean, is_key: boolean>>"))
    file_at = F.array_max(F.transform(F.filter(steps_, lambda s: s.is_file), lambda s: s.at))
    keys_on_top = (F.col("path") == "") | F.coalesce(F.get(steps_, F.lit(0))["is_key"], F.lit(False))
    root = F.when(file_at.isNotNull(), F.get(steps_, file_at)["up"]).when(keys_on_top, "").otherwise(F.col("path"))
    below = F.when(file_at.isNotNull(), F.filter(steps_, lambda s: s.at > file_at)).when(keys_on_top, steps_).otherwise(F.filter(steps_, lambda s: F.lit(False)))
    crumb = "struct<name: string, is_key: boolean>"

    def add(out: Column, s: Column) -> Column:
        name = P.last(s.up)
        item = (name == "[]") & (F.size(out) > 0)
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.concat(F.try_element_at(out, F.lit(-1))["name"], F.lit("[]")).alias("name"), F.try_element_at(out, F.lit(-1))["is_key"].alias("is_key"))))
        return F.when(item, joined).otherwise(F.concat(out, F.array(F.struct(name.alias("name"), s.is_key.alias("is_key")))))

    crumbs = F.aggregate(below, F.array().cast(f"array<{crumb}>"), add)
    parts = P.segments(root)
    is_file = file_at.isNotNull()
    whole = F.transform(parts, lambda n, i: F.struct(F.when((i == F.size(parts) - 1) & ~is_file, F.concat(n, F.lit("/"))).otherwise(n).alias("name"), (i == F.size(parts) - 1).alias("last")))
    title = F.when(root == "", F.array(F.struct(F.col("root_name").alias("name"), F.lit(True).alias("last")))).otherwise(whole)
    return rows.select(*one, root.alias("root"), title.alias("title"), crumbs.alias("crumbs"))


# --- rows ---------------------------------------------------------------------------------------------------------


def rows(points: DataFrame) -> DataFrame:
    """One row a data point of points, a list and its items sharing one.

    points: (platform, path, parent_path, name, location, annotation, ignored, type, shape, format, n_present, ord), the
    data points of one view; in_scope, pending and examples are used if they are there. What is shown and labelled is the
    list; what is annotated first is its item (primary). A row in which nothing is in scope only heads its fields and is
    never open. below: the row of the list whose items it is a field of, if that is a row; top: the outermost one; its
    group is that of top.
    """
    given = points
    for name, value in (("in_scope", F.lit(True)), ("pending", F.lit(0).cast("long")), ("examples", F.array().cast("array<string>"))):
        given = given if name in points.columns else given.withColumn(name, value)
    key = P.row_key(F.col("path"))
    depth = P.depth(F.col("path"))
    undecided = F.col("annotation").isNull() & ~F.col("ignored")
    shown = lambda c: F.min_by(c, depth).alias(c)
    primary = lambda c: F.max_by(c, depth).alias(f"_{c}")
    one = given.groupBy("platform", key.alias("row")).agg(
        shown("location"), shown("parent_path"), shown("name"), shown("type"), shown("shape"), shown("format"),
        primary("location"), primary("n_present"), primary("examples"), F.count("*").alias("members"), F.min("ord").alias("ord"),
        F.bool_and(~undecided).alias("decided"), F.bool_and("ignored").alias("ignored"), F.bool_or("in_scope").alias("in_scope"), F.sum("pending").alias("pending"),
        F.max_by(F.when(undecided, F.col("location")), F.when(undecided, depth)).alias("_last_open"), F.min_by(F.when(undecided, F.col("location")), F.when(undecided, depth)).alias("_first_open"),
        F.max_by(undecided, depth).alias("_primary_open"),
    )
    ups = one.select("platform", "row", F.posexplode(F.reverse(F.filter(P.ancestors(F.col("row")), lambda u: F.endswith(u, F.lit("/[]"))))).alias("at", "item"))
    lists = ups.where("item <> row").select("platform", "row", "at", P.row_key(F.col("item")).alias("list")).dropDuplicates(["platform", "row", "list"])
    there = given.select("platform", F.col("path").alias("list"), F.lit(True).alias("_there"))
    near = lists.join(there, ["platform", "list"], "left").groupBy("platform", "row").agg(F.array_sort(F.collect_list(F.struct("at", "list", F.coalesce("_there", F.lit(False)).alias("there")))).alias("_lists"))
    out = one.join(near, ["platform", "row"], "left")
    lists_ = F.coalesce("_lists", F.array().cast("array<struct<at: int, list: string, there: boolean>>"))
    gap = F.array_min(F.transform(F.filter(F.transform(lists_, lambda x, i: F.struct(i.alias("i"), x.there.alias("there"))), lambda x: ~x.there), lambda x: x.i))
    nesting = F.coalesce(gap, F.size(lists_))
    is_list = F.col("members") > 1
    within = F.get(lists_, F.lit(0))["list"]
    rest = F.array_join(F.split(F.substr("row", F.length(within) + 5), "/"), CHAIN)
    own = F.when(F.col("row") == "", "Root").otherwise(N.display_name(F.col("row"), F.col("name")))
    name = F.concat(F.when(within.isNull(), own).otherwise(rest), F.when(is_list, "[]").otherwise(""))
    count = F.col("_n_present").cast("string")
    summary = F.when(is_list, F.concat(count, F.when(F.col("_n_present") == 1, " item").otherwise(" items"))).otherwise(F.coalesce("format", F.lit("")))
    examples = F.coalesce("_examples", F.array().cast("array<string>"))
    preview = F.slice(examples, 1, PREVIEW)
    return out.select(
        "platform", "row", "ord", name.alias("label"), "location", F.col("_location").alias("primary"), is_list.alias("is_list"), nesting.alias("depth"),
        F.when(nesting > 0, within).alias("below"), F.when(nesting > 0, F.get(lists_, nesting - 1)["list"]).otherwise(F.col("row")).alias("top"),
        views.type_badge(F.col("type"), F.col("shape")).alias("badge"), "decided", "ignored", (~F.col("decided") & F.col("in_scope")).alias("is_open"), "in_scope",
        F.when(F.col("_primary_open"), F.col("_location")).otherwise(F.col("_first_open")).alias("open_location"),
        preview.alias("preview"), F.greatest(F.size(examples) - PREVIEW, F.lit(0)).alias("more"), F.when(F.size(examples) == 0, summary).otherwise("").alias("summary"), "pending", F.col("parent_path").alias("_group"),
    )


def tree(points: DataFrame, kinds: DataFrame, root_names: DataFrame, by_open: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with group_path and root, groups) of a view of data points (see rows()).

    groups: (platform, root, group_path, title, crumbs, n_rows, open_rows, ord, root_expanded, expanded). The first root
    with something open is expanded, and in it the first such group; without any (or by_open) the very first ones.
    """
    found = staged(rows(points), "tree-rows")
    tops = found.where("depth = 0").select("platform", F.col("row").alias("top"), F.coalesce("_group", F.lit("")).alias("group_path"))
    placed = found.drop("_group").join(tops, ["platform", "top"])
    groups = placed.groupBy("platform", "group_path").agg(F.count("*").alias("n_rows"), F.count_if("is_open").alias("open_rows"), F.min("ord").alias("ord"))
    sits = places(groups.select("platform", F.col("group_path").alias("path")), kinds, root_names).withColumnRenamed("path", "group_path")
    return placed.join(sits.select("platform", "group_path", "root"), ["platform", "group_path"]), expanded(groups.join(sits, ["platform", "group_path"]), by_open)


def expanded(groups: DataFrame, by_open: bool = True) -> DataFrame:
    """groups (platform, root, group_path, open_rows, ord) with root_expanded and expanded: where to start reading."""
    groups = staged(groups, "tree-groups")
    has = (F.col("open_rows") > 0) if by_open else F.lit(True)
    roots = groups.groupBy("platform", "root").agg(F.min("ord").alias("_ord"), F.bool_or(has).alias("_has"))
    first = roots.groupBy("platform").agg(F.min_by("root", F.struct(~F.col("_has"), "_ord", "root")).alias("root"))
    group = groups.join(first, ["platform", "root"]).groupBy("platform", "root").agg(F.min_by("group_path", F.struct(~has, "ord", "group_path")).alias("_first"))
    out = groups.join(group, ["platform", "root"], "left")
    return out.withColumns({"root_expanded": F.col("_first").isNotNull(), "expanded": F.coalesce(F.col("group_path") == F.col("_first"), F.lit(False))}).drop("_first")


def sections(entries: DataFrame, kinds: DataFrame, root_names: DataFrame) -> DataFrame:
    """Groups of entries (platform, parent_path, ord), such as changed or missing locations, under their roots."""
    groups = entries.groupBy("platform", F.coalesce("parent_path", F.lit("")).alias("group_path")).agg(F.count("*").alias("open_rows"), F.min("ord").alias("ord"))
    sits = places(groups.select("platform", F.col("group_path").alias("path")), kinds, root_names).withColumnRenamed("path", "group_path")
    return expanded(groups.join(sits, ["platform", "group_path"]))


def single_row(points: DataFrame, path: str) -> DataFrame:
    """The row of one location, as it is now: only the points of that row and of the lists around it are read."""
    key = path
    while key.endswith("/[]"):
        key = key[: -len("/[]")]
    around = [key] + [key[:i] for i in range(len(key)) if key.startswith("/[]/", i)]
    return rows(points.where(P.row_key(F.col("path")).isin(around))).where(F.col("row") == key).drop("_group")


# --- what else is told of points ----------------------------------------------------------------------------------


def with_new_below(inspection: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (pair, path) with has_new: whether the node or anything below it is new; inspection: (pair, path, status)."""
    new = inspection.where("status = 'new'").select("pair", F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))).alias("path")).distinct()
    return nodes.join(new.withColumn("has_new", F.lit(True)), ["pair", "path"], "left").withColumn("has_new", F.coalesce("has_new", F.lit(False)))


def refreshed(observations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations whose flag changes, with the new one; how many change by flag) when is_data_point is worked out anew.

    observations: (platform, upload_id, path, is_data_point), as stored; nodes: (platform, upload_id, path, kind, type).
    What is no node any more is no data point. After the changed rows are written, nothing changes.
    """
    now = nodes.select("platform", "upload_id", "path", is_data_point(F.col("kind"), F.col("path"), F.col("type")).alias("_now"))
    rows_ = observations.join(now, ["platform", "upload_id", "path"], "left").withColumn("_now", F.coalesce("_now", F.lit(False)))
    flips = rows_.where(~F.col("is_data_point").eqNullSafe(F.col("_now")))
    return flips.withColumn("is_data_point", F.col("_now")).drop("_now"), flips.groupBy(F.col("_now").alias("is_data_point")).agg(F.count("*").alias("changed"))


def split_values(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes without their samples and ranges, these by doc_id and path): what is never kept with a schema."""
    own = ["samples", "redacted", "range_min", "range_max"]
    have = [c for c in own if c in nodes.columns]
    some = F.lit(False)
    for c in have:
        some = some | F.col(c).isNotNull()
    return nodes.drop(*have), nodes.where(some).select("doc_id", "path", *have)


def parsed_states(uploads: DataFrame, roots: DataFrame) -> DataFrame:
    """(upload_id, status, error, root_format) of uploads (upload_id, file_format) after reading; roots: (upload_id, kind, ext, error).

    A root that couldn't be read fails; so does one of another format than was declared. Uploads that weren't read stay
    pending.
    """
    labels = {"zip": "ZIP archive", "json": "JSON file", "csv": "CSV file"}
    found = roots.select("upload_id", F.when(F.col("kind") == "container", "zip").otherwise(N.format_of(F.col("ext"), F.col("kind"))).alias("root_format"), F.when((F.col("kind") == "unmatched") & F.col("error").isNotNull(), F.col("error")).alias("_error"), F.lit(True).alias("_read"))
    rows_ = uploads.join(found, "upload_id", "left")
    label: Column = F.col("file_format")
    for name, text in labels.items():
        label = F.when(F.col("file_format") == name, text).otherwise(label)
    other = (F.coalesce("file_format", F.lit("")) != "") & (F.col("file_format") != F.col("root_format"))
    error = F.coalesce("_error", F.when(other, F.concat(F.lit("Declared as a "), label, F.lit(", but the file is "), F.upper("root_format"), F.lit("."))))
    status = F.when(F.col("_read").isNull(), "pending").when(error.isNotNull(), "failed").otherwise("done")
    return rows_.select("upload_id", status.alias("status"), F.when(F.col("_read"), error).alias("error"), "root_format")


def pending_counts(proposals: DataFrame) -> DataFrame:
    """(location, pending): open suggestions of each location."""
    return proposals.where("status = 'open' and location is not null").groupBy("location").agg(F.count("*").alias("pending"))


def open_about(proposals: DataFrame, targets: DataFrame, representations: DataFrame) -> DataFrame:
    """(kind_of_target, target, proposal_id): the open suggestions about each of targets (kind_of_target, target).

    Of a location those of its annotation count; of an annotation and a representation all that name it; of
    location-representations those of representations of the location, named by it or by the representation.
    representations: (representation, location).
    """
    from pathloom.operators.proposals import LOCATION_KINDS

    of = representations.select("representation", F.col("location").alias("_of"))
    rows_ = proposals.where("status = 'open'").join(of, "representation", "left")
    cell = lambda kind, target, on: F.when(on & target.isNotNull(), F.struct(F.lit(kind).alias("kind_of_target"), target.cast("string").alias("target")))
    about = F.col("kind").isin(*LOCATION_KINDS)
    rep = F.endswith(F.col("kind"), F.lit("_representation"))
    every = F.array(cell("location", F.col("location"), about), cell("annotation", F.col("annotation"), F.lit(True)), cell("representation", F.col("representation"), F.lit(True)), cell("location-representations", F.col("location"), rep), cell("location-representations", F.col("_of"), rep))
    each = rows_.select("proposal_id", F.explode(F.array_distinct(F.array_compact(every))).alias("x")).select("x.*", "proposal_id")
    return each.join(targets.select("kind_of_target", F.col("target").cast("string").alias("target")).distinct(), ["kind_of_target", "target"], "left_semi")


def filter_choices(uploads: DataFrame) -> DataFrame:
    """(platform, languages, request_formats, root_formats) of registered uploads, each once, sorted, blanks left out."""
    some = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s")
    return uploads.where("registered").groupBy("platform").agg(some("language"), some("request_format"), some("root_format"))


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., values): (value, n) of counts (by..., value, n), most first, ties by value."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", "n")))
    return counts.groupBy(*by).agg(F.transform(order, lambda x: F.struct(x.value.alias("value"), x.n.alias("n"))).alias("values"))
