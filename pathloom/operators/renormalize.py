"""Applying a platform's current rules to schemas that are stored already, and moving the curation that hangs on old paths.

Stored schemas keep every key, so a rule that was added later can still rename them. Wrapper folders are lifted first,
then keys are renamed; both give maps of paths, which compose. Only documents in which a path changes are written anew.
Applying the rules once more changes nothing, since what is renamed carries the mark of it.

nodes: (doc_id, path, parent_path, name, kind, type, shape, shapes, format, n_present, n_null, n_count, position), with
doc_id as from normalize.document_id(); reason, why a node of kind unmatched isn't read, and keys, how many keys
became one, are used if they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.operators import normalize
from pathloom.operators.merge import KINDS
from pathloom.operators.profile import THRESHOLD, dominant_of
from pathloom.sources.staging import staged

RANKS = ("data", *KINDS)


def wrappers(nodes: DataFrame) -> DataFrame:
    """(doc_id, path) of wrapper folders: a container's only content, not empty, named like it.

    What systems leave in archives is no content: unmatched files that are ignored, and folders of nothing else.
    """
    reason = F.col("reason") if "reason" in nodes.columns else F.lit(None).cast("string")
    files = nodes.where("kind <> 'data'").select("doc_id", "path", "parent_path", "name", "kind", ((F.col("kind") == "unmatched") & F.coalesce(reason == "ignored", F.lit(False))).alias("ignored"))
    below = files.where("kind <> 'folder'").select("doc_id", F.explode(P.ancestors(F.col("path"))).alias("path"), "ignored")
    junk = below.groupBy("doc_id", "path").agg(F.bool_and("ignored").alias("_junk"))
    content = files.join(junk, ["doc_id", "path"], "left").where("path <> '' and not coalesce(_junk, false)")
    only = content.groupBy("doc_id", "parent_path").agg(F.count("*").alias("_n"), F.min(F.struct("path", "name", "kind")).alias("x")).where("_n = 1 and x.kind = 'folder'")
    full = files.where("path <> ''").select("doc_id", F.col("parent_path").alias("path")).distinct()
    inside = files.where("kind = 'container'").select("doc_id", F.col("path").alias("parent_path"), F.col("name").alias("container"))
    found = only.select("doc_id", "parent_path", "x.path", "x.name").join(inside, ["doc_id", "parent_path"]).join(full, ["doc_id", "path"], "left_semi")
    return found.where(N.named_like(F.col("name"), F.col("container"))).select("doc_id", "path")


def lifted(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, new_path) of all that lies in wrapper folders, and of these: each takes its own segment away."""
    gone = wrappers(nodes).select("doc_id", F.col("path").alias("up"), P.depth(F.col("path")).alias("at"))
    ups = nodes.select("doc_id", "path", F.explode(P.ancestors(F.col("path"))).alias("up"))
    cut = ups.join(gone, ["doc_id", "up"]).groupBy("doc_id", "path").agg(F.collect_set("at").alias("cut"))
    left = F.filter(P.segments(F.col("path")), lambda s, i: ~F.array_contains("cut", (i + 1).cast("int")))
    return cut.select("doc_id", "path", F.array_join(F.transform(left, lambda s: F.concat(F.lit("/"), s)), "").alias("new_path"))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """One map (doc_id, path, new_path) for two that follow each other; paths that end where they began are left out."""
    second = then.select("doc_id", F.col("path").alias("_step"), F.col("new_path").alias("_end"))
    both = first.join(second, (first.doc_id == second.doc_id) & (first.new_path == second._step), "left").select(first.doc_id, first.path, F.coalesce("_end", "new_path").alias("new_path"))
    only = then.join(first, ["doc_id", "path"], "left_anti").join(first.select("doc_id", F.col("new_path").alias("path")), ["doc_id", "path"], "left_anti")
    return both.unionByName(only.select("doc_id", "path", "new_path")).where("path <> new_path")


def moved_nodes(nodes: DataFrame, map_: DataFrame) -> DataFrame:
    """nodes at their new paths; those that are wrappers, which become their containers, are dropped."""
    rows = nodes.join(map_, ["doc_id", "path"], "left").withColumn("_to", F.coalesce("new_path", "path"))
    holds = rows.where("kind = 'container'").select(F.col("doc_id").alias("_doc"), F.col("_to").alias("_at"), F.lit(True).alias("_is_container"))
    kept = rows.join(holds, (F.col("doc_id") == F.col("_doc")) & (F.col("_to") == F.col("_at")), "left").where("new_path is null or kind <> 'folder' or not coalesce(_is_container, false)")
    return kept.withColumn("path", F.col("_to")).withColumn("parent_path", P.parent(F.col("_to"))).drop("new_path", "_to", "_doc", "_at", "_is_container")


def renamed_paths(nodes: DataFrame, variable_keys: dict[str, list[str]] | list[str] = [], keep_keys: dict[str, list[str]] | list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, path, new_path) that the rules make of stored nodes: wrappers lifted, then keys and media renamed."""
    lifts = staged(lifted(nodes), "lifted-wrappers")
    keys = normalize.renames(moved_nodes(nodes, lifts).select("doc_id", "path", "name", "kind").distinct(), variable_keys, keep_keys)
    return composed(lifts, keys)


def rewritten(nodes: DataFrame, map_: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which map_ changes a path, merged where several paths became one; others aren't returned.

    A merged node has the union of types, summed counts and shapes, the best kind, the first position, the commonest mask
    of the keys it stands for as its name, and their number as keys (null for a node that was never renamed).
    """
    known = nodes if "keys" in nodes.columns else nodes.withColumn("keys", F.lit(None).cast("long"))
    changed = known.join(map_.select("doc_id").distinct(), "doc_id", "left_semi")
    lifts = moved_nodes(changed.withColumn("_old", F.col("path")), map_)
    old, new = P.last(F.col("_old")), P.last(F.col("path"))
    renamed = (F.col("path") != F.col("_old")) & (old != new) & F.contains(new, F.lit(normalize.VARIABLE))
    stem, ending = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1))
    media = F.concat(S.mask_name(stem), ending)
    mask = F.when(renamed & (F.col("kind") == "media"), media).when(renamed, N.masked_key(P.unescape(new), P.unescape(old))).otherwise(F.col("name"))
    rows = lifts.withColumns({"_mask": F.struct(mask.alias("mask"), F.coalesce("keys", F.lit(1)).cast("long").alias("n")), "_renamed": renamed})
    # A path that many became has few masks, types, shapes and formats: these are counted before anything is gathered.
    rows = rows.withColumn("_type", F.coalesce("type", F.array().cast("array<string>"))).select("*", F.posexplode_outer("shapes").alias("_at", "_cell"))
    once = F.coalesce(F.col("_at"), F.lit(0)) == 0
    counted = F.coalesce("format", F.lit("")) != ""
    same = ["doc_id", "path", F.col("_mask.mask").alias("mask"), "_type", F.col("_cell.shape").alias("cell"), F.when(counted, F.struct("shape", "format")).alias("_format")]
    part = rows.groupBy(*same).agg(
        F.first("parent_path").alias("parent_path"), F.min(F.array_position(F.array(*map(F.lit, RANKS)), F.col("kind"))).alias("_kind"),
        *(F.sum(F.when(once, F.col(c))).alias(c) for c in ("n_present", "n_null", "n_count")), F.min("position").alias("position"), F.sum(F.when(once, F.col("_mask.n"))).alias("_of_mask"),
        F.bool_or(F.col("_renamed") | F.col("keys").isNotNull()).alias("_merged"), F.sum("_cell.n").alias("_n"),
    )
    by_mask = part.groupBy("doc_id", "path", "mask").agg(
        F.first("parent_path").alias("parent_path"), F.min("_kind").alias("_kind"), F.collect_set("_type").alias("_types"), *(F.sum(c).alias(c) for c in ("n_present", "n_null", "n_count", "_of_mask")),
        F.min("position").alias("position"), F.bool_or("_merged").alias("_merged"), F.collect_list(F.when(F.col("cell").isNotNull() | F.col("_n").isNotNull(), F.struct(F.col("cell").alias("shape"), F.col("_n").alias("n")))).alias("_cells"), F.collect_set("_format").alias("_formats"),
    )
    out = by_mask.groupBy("doc_id", "path").agg(
        F.first("parent_path").alias("parent_path"), F.min("_kind").alias("_kind"), S.type_union(F.flatten(F.flatten(F.collect_set("_types")))).alias("type"), *(F.sum(c).alias(c) for c in ("n_present", "n_null", "n_count")),
        F.min("position").alias("position"), F.min_by("mask", F.struct(-F.col("_of_mask"), F.col("mask"))).alias("_name"), F.sum("_of_mask").alias("_keys"), F.bool_or("_merged").alias("_merged"),
        F.flatten(F.collect_list("_cells")).alias("_cells"), F.array_distinct(F.flatten(F.collect_set("_formats"))).alias("_formats"),
    )
    names = F.array_sort(F.array_distinct(F.transform("_cells", lambda c: c.shape)))
    total = lambda s: F.aggregate(F.filter("_cells", lambda c: c.shape == s), F.lit(0).cast("long"), lambda n, c: n + c.n)
    out = out.withColumn("shapes", F.transform(names, lambda s: F.struct(s.alias("shape"), total(s).alias("n"))))
    out = out.withColumn("shape", dominant_of(F.col("shapes"), threshold))
    formats = F.array_distinct(F.transform(F.filter("_formats", lambda f: f.shape == F.col("shape")), lambda f: f.format))
    kind = F.element_at(F.array(*map(F.lit, RANKS)), F.col("_kind").cast("int"))
    return out.select(
        "doc_id", "path", "parent_path", F.col("_name").alias("name"), kind.alias("kind"), "type", "shape", "shapes", F.when(F.size(formats) == 1, formats[0]).alias("format"),
        "n_present", "n_null", "n_count", "position", F.when(F.col("_merged"), F.col("_keys")).alias("keys"),
    )


def report(map_: DataFrame) -> DataFrame:
    """(platform, uploads, paths): a dry run's result; how many uploads change, and the new paths, sorted."""
    rows = map_.select(normalize.platform_of(F.col("doc_id")).alias("platform"), "doc_id", "new_path")
    return rows.groupBy("platform").agg(F.count_distinct("doc_id").alias("uploads"), F.array_sort(F.collect_set("new_path")).alias("paths"))


def ends(moves: DataFrame, rounds: int = 40) -> DataFrame:
    """(platform, path, new_path, ord) with each path's last new path, where new paths are moved on themselves.

    Each round doubles the steps that a path is followed. Paths in a circle, which no order of moves can settle, stay
    where they are.
    """
    now = staged(moves.select("platform", "path", "new_path", "ord").where("path <> new_path"), "moves")
    for _ in range(rounds):
        on = now.select("platform", F.col("path").alias("new_path"), F.col("new_path").alias("_next"))
        further = staged(now.join(on, ["platform", "new_path"], "left").select("platform", "path", F.coalesce("_next", "new_path").alias("new_path"), "ord", F.col("_next").isNotNull().alias("_on")), "moves")
        now = further.drop("_on")
        if not further.where("_on and path <> new_path").limit(1).count():
            return now.where("path <> new_path")
    circling = now.select("platform", F.col("path").alias("new_path"))
    return now.join(circling, ["platform", "new_path"], "left_anti")


def moved_curation(locations: DataFrame, moves: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locations, conflicts, moved) after paths were renamed.

    locations: (platform, location, path, annotation, ignored, examples). moves: (platform, path, new_path, ord), ord their
    order. observed: (platform, location) that some upload still has; such a location stays as it is, and so does one
    whose new path is no location. The new location keeps its annotation; without one it takes that of the first old one
    that has any; others are conflicts (platform, path, kept, dropped). Without annotations it is ignored if one of them
    was. Examples are joined, each of the new location's or an earlier old one's once. Locations that moved are gone;
    moved is (platform, location, new_location).
    """
    here = locations.select("platform", "path", F.col("location").alias("_old"))
    there = locations.select("platform", F.col("path").alias("new_path"), F.col("location").alias("new_location"))
    gone = here.join(observed.select("platform", F.col("location").alias("_old")), ["platform", "_old"], "left_anti")
    possible = moves.join(gone.select("platform", "path"), ["platform", "path"], "left_semi").join(there.select("platform", "new_path"), ["platform", "new_path"], "left_semi")
    last = ends(possible).join(gone, ["platform", "path"]).join(there, ["platform", "new_path"])
    moved = staged(last.select("platform", F.col("_old").alias("location"), "new_location", "ord"), "moved-locations")
    olds = moved.join(locations.drop("path"), ["platform", "location"])
    gathered = olds.groupBy("platform", "new_location").agg(
        F.min_by("annotation", F.when(F.col("annotation").isNotNull(), F.struct("ord", "location"))).alias("_first"),
        F.bool_or(F.col("ignored") & F.col("annotation").isNull()).alias("_ignored"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "location", "examples"))), lambda x: x.examples).alias("_lists"),
    ).withColumnRenamed("new_location", "location")
    joined = F.aggregate("_lists", F.coalesce("examples", F.array().cast("array<string>")), lambda have, more: F.concat(have, F.filter(F.coalesce(more, F.array().cast("array<string>")), lambda v: ~F.array_contains(have, v))))
    rows = locations.join(moved.select("platform", "location"), ["platform", "location"], "left_anti").join(gathered, ["platform", "location"], "left")
    annotation = F.coalesce("annotation", "_first")
    ignored = F.when(F.col("annotation").isNotNull(), F.col("ignored")).when(F.col("_first").isNotNull(), False).otherwise(F.col("ignored") | F.coalesce("_ignored", F.lit(False)))
    after = rows.select("platform", "location", "path", annotation.alias("annotation"), ignored.alias("ignored"), F.when(F.col("_lists").isNotNull(), joined).otherwise(F.col("examples")).alias("examples"))
    kept = after.select("platform", F.col("location").alias("new_location"), "path", F.col("annotation").alias("kept"))
    conflicts = olds.where("annotation is not null").join(kept, ["platform", "new_location"]).where("annotation <> kept").select("platform", "path", "kept", F.col("annotation").alias("dropped"))
    return after, conflicts, moved.select("platform", "location", "new_location")


def remapped_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows (platform, representation, role, subject, location) at the new locations, each once."""
    to = moved.select("platform", "location", "new_location")
    return links.join(to, ["platform", "location"], "left").select("platform", "representation", "role", "subject", F.coalesce("new_location", "location").alias("location")).distinct()


def remapped_proposals(proposals: DataFrame, moved: DataFrame) -> DataFrame:
    """proposals (proposal_id, platform, location, also, metadata, base_metadata) pointing at the new locations.

    also is a list of locations: each stands once, where it or one that became it stood first. metadata lists rows
    (subject, role, location), whose order and number stay.
    """
    to = moved.select("platform", F.col("location").alias("_from"), F.col("new_location").alias("_to"))
    lists = ["metadata", "base_metadata"]
    inside = F.flatten(F.array(F.coalesce("also", F.array().cast("array<bigint>")), F.array("location"), *(F.coalesce(F.transform(c, lambda r: r.location), F.array().cast("array<bigint>")) for c in lists)))
    each = proposals.select("proposal_id", "platform", F.explode(F.array_distinct(F.array_compact(inside))).alias("_from"))
    found = each.join(to, ["platform", "_from"]).groupBy("proposal_id").agg(F.map_from_entries(F.collect_list(F.struct("_from", "_to"))).alias("_map"))
    rows = proposals.join(found, "proposal_id", "left")
    new = lambda c: F.coalesce(F.element_at("_map", c), c)
    mapped = {c: F.transform(c, lambda r: F.struct(r.subject.alias("subject"), r.role.alias("role"), new(r.location).alias("location"))) for c in lists}
    mapped |= {"also": F.array_distinct(F.transform("also", new)), "location": new(F.col("location"))}
    return rows.withColumns({c: F.when(F.col("_map").isNull(), F.col(c)).otherwise(v) for c, v in mapped.items()}).drop("_map")


def renormalized(nodes: DataFrame, variable_keys: dict[str, list[str]] | list[str], keep_keys: dict[str, list[str]] | list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(renames, report, new nodes of the changed documents): the rules applied to all stored documents."""
    nodes = staged(nodes, "stored-nodes")  # read several times
    map_ = staged(renamed_paths(nodes, variable_keys, keep_keys), "renames")
    return map_, report(map_), rewritten(nodes, map_, threshold)


def in_order(map_: DataFrame, uploads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(platform, path, new_path, ord) of renames, one row a path: those of the last upload that has it, in order of first uploads.

    uploads: (doc_id, requested_at); ord orders by request date, upload and path.
    """
    rows = map_.join(uploads.select("doc_id", "requested_at"), "doc_id").select(normalize.platform_of(F.col("doc_id")).alias("platform"), "path", "new_path", F.struct("requested_at", "doc_id", "path").alias("at"))
    return rows.groupBy("platform", "path").agg(F.max_by("new_path", "at").alias("new_path"), F.min("at").alias("ord"))
