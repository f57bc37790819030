"""Comparing two schemas: what was added, removed, moved or changed, and what likely corresponds.

The set parts are joins on paths. Moves and renames depend on what was found on the levels above, so they run per pair
of schemas in a grouped function over schema-sized input.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.sources.staging import staged

ALIKE, SURE = 0.5, 1.0
#: Parts of a rename's score (fixed values): at all, same position, same inside or format, same shape.
BASE, SAME_PLACE, SAME_INSIDE, SAME_SHAPE = 0.5, 0.3, 0.2, 0.1
SUMMARY = ["kind", "name", "type", "shape", "format"]


def changed_fields(a: str, b: str) -> Column:
    """Names of fields that differ between columns a_* and b_* in a way that isn't up to the data."""
    own = lambda side, f: F.col(f"{side}_{f}")
    types = lambda side: F.array_sort(F.array_remove(own(side, "type"), "null"))
    shape = lambda side: F.when(own(side, "shape").isin(*S.NOISE), None).otherwise(own(side, "shape"))
    tests = {
        "kind": own(a, "kind") != own(b, "kind"),
        "type": (F.size(types(a)) > 0) & (F.size(types(b)) > 0) & (types(a) != types(b)),
        "shape": shape(a) != shape(b),
        "format": own(a, "format") != own(b, "format"),
    }
    return F.array_compact(F.array(*(F.when(t, f) for f, t in tests.items())))


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select("pair", "path", *(F.col(c).alias(f"{side}_{c}") for c in SUMMARY))


def tops(paths: DataFrame) -> DataFrame:
    """Of (pair, path) the paths without an ancestor among them."""
    above = paths.select("pair", "path", F.explode(P.ancestors(F.col("path"))).alias("up")).where("up <> path").union(paths.where("path <> ''").select("pair", "path", F.lit("")))
    inside = above.join(paths.withColumnRenamed("path", "up"), ["pair", "up"], "left_semi").select("pair", "path").distinct()
    return paths.join(inside, ["pair", "path"], "left_anti")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, path, status, fields, other): changes between nodes (pair, path, kind, name, type, shape, format).

    status is added or removed (tops of subtrees only), moved_from or moved_to (other: where to or from), or changed.
    """
    joined = _sided(before, "b").join(_sided(after, "a"), ["pair", "path"], "full")
    both = F.col("b_kind").isNotNull() & F.col("a_kind").isNotNull()
    changed = joined.where(both).withColumn("fields", changed_fields("b", "a")).where(F.size("fields") > 0)
    moved = staged(moves(before, after), "moves")  # used four times
    empty = F.array().cast("array<string>")

    def rest(ours: DataFrame, theirs: DataFrame, side: str, status: str) -> DataFrame:
        only = ours.select("pair", "path").join(theirs, ["pair", "path"], "left_anti")
        up = only.select("pair", "path", F.explode(F.array_append(P.ancestors(F.col("path")), F.lit(""))).alias("up"))
        taken = up.join(moved.select("pair", F.col(side).alias("up")), ["pair", "up"], "left_semi").select("pair", "path").distinct()
        return tops(only.join(taken, ["pair", "path"], "left_anti")).select("pair", "path", F.lit(status).alias("status"), empty.alias("fields"), F.lit(None).cast("string").alias("other"))

    return (
        changed.select("pair", "path", F.lit("changed").alias("status"), "fields", F.lit(None).cast("string").alias("other"))
        .union(rest(before, after, "old", "removed"))
        .union(rest(after, before, "new", "added"))
        .union(moved.select("pair", F.col("old").alias("path"), F.lit("moved_from"), empty, F.col("new")))
        .union(moved.select("pair", F.col("new").alias("path"), F.lit("moved_to"), empty, F.col("old")))
    )


def status_of(paths: DataFrame, comparison: DataFrame) -> DataFrame:
    """(pair, path, status) of any paths: subtrees inherit; moved before added before removed before changed."""
    order = F.array(*map(F.lit, ("moved_from", "moved_to", "added", "removed", "changed", "unchanged")))
    up = paths.select("pair", "path", F.explode(F.array_append(P.ancestors(F.col("path")), F.lit(""))).alias("up"))
    found = up.join(comparison.select("pair", F.col("path").alias("up"), "status"), ["pair", "up"]).where("status <> 'changed' or up = path")
    best = found.groupBy("pair", "path").agg(F.min_by("status", F.array_position(order, F.col("status"))).alias("status"))
    return paths.join(best, ["pair", "path"], "left").withColumn("status", F.coalesce("status", F.lit("unchanged")))


# --- moves and renames, per pair of schemas: tables of candidates, level by level from the top ---------------------


class Node(NamedTuple):
    """A node with its types (all sorted, and as text without null) and its place among its siblings."""

    path: str
    kind: str | None
    name: str
    every: tuple[str, ...]
    types: str
    shape: str
    format: str
    parent: str | None
    depth: int
    structure: bool
    place: int


def _nodes(frame: pd.DataFrame) -> dict[str, Node]:
    """A schema's nodes by path, in order of position and path; a path that comes twice counts once."""
    columns = {c: frame[c].tolist() for c in frame.columns}
    rows = range(len(frame))
    text = lambda c, i: columns[c][i] if isinstance(columns[c][i], str) else ""
    paths, given = columns["path"], columns.get("place")
    order = [(pd.isna(x), x) for x in columns["position"]] if "position" in columns else [()] * len(frame)
    found: dict[str, Node] = {}
    places: dict[str | None, int] = {}
    for i in sorted(rows, key=lambda i: (*(order[i] if order[i][:1] != (True,) else (True, 0)), paths[i])):
        path, kind = paths[i], columns["kind"][i]
        if path in found:
            continue
        parent = path.rpartition("/")[0] if path else None
        every = tuple(sorted(columns["type"][i])) if columns["type"][i] is not None else ()
        places[parent] = places.get(parent, -1) + 1
        structure = kind in ("file", "data") and ("object" in every or "array" in every)
        found[path] = Node(path, kind, text("name", i), every, "|".join(t for t in every if t != "null"), text("shape", i), text("format", i), parent, path.count("/"), structure, places[parent] if given is None else given[i])
    return found


def _inside(nodes: dict[str, Node], paths: list[str], root: str, kinds: bool) -> set[tuple]:
    """What lies below root, and root itself, as (path from there, kind or None); paths are those of nodes, sorted."""
    found = [root, *paths[bisect_left(paths, root + "/") : bisect_left(paths, root + "0")]]  # a zero comes next to a slash
    return {(p[len(root) :], nodes[p].kind if kinds else None) for p in found}


def _share(old: set[tuple], new: set[tuple]) -> float:
    """Of what lies in both or either, the share that lies in both."""
    both = len(old & new)
    return both / (len(old) + len(new) - both)


def _steady(x: Node, y: Node) -> bool:
    """Whether nothing differs between two nodes that isn't up to the data."""
    if x.kind is None or x.kind != y.kind or (x.types != y.types and x.types and y.types) or (x.format != y.format and x.format and y.format):
        return False
    return x.shape == y.shape or not x.shape or not y.shape or x.shape in S.NOISE or y.shape in S.NOISE


def _lone(nodes: Iterable[Node]) -> dict[tuple, Node]:
    """Nodes whose name and kind are there once."""
    found: dict[tuple, Node | None] = {}
    for r in nodes:
        key = (r.name, r.kind)
        found[key] = None if key in found else r
    return {key: r for key, r in found.items() if r is not None}


def found_moves(before: dict[str, Node], after: dict[str, Node]) -> list[tuple[str, str]]:
    """(old, new) of subtrees that moved, sorted, from one pair of schemas.

    Of what only one side has, nodes whose name and kind are there once on each side correspond if they are alike inside.
    Shallow ones are settled first, those of a level in order of path; what lies in a moved subtree moves with it, which
    may leave a name there once.
    """
    gone, came = [r for p, r in before.items() if p not in after], [r for p, r in after.items() if p not in before]
    names = {(r.name, r.kind) for r in came}
    gone = [r for r in gone if (r.name, r.kind) in names]
    ours, theirs = sorted(before), sorted(after)
    out: list[tuple[str, str]] = []

    def candidates() -> list[tuple[Node, Node]]:
        old, new = _lone(gone), _lone(came)
        return sorted(((r, new[key]) for key, r in old.items() if key in new and _steady(r, new[key])), key=lambda pair: pair[0].path)

    pairs, alike = candidates(), {}
    for depth in sorted({r.depth for r in gone}):
        past = ""
        while True:
            for old, new in pairs:
                if old.depth != depth or old.path <= past:
                    continue
                if (old.path, new.path) not in alike:
                    alike[old.path, new.path] = _share(_inside(before, ours, old.path, True), _inside(after, theirs, new.path, True)) >= ALIKE
                if alike[old.path, new.path]:
                    break
            else:
                break
            past = old.path
            out.append((past, new.path))
            outside = lambda nodes, root: [r for r in nodes if r.path != root and not r.path.startswith(root + "/")]
            gone, came = outside(gone, past), outside(came, new.path)
            pairs = candidates()
    return sorted(out)


def _own(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The columns under names of this side's own, so that two sides of one table can meet."""
    return nodes.select(*(F.col(c).alias(c) for c in columns))


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, old, new) of subtrees that moved."""

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(found_moves(_nodes(old), _nodes(new)), columns=["old", "new"], dtype=object).assign(pair=key[0])[["pair", "old", "new"]]

    columns = ["pair", "path", *SUMMARY]
    return _own(before, columns).groupBy("pair").cogroup(_own(after, columns).groupBy("pair")).applyInPandas(run, "pair string, old string, new string")


def _carried(path: str, to: dict[str, str]) -> str:
    """path with its nearest mapped ancestor (or itself) replaced."""
    for i in [len(path), *(i for i in range(len(path) - 1, -1, -1) if path[i] == "/")]:
        if path[:i] in to:
            return to[path[:i]] + path[i:]
    return path


def _point(node: Node) -> bool:
    """Whether a node carries meaning, by the rule of profile.is_data_point()."""
    if node.path.endswith("/[]"):
        return node.kind in ("media", "data")
    return node.kind == "media" or (node.kind == "file" and "array" in node.every) or (node.kind == "data" and node.types != "object")


def _exclusive(pairs: list[tuple], file_order: dict[str, tuple[int, ...]]) -> tuple[list[tuple], list[tuple[str, str, float]]]:
    """pairs (new node, old node, score) of a level with ranks, and the structures (new, old, score) that have one best candidate.

    New nodes choose in the order of their file; what a structure took is no candidate of those after it.
    """
    by_new: dict[str, list[tuple]] = {}
    for pair in pairs:
        by_new.setdefault(pair[0].path, []).append(pair)
    taken: set[str] = set()
    kept, chosen = [], []
    for path in sorted(by_new, key=lambda p: (file_order[p], p)):
        own = sorted(by_new[path], key=lambda pair: (-pair[2], pair[1].place))
        if own[0][0].structure:
            own = [pair for pair in own if pair[1].path not in taken]
            if own and (len(own) == 1 or own[0][2] > own[1][2]):
                taken.add(own[0][1].path)
                chosen.append((path, own[0][1].path, own[0][2]))
        kept += [(*pair, rank) for rank, pair in enumerate(own)]
    return kept, chosen


def found_suggestions(there: dict[str, Node], here: dict[str, Node]) -> list[tuple[str, str, str, float, int]]:
    """(path, known_path, reason, score, rank): what the data points here that aren't there correspond to, best first.

    Nodes of a level look at the known children of what their parents correspond to: the same name there is a move,
    others of one kind and type are scored. A structure with one best candidate corresponds to it from there on.
    """
    moved = found_moves(there, here)
    to_new, to_known = dict(moved), {now: old for old, now in moved}
    score = dict.fromkeys(to_known, SURE)
    ours, theirs = sorted(there), sorted(here)
    kids: dict[tuple, list[Node]] = {}
    for r in there.values():
        kids.setdefault((r.parent, r.kind, r.types), []).append(r)
    ends = lambda p: [*(i for i, c in enumerate(p) if c == "/" and i), len(p)]
    file_order = {p: tuple(here[p[:i]].place if p[:i] in here else 0 for i in ends(p)) for p in here}
    levels: dict[int, list[Node]] = {}
    for r in here.values():
        if r.path and r.kind not in ("folder", "container") and r.path not in there:
            levels.setdefault(r.depth, []).append(r)
    out: list[tuple] = []
    for depth in sorted(levels):
        pairs, trusts, totals, inner = [], [], [], {}
        free = functools.cache(lambda p: _carried(p, to_new) not in here)  # noqa: B023
        for r in levels[depth]:
            p = r.path
            direct = _carried(p, to_known)
            trust = next((score[p[:i]] for i in [len(p), *(i for i in range(len(p) - 1, -1, -1) if p[i] == "/")] if p[:i] in score), SURE)
            if direct in there:
                if _point(r):
                    out.append((p, direct, "moved", trust, 0))
                continue
            up = r.parent if r.parent in there else _carried(r.parent, to_known)
            for k in kids.get((up, r.kind, r.types), ()):
                if not _steady(r, k) or not free(k.path):
                    continue
                if r.structure:
                    for side, nodes, paths, root in (("old", there, ours, k.path), ("new", here, theirs, p)):
                        if (side, root) not in inner:
                            inner[side, root] = _inside(nodes, paths, root, False)
                    share = _share(inner["old", k.path], inner["new", p])
                    if share < ALIKE:
                        continue
                    more = SAME_INSIDE * share
                else:
                    more = SAME_INSIDE if r.format and r.format == k.format else SAME_SHAPE if r.shape and r.shape == k.shape else 0.0
                pairs.append((r, k))
                trusts.append(trust)
                totals.append(BASE + SAME_PLACE * (r.place == k.place) + more)
        scores = np.round(np.array(totals) * np.array(trusts), 2).tolist()
        ranked, clear = _exclusive([(*pair, x) for pair, x in zip(pairs, scores)], file_order)
        for path, old, value in clear:
            to_known[path], to_new[old], score[path] = old, path, value
        out += [(r.path, k.path, "renamed", x, rank) for r, k, x, rank in ranked if _point(r)]
    return out


def suggestions(known: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, path, known_path, reason, score, rank): what unknown data points likely correspond to, best first.

    Of known the rows that relevant() names are enough; they come with their place among all siblings, some of them twice.
    """

    def run(key: tuple, old: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        found = found_suggestions(_nodes(old), _nodes(now))
        return pd.DataFrame([(key[0], *row) for row in found], columns=["pair", "path", "known_path", "reason", "score", "rank"])

    columns = ["pair", "path", *SUMMARY, "position"]
    ours = _own(known, [*columns, "place"] if "place" in known.columns else columns)
    return ours.groupBy("pair").cogroup(_own(new, columns).groupBy("pair")).applyInPandas(run, "pair string, path string, known_path string, reason string, score double, rank int")


def placed(known: DataFrame, schema: list[str]) -> DataFrame:
    """known with place, the number of siblings before a node; the columns of schema name a schema."""
    siblings = W.partitionBy(*schema, P.parent(F.col("path"))).orderBy("position", "path")
    return known.withColumn("place", (F.row_number().over(siblings) - 1).cast("long"))


def relevant(known: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, path, ..., place): of the schemas known all that suggestions() for the pairs of new can depend on, some rows twice.

    known: (of, path, ..., position, place), one row per schema and path, several pairs may ask for a schema; new:
    (pair, of, path, ...). These are the paths of new and their parents; nodes of a name and kind that only new has, which
    may have moved; children of known parents that fit a node of new; and what lies in either, if it can be a structure.
    So a pair is never joined with a whole schema.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    types = F.array_join(F.array_sort(F.filter(F.coalesce("type", F.array().cast("array<string>")), lambda t: t != "null")), "|")
    keys = {"_name": text("name"), "_kind": text("kind"), "_types": types, "_up": F.coalesce(P.parent(F.col("path")), F.lit(""))}
    known = known.withColumns(keys)
    own = ["pair", *(c for c in known.columns if c not in ("of", *keys))]
    came = new.join(known.select("of", "path"), ["of", "path"], "left_anti").withColumns(keys | {"_shape": text("shape"), "_format": text("format")})
    came = came.select("pair", "of", "path", *keys, "_shape", "_format")
    here = new.select("pair", "of", "path").union(new.where("path <> ''").select("pair", "of", P.parent(F.col("path")))).distinct()
    same = known.join(here, ["of", "path"]).select(own)
    moved = known.join(came.select("pair", "of", "_name", "_kind").distinct(), ["of", "_name", "_kind"]).join(new.select("pair", "path"), ["pair", "path"], "left_anti")
    inside = lambda c: ~F.col(c).isin("folder", "container")
    wanted = came.where((F.col("path") != "") & inside("_kind")).select("pair", "of", "_up", "_kind", "_types", "_shape", "_format").distinct()
    silent = lambda c, *noise: F.col(c).isNull() | F.col(c).isin("", *noise) | F.col(f"_{c}").isin("", *noise)
    fits = ((F.col("shape") == F.col("_shape")) | silent("shape", *S.NOISE)) & ((F.col("format") == F.col("_format")) | silent("format"))
    fitting = known.where(F.col("path") != "").join(wanted, ["of", "_up", "_kind", "_types"]).where(fits)
    roots = moved.select("pair", "of", F.col("path").alias("_root"))
    roots = roots.union(fitting.where(F.arrays_overlap("type", F.array(F.lit("object"), F.lit("array")))).select("pair", "of", "path")).distinct()
    below = known.withColumn("_root", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))))).join(roots, ["of", "_root"])
    return same.union(moved.select(own)).union(fitting.select(own)).union(below.select(own))


def inspect(known: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, path, status, known_path): each data point of new as known, matched or new, and missing ones of known."""
    from pathloom.operators.profile import is_data_point

    point = is_data_point(F.col("kind"), F.col("path"), F.col("type"))
    ours, theirs = new.where(point).select("pair", "path"), known.select("pair", "path", point.alias("point"))
    best = staged(suggestions(known, new), "suggestions").where("rank = 0").select("pair", "path", "known_path")
    rows = ours.join(theirs.withColumn("known", F.lit(True)), ["pair", "path"], "left").join(best, ["pair", "path"], "left")
    status = F.when(F.col("known"), "known").when(F.col("known_path").isNotNull(), "matched").otherwise("new")
    rows = rows.select("pair", "path", status.alias("status"), F.when(F.col("known").isNull(), F.col("known_path")).alias("known_path"))
    seen = rows.select("pair", "path").union(rows.where("known_path is not null").select("pair", "known_path"))
    missing = theirs.where("point").select("pair", "path").join(seen, ["pair", "path"], "left_anti")
    return rows.union(missing.select("pair", "path", F.lit("missing"), F.lit(None).cast("string")))


def share(inspection: DataFrame) -> DataFrame:
    """(pair, share): known and matched of all data points; null without any."""
    points = F.count_if(F.col("status") != "missing")
    return inspection.groupBy("pair").agg((F.count_if(F.col("status").isin("known", "matched")) / F.nullif(points, F.lit(0))).alias("share"))
