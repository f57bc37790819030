"""Suggested changes replayed in order: snapshots when they are made, acceptance, staleness and supersession.

What may be accepted depends on what was accepted before, so the events of targets that touch each other are replayed in
order. A target is a location, an annotation or a representation; targets touch where one suggestion changes several (a
new annotation for similar locations) or makes one that others change. Events are dealt out by the smallest target of
such a group, sorted, and streamed: a task holds the current states and open suggestions of one group, never its history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.sources.staging import staged

#: Kinds of suggestions about a location's annotation, in fixed names; they compete with each other.
LOCATION_KINDS = ("link", "new_annotation", "ignore", "unassign")
#: Fields of an annotation that an edit sets (fixed values).
ANNOTATION_FIELDS = ("name", "description", "note", "pii")
RESULT = "record string, id string, status string, base string, now string, stale boolean, decided_at long, superseded_by long, reason string"
EVENT = ["at", "turn", "id", "what", "kind", "platform", "location", "annotation", "representation", "values", "by", "staff", "stale_ok"]


def target_of(kind: Column, proposal_id: Column, location: Column, annotation: Column, representation: Column) -> Column:
    """What a suggestion is about: a location, an annotation, or a representation (a new one is named by its suggestion)."""
    named = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return (
        F.when(kind.isin(*LOCATION_KINDS), named("location:", location))
        .when(kind == "edit_annotation", named("annotation:", annotation))
        .when(kind == "new_representation", named("representation:r", proposal_id))
        .otherwise(named("representation:", representation))
    )


def group_key(kind: Column, location: Column, annotation: Column, of_representation: Column) -> Column:
    """What a queue shows together: the location (of the representation, if none is named), or the annotation of an edit."""
    own = F.coalesce(location, of_representation).cast("string")
    return F.when(kind == "edit_annotation", F.concat(F.lit("annotation:"), annotation.cast("string"))).otherwise(F.concat(F.lit("location:"), own))


def groups(proposals: DataFrame) -> DataFrame:
    """(target, component) of all targets: the smallest target that each touches, itself if none.

    proposals: (proposal_id, target, kind, also). The rounds grow with the logarithm of a chain of touching targets.
    """
    also = proposals.where("kind = 'new_annotation'").select("target", F.explode(F.coalesce("also", F.array().cast("array<string>"))).alias("x"))
    made = proposals.where("kind = 'new_annotation'").select("target", F.concat(F.lit("annotation:a"), F.col("proposal_id").cast("string")).alias("x"))
    edges = also.select("target", F.concat(F.lit("location:"), "x").alias("x")).union(made)
    now = staged(edges.select(F.greatest("target", "x").alias("u"), F.least("target", "x").alias("v")).where("u <> v").distinct(), "touching")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hooked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # larger ones to the smallest
        ups = hooked.where("v < u")
        low = ups.groupBy("u").agg(F.min("v").alias("m"))
        new = ups.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = staged(new, "touching")
        counted = tuple(new.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if counted == mark or not counted[0]:
            return new.select(F.col("u").alias("target"), F.col("v").alias("component")).distinct()
        now, mark = new, counted


class Replay:
    """States and open suggestions of a group of targets, event by event."""

    def __init__(self) -> None:
        self.states: dict[str, dict | None] = {}
        self.platforms: dict[str, str] = {}
        self.open: dict[int, dict] = {}
        self.about: dict[str, dict[int, dict]] = {}  # the open ones by target
        self.out: list[dict] = []

    def snapshot(self, p: dict) -> dict:
        state = self.states.get(p["target"])
        if p["kind"] == "delete_representation":
            return {"exists": state is not None}
        return {} if p["kind"] == "new_representation" or state is None else dict(state)

    def others(self, p: dict) -> list[dict]:
        """Open suggestions that compete with p."""
        kinds = LOCATION_KINDS if p["kind"] in LOCATION_KINDS else (p["kind"],)
        return [o for o in self.about.get(p["target"], {}).values() if o["kind"] in kinds and o is not p] if p["kind"] != "new_representation" else []

    def fault(self, p: dict) -> str | None:
        """Why a suggestion makes no sense now."""
        values, kind = p["values"], p["kind"]
        if kind in LOCATION_KINDS and p["target"] not in self.states:
            return "needs a location"
        if kind == "link" and (p["annotation"] is None or p["annotation_platform"] != p["platform"]):
            return "needs an annotation of the platform"
        if kind in ("new_annotation", "edit_annotation") and not str(values.get("name") or "").strip():
            return "needs a name"
        if kind == "new_annotation" and any(self.platforms.get(f"location:{x}") != p["platform"] for x in values.get("also") or []):
            return "another platform's location"
        if kind in ("edit_annotation", "edit_representation", "delete_representation") and self.states.get(p["target"]) is None:
            return "its target is gone"
        return "needs a location" if kind == "new_representation" and p["location"] is None else None

    def apply(self, p: dict) -> None:
        kind, values, target = p["kind"], p["values"], p["target"]
        if kind in LOCATION_KINDS:
            new = {"link": p["annotation"], "new_annotation": f"a{p['id']}"}.get(kind)
            if kind == "new_annotation":
                self.states[f"annotation:{new}"] = {f: values.get(f, False if f == "pii" else "") for f in ANNOTATION_FIELDS}
                for other in dict.fromkeys(f"location:{x}" for x in values.get("also") or []):
                    if other != target and self.states[other] == {"annotation": None, "ignored": False}:
                        self.states[other] = {"annotation": new, "ignored": False}
            self.states[target] = {"annotation": new, "ignored": kind == "ignore"}
        elif kind == "edit_annotation":
            self.states[target] = {f: values.get(f, False if f == "pii" else "") for f in ANNOTATION_FIELDS}
        elif kind == "delete_representation":
            self.states[target] = None
        else:
            was = self.states.get(target) or {}
            order = lambda r: (r.get("subject") or "", r.get("location") or 0, r.get("role") or 0)
            kept = sorted(values["metadata"], key=order) if "metadata" in values else was.get("metadata", [])
            self.states[target] = {k: v for k, v in values.items() if k != "metadata"} | {"metadata": kept}

    def close(self, p: dict, status: str, at: int | None, by: int | None = None, reason: str | None = None) -> None:
        self.open.pop(p["id"], None)
        self.about.get(p["target"], {}).pop(p["id"], None)
        self.emit(p, status, at, by, reason)

    def emit(self, p: dict, status: str, at: int | None, by: int | None, reason: str | None) -> None:
        now, base = self.snapshot(p), p.get("base", {})
        was = text(base)
        self.out.append({"record": "proposal", "id": str(p["id"]), "status": status, "base": was, "now": was if now == base else text(now), "stale": status == "open" and now != base, "decided_at": at, "superseded_by": by, "reason": reason})

    def event(self, e: dict) -> None:
        if e["what"] == "target":
            self.states[e["target"]] = e["values"]
            self.platforms[e["target"]] = e["platform"]
        elif e["what"] == "propose":
            reason = self.fault(e)
            e["base"] = self.snapshot(e)
            if reason:
                return self.close(e, "invalid", None, None, reason)
            if e["staff"]:
                self.apply(e)
                return self.close(e, "applied", e["at"])
            for own in [o for o in self.others(e) if o["by"] == e["by"]]:
                self.close(own, "withdrawn", None, None, "replaced by a newer one")
            self.open[e["id"]] = e
            self.about.setdefault(e["target"], {})[e["id"]] = e
        elif e["id"] in self.open:
            p = self.open[e["id"]]
            if e["what"] == "reject":
                self.close(p, "rejected", e["at"])
            elif e["what"] == "withdraw":
                self.close(p, "withdrawn", None)
            elif (self.snapshot(p) == p["base"] or e["stale_ok"]) and not self.fault(p):
                self.apply(p)
                for other in self.others(p):
                    self.close(other, "superseded", e["at"], p["id"], "another one was accepted")
                self.close(p, "accepted", e["at"])
        return None

    def finish(self) -> None:
        for p in list(self.open.values()):
            self.emit(p, "open", None, None, None)
        self.out += [{"record": "target", "id": target, "status": "gone" if state is None else "there", "now": text(state)} for target, state in self.states.items()]


ENCODE = json.JSONEncoder(sort_keys=True).encode


def text(data: dict | None) -> str | None:
    return None if data is None else ENCODE(data)


def events(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, EVENT..., annotation_platform): what there was at first, then each suggestion (with its target) and its decision.

    A decision only names its suggestion, which the task that replays it holds as long as it is open, and says stale_ok.
    """
    base = {"at": "created_at", "turn": F.lit(1), "id": F.col("proposal_id"), "what": F.lit("propose"), "by": F.col("proposed_by")}
    made = rows.withColumns({k: F.col(v) if isinstance(v, str) else v for k, v in base.items()}).select("target", *EVENT, "annotation_platform")
    decided = rows.where("action is not null").select("target", F.col("decided_at").alias("at"), F.lit(2).alias("turn"), F.col("proposal_id").alias("id"), F.col("action").alias("what"), "stale_ok")
    there = targets.select("target", "platform", F.col("state").alias("values"), F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("id"), F.lit("target").alias("what"))
    every = there.unionByName(made.unionByName(decided, allowMissingColumns=True), allowMissingColumns=True)
    return every.select("target", *EVENT, "annotation_platform")


def replayed(proposals: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, targets) after all events in order of time.

    proposals: (proposal_id, kind, platform, location, annotation, representation, values, proposed_by, staff, created_at,
    action, decided_at, stale_ok): values is JSON (an annotation's fields and `also`, a representation's fields and
    `metadata`); annotation_platform is that of a linked annotation; action is accept, reject, withdraw or null, tried at
    decided_at. targets: (target, platform, state), state as JSON, as they were at first.

    A suggestion of staff applies at once; one of others is open, and takes the place of its author's own open one for
    the same. Accepting an open one applies it, unless its target changed since (stale) and stale_ok isn't set, or it makes
    no sense any more; then it stays open. With it go the open ones that compete, at the same moment.
    suggestions: (proposal_id, status, base, now, stale, decided_at, superseded_by, reason), base and now the target when
    it was made and when it was closed (or now, for open ones). targets: (target, status, state). Of one time, what is
    made comes before what is decided, then by id. Accepted twice or decided before it was made: the second is ignored.
    """
    also = F.from_json(F.get_json_object("values", "$.also"), "array<string>")
    of = target_of(F.col("kind"), F.col("proposal_id"), F.col("location"), F.col("annotation"), F.col("representation"))
    rows = staged(proposals.withColumns({"target": of, "also": also}), "suggestions")
    component = staged(groups(rows.select("proposal_id", "target", "kind", "also")), "touching-targets")
    columns = ["component", "target", *EVENT, "annotation_platform"]
    dealt = events(rows, targets).join(component, "target", "left").withColumn("component", F.coalesce("component", "target")).select(columns)

    def table(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, replay = None, Replay()
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                e = dict(zip(columns, values))
                if e["component"] != current:
                    replay.finish()
                    out += replay.out
                    current, replay = e["component"], Replay()
                e["values"] = json.loads(e["values"]) if e["values"] else {}
                replay.event(e)
            out += replay.out
            replay.out = []
            yield table(out)
        replay.finish()
        yield table(replay.out)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RESULT.split(", "))])
    ordered = dealt.repartition("component").sortWithinPartitions("component", "at", "turn", "id")
    found = staged(ordered.mapInArrow(run, RESULT), "replayed")
    suggestions = found.where("record = 'proposal'").select(F.col("id").cast("long").alias("proposal_id"), "status", "base", "now", "stale", "decided_at", "superseded_by", "reason")
    return suggestions, found.where("record = 'target'").select(F.col("id").alias("target"), "status", F.col("now").alias("state"))


def changes(suggestions: DataFrame) -> DataFrame:
    """(proposal_id, field, now, proposed): what each suggestion changes; suggestions: (proposal_id, kind, annotation, values, base).

    About a location: its annotation before and after, "none" and "not a data point" in words, then the new annotation's
    description and note. An edit: the fields that differ. A deletion: the representation, then none.
    """
    get = lambda c, f: F.coalesce(F.get_json_object(c, f"$.{f}"), F.lit(""))
    now = F.when(get("base", "ignored") == "true", "not a data point").when(get("base", "annotation") != "", get("base", "annotation")).otherwise("none")
    then = F.when(F.col("kind") == "link", F.col("annotation")).when(F.col("kind") == "new_annotation", F.concat(F.lit("new: "), get("values", "name"))).when(F.col("kind") == "ignore", "not a data point").otherwise("none")
    row = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.cast("string").alias("now"), b.cast("string").alias("proposed"))
    more = [F.when(F.col("kind") == "new_annotation", row(f, F.lit(""), get("values", f))) for f in ("description", "note")]
    about = F.array(row("annotation", now, then), *more)
    yes = lambda c, f: F.when(get(c, f) == "true", "yes").when(get(c, f) == "false", "no").otherwise(get(c, f)) if f == "pii" else get(c, f)
    edits = F.array(*(F.when(yes("base", f) != yes("values", f), row(f, yes("base", f), yes("values", f))) for f in ANNOTATION_FIELDS))
    gone = F.array(row("representation", get("values", "representation"), F.lit("none")))
    found = F.when(F.col("kind").isin(*LOCATION_KINDS), about).when(F.col("kind") == "edit_annotation", edits).when(F.col("kind") == "delete_representation", gone)
    each = suggestions.select("proposal_id", F.explode(F.array_compact(found)).alias("x")).select("proposal_id", "x.*")
    return each.where("now <> '' or proposed <> ''")
