"""Annotations, representations and their vocabularies: who sees what, usage, and rules that rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.operators.timeline import dated


def visible_to(rows: DataFrame, owner: str, user: int | None, staff: bool = False) -> DataFrame:
    """Nothing for strangers, all for staff, else what the user owns."""
    return rows if staff else rows.where(F.lit(user is not None) & (F.col(owner) == F.lit(user)))


def terms_for(terms: DataFrame, user: int, current: int | None = None) -> DataFrame:
    """Approved terms, the user's own, and the one that is chosen already."""
    return terms.where(F.col("approved") | (F.col("created_by") == user) | F.coalesce(F.col("id") == F.lit(current), F.lit(False)))


def taken_terms(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """Names in asked (name) that a term has already, whatever the case."""
    return asked.join(terms.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_semi")


def annotation_list(locations: DataFrame, observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, annotation, locations, last_seen) of every annotation."""
    named = locations.where("annotation is not null").select("platform", "location", "annotation")
    seen = dated(observations, uploads).groupBy("platform", "location").agg(F.max("requested_at").alias("seen"))
    return named.join(seen, ["platform", "location"], "left").groupBy("platform", "annotation").agg(F.count_distinct("location").alias("locations"), F.max("seen").alias("last_seen"))


def annotation_detail(locations: DataFrame, observations: DataFrame, uploads: DataFrame) -> DataFrame:
    """(platform, annotation, location, languages, formats, last_seen): sorted, with unknown for none given."""
    named = locations.where("annotation is not null").select("platform", "location", "annotation")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = observations.join(uploads.where("registered"), ["platform", "upload_id"]).join(named, ["platform", "location"])
    return rows.groupBy("platform", "annotation", "location").agg(F.array_sort(F.collect_set(known("language"))).alias("languages"), F.array_sort(F.collect_set(known("request_format"))).alias("formats"), F.max("requested_at").alias("last_seen"))


def usage(representations: DataFrame) -> DataFrame:
    """(kind, term, n): how many representations use a term; objects count as object and as target."""
    slots = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("term")) for kind, c in (("actor", "actor"), ("activity", "activity"), ("object", "object"), ("object", "target"))))
    return representations.select("id", F.explode(slots).alias("x")).where("x.term is not null").groupBy(F.col("x.kind").alias("kind"), F.col("x.term").alias("term")).agg(F.count("*").alias("n"))


def slot_violations(representations: DataFrame) -> DataFrame:
    """Representations whose slots don't go with their pattern: an activity needs actor, activity and object; an object
    only an object; an unmapped one none."""
    has = {c: F.col(c).isNotNull() for c in ("actor", "activity", "object", "target")}
    right = (
        F.when(F.col("pattern") == "activity", has["actor"] & has["activity"] & has["object"])
        .when(F.col("pattern") == "object", has["object"] & ~has["actor"] & ~has["activity"] & ~has["target"])
        .when(F.col("pattern") == "unmapped", ~has["actor"] & ~has["activity"] & ~has["object"] & ~has["target"])
        .otherwise(False)
    )
    return representations.where(~right).select("id", "pattern")


def misplaced_metadata(links: DataFrame) -> DataFrame:
    """links (id, anchor, path, slot, filled) to locations that aren't below their anchor, or to slots that are empty."""
    return links.where(~(P.within(F.col("path"), F.col("anchor")) & (F.col("path") != F.col("anchor")) & F.col("filled"))).select("id")


def with_examples(examples: DataFrame, added: DataFrame) -> DataFrame:
    """(location, values) with trimmed new values appended once each, in order; blanks add nothing."""
    new = added.withColumn("value", F.trim("value")).where("value <> ''").groupBy("location").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("more"))
    empty = F.array().cast("array<string>")
    return examples.join(new, "location", "full").select("location", F.array_distinct(F.concat(F.coalesce("values", empty), F.coalesce("more", empty))).alias("values"))


#: What vocabularies hold at first, by slug: names and, for activities, what they were called before (fixed values).
ACTORS = {"user": "user", "platform": "platform", "other-user": "other user"}
ACTIVITIES = {"viewed": "view", "opened": "open", "listened": "listen", "created": "create", "followed": "follow", "blocked": "block", "joined": "join", "updated": "update", "asked": "question", "added": "add", "responded": None, "searched": None}
OBJECTS = ("note", "video", "audio", "image", "profile", "person", "collection", "event", "object")
ROLES = {"when": "when", "context": "context", "duration": "duration", "name": "name", "identifier": "identifier", "author": "author", "value": "value", "applies-to": "applies to"}


def seeded(terms: DataFrame) -> DataFrame:
    """(kind, slug, name) of terms with the first vocabulary: missing ones added, activities by their new names.

    terms: (kind, slug, name). A term under an activity's former slug is renamed, unless the new one is there too.
    """
    spark = terms.sparkSession
    seeds = [("actor", s, n) for s, n in ACTORS.items()] + [("activity", s, s) for s in ACTIVITIES] + [("object", s, s) for s in OBJECTS] + [("role", s, n) for s, n in ROLES.items()]
    former = F.broadcast(spark.createDataFrame([("activity", old, new) for new, old in ACTIVITIES.items() if old], "kind string, slug string, _new string"))
    there = terms.select("kind", F.col("slug").alias("_new"), F.lit(True).alias("_taken"))
    rows = terms.join(former, ["kind", "slug"], "left").join(there, ["kind", "_new"], "left")
    moved = F.col("_new").isNotNull() & F.col("_taken").isNull()
    kept = rows.select("kind", F.when(moved, F.col("_new")).otherwise(F.col("slug")).alias("slug"), F.when(moved, F.col("_new")).otherwise(F.col("name")).alias("name"))
    first = spark.createDataFrame(seeds, "kind string, slug string, name string")
    return kept.unionByName(first.join(kept, ["kind", "slug"], "left_anti"))


def set_examples(examples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(location, values) with (value, source) after an edit: extracted ones may only be removed, typed ones are replaced.

    examples: (location, values); wanted: (location, extracted, typed), arrays of texts. Typed ones are trimmed, blanks
    and what is there already left out.
    """
    shape = "array<struct<value: string, source: string>>"
    rows = examples.join(wanted, "location", "full")
    kept = F.filter(F.coalesce("values", F.array().cast(shape)), lambda e: (e.source == "extracted") & F.array_contains("extracted", e.value))
    new = F.array_distinct(F.filter(F.transform(F.coalesce("typed", F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))
    added = F.transform(F.filter(new, lambda v: ~F.exists(kept, lambda e: e.value == v)), lambda v: F.struct(v.alias("value"), F.lit("user_input").alias("source")))
    return rows.select("location", F.when(F.col("extracted").isNull() & F.col("typed").isNull(), F.col("values")).otherwise(F.concat(kept, added)).alias("values"))


def of_source(values: Column, source: str) -> Column:
    """The texts of the examples (value, source) that are of a source."""
    return F.transform(F.filter(values, lambda e: e.source == source), lambda e: e.value)


def preview(values: str, n: int) -> list:
    """(first n values, how many more) as columns."""
    return [F.slice(values, 1, n).alias("shown"), F.greatest(F.size(values) - n, F.lit(0)).alias("more")]
