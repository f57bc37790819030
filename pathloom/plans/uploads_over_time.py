"""Queries on uploads and observations: what is new, changed, missing or known, and the state of curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import curation, timeline, views
from pathloom.plans import base

BOTH = f"WITH {base.OBSERVATIONS.strip()}"
ALL = f"{BOTH},{base.LOCATIONS}"
NOISE = {"type": "array_to_string(list_sort(list_filter(string_split(type, '|'), lambda t: t <> '' AND t <> 'null')), '|')", "shape": "CASE WHEN shape IN ('mixed', 'empty') THEN '' ELSE shape END"}
LONG = ", vals AS (" + " UNION ALL ".join(f"SELECT platform, upload_id, requested_at, registered, location, '{f}' AS field, {NOISE.get(f, f)} AS value FROM obs" for f in timeline.FIELDS) + ")"
CHANGED = f"""{LONG}, fst AS (SELECT platform, location, field, value, min(requested_at) AS first_at FROM vals WHERE registered GROUP BY ALL),
hist AS (SELECT v.platform, v.upload_id, v.location, v.field, v.value AS now, list_sort(list(f.value)) AS earlier FROM vals v JOIN fst f
  ON v.platform = f.platform AND v.location = f.location AND v.field = f.field AND f.first_at < v.requested_at WHERE v.value <> '' GROUP BY ALL),
chg AS (SELECT platform, upload_id, location, field, now, list_filter(earlier, lambda x: x <> '') AS before FROM hist WHERE NOT list_contains(earlier, now))"""
NEW = ", fs AS (SELECT platform, location, min(requested_at) AS first_at FROM obs WHERE registered GROUP BY ALL), nw AS (SELECT platform, upload_id, location FROM obs LEFT JOIN fs USING (platform, location) WHERE first_at IS NULL OR first_at >= requested_at)"


def both(run):
    return lambda spark, sf: run(base.observations(spark, sf), base.uploads(spark, sf))


def texts(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def changed(o, u):
    return timeline.changes(o, u).withColumn("before", F.array_join("before", ";"))


def proposals(spark, sf):
    """Turns of conversations as proposals: a target per conversation, users propose and others decide."""
    c = base.table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("proposal_id"),
        (F.col("conv_id") % 40).cast("string").alias("target"),
        F.when(F.col("turn") % 2 == 0, "name").otherwise("ignore").alias("kind"),
        F.when(F.length("text") % 3 == 0, "open").when(F.length("text") % 3 == 1, "accepted").otherwise("rejected").alias("status"),
        F.col("text").alias("value"),
        (F.col("conv_id") % 5).alias("proposed_by"),
        (F.col("conv_id") * 10 + F.col("turn")).alias("created_at"),
        (F.col("conv_id") * 10 + F.col("turn") + F.length("text") % 50).alias("decided_at"),
        F.col("role").alias("platform"),
    )


PROPOSALS = """WITH pr AS (SELECT conv_id * 100 + turn AS proposal_id, CAST(conv_id % 40 AS VARCHAR) AS target, CASE WHEN turn % 2 = 0 THEN 'name' ELSE 'ignore' END AS kind,
  CASE length(text) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status, text AS value, conv_id % 5 AS proposed_by,
  conv_id * 10 + turn AS created_at, conv_id * 10 + turn + length(text) % 50 AS decided_at, role AS platform FROM conversations)"""


def held(spark, sf):
    """Documents as uploads: a platform per language, a format by source, in order of id."""
    d = base.table(spark, sf, "documents")
    return d.select(F.col("lang").alias("platform"), F.col("doc_id").cast("string").alias("upload_id"), F.col("doc_id").alias("arrived"), F.when(F.col("n_chars") % 2 == 0, "zip").otherwise("json").alias("root_format"), F.sha2("text", 256).alias("sha256"), ((F.col("n_chars") % 10) / 10).alias("similarity"), (F.col("doc_id") % 3 == 0).alias("approved"))


def labels(spark, sf):
    p = timeline.profiles(base.observations(spark, sf), base.uploads(spark, sf))
    label = views.plain_label(F.col("main_kind"), F.col("main_type"), F.concat(F.lit("/x"), F.when(F.col("location") % 2 == 0, "/[]").otherwise("")), F.when(F.col("location") % 3 == 0, "string").otherwise(""), F.lit(False), F.col("uploads") <= 1)
    return p.select("platform", "location", label.alias("label"), views.type_badge(F.col("main_type"), F.col("main_shape")).alias("badge"))


MODES = ", cnt AS (SELECT platform, location, field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT platform, location, '{f}' AS field, {f} AS value FROM obs WHERE registered" for f in timeline.FIELDS) + """) WHERE field = 'kind' OR value <> '' GROUP BY ALL),
md AS (SELECT platform, location, field, arg_min(value, (-n, value)) AS main, count(*) AS kinds FROM cnt GROUP BY ALL),
pf AS (SELECT platform, location, count(DISTINCT upload_id) AS uploads, min(requested_at) AS first_seen, max(requested_at) AS last_seen, bool_or(is_data_point) AS is_data_point FROM obs WHERE registered GROUP BY ALL),
prof AS (SELECT pf.*, """ + ", ".join(f"coalesce(max(CASE WHEN field = '{f}' THEN main END), '') AS main_{f}" for f in timeline.FIELDS) + """, coalesce(sum(CASE WHEN field <> 'kind' THEN kinds - 1 END), 0)::BIGINT AS variants
  FROM pf JOIN md USING (platform, location) GROUP BY ALL)"""

QUERIES = {
    "new_in_upload": both(timeline.new_in),
    "changed_fields": both(changed),
    "changed_names": both(lambda o, u: timeline.changed_names(timeline.changes(o, u)).withColumn("fields", F.array_join("fields", ","))),
    "review_scopes": both(timeline.scopes),
    "missing_locations": lambda s, d: timeline.missing(base.locations(s, d), base.observations(s, d), base.uploads(s, d)),
    "latest_observation": both(lambda o, u: texts(timeline.latest(o, u), "requested_at")),
    "location_history": both(lambda o, u: timeline.history(o, u).select("platform", "location", "upload_id", "seq")),
    "field_counts": both(lambda o, u: timeline.field_counts(timeline.dated(o, u).where("registered"))),
    "location_profile": both(lambda o, u: texts(timeline.profiles(o, u), "first_seen", "last_seen")),
    "platform_overview": lambda s, d: texts(timeline.overview(base.locations(s, d), base.observations(s, d), base.uploads(s, d)), "last_registered"),
    "request_format_ranking": lambda s, d: timeline.format_ranking(base.uploads(s, d), "request_format"),
    "root_format_ranking": lambda s, d: timeline.format_ranking(base.uploads(s, d), "root_format"),
    "filtered_observations": lambda s, d: timeline.filtered_observations(base.observations(s, d), timeline.filtered_uploads(base.uploads(s, d), "2024-01-05", "2024-01-25", ["en", ""], "unknown")).select("platform", "upload_id", "location"),
    "newest_uploads": lambda s, d: base.uploads(s, d).orderBy(F.desc("requested_at"), "platform").limit(20).select("platform", "upload_id"),
    "review_progress": lambda s, d: curation.progress(base.observations(s, d).where("is_data_point").join(base.locations(s, d), ["platform", "location"])),
    "representable_items": lambda s, d: curation.can_represent(base.observations(s, d).withColumn("type", F.when(F.col("location") % 2 == 0, "null|object").otherwise(F.col("type"))), base.locations(s, d)),
    "metadata_candidates": lambda s, d: curation.metadata_candidates(base.locations(s, d).select("platform", F.col("parent_path").alias("path")).distinct(), base.locations(s, d), base.observations(s, d)),
    "duplicates_by_hash": lambda s, d: curation.duplicates(held(s, d)),
    "plausibility_decisions": lambda s, d: curation.decided(held(s, d)),
    "proposal_state": lambda s, d: curation.current_state(proposals(s, d)),
    "proposals_superseded": lambda s, d: curation.superseded(proposals(s, d)),
    "proposals_withdrawn": lambda s, d: curation.withdrawn(proposals(s, d)).select("proposal_id", "target", "kind"),
    "proposal_queue": lambda s, d: curation.queue_counts(proposals(s, d)),
    "unique_annotation_names": lambda s, d: curation.unique_names(base.table(s, d, "part").select(F.col("p_brand").alias("platform"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))),
    "plain_labels": labels,
    "tree_rows": lambda s, d: views.tree_rows(base.locations(s, d).withColumn("open", F.col("annotation").isNull() & ~F.col("ignored"))),
    "tree_groups": lambda s, d: views.group_totals(views.tree_rows(base.locations(s, d).withColumn("open", F.col("annotation").isNull() & ~F.col("ignored")))),
}
TREE = """, tr AS (SELECT platform, regexp_replace(path, '(/\\[\\])+$', '') AS "row", count(*) AS members,
  max(CASE WHEN regexp_matches(path, '/\\[\\]/') THEN regexp_replace(regexp_extract(path, '^(.*)/\\[\\]/', 1), '(/\\[\\])+$', '') END) AS list, count(*) FILTER (WHERE annotation IS NULL AND NOT ignored) AS open FROM loc GROUP BY ALL),
trs AS (SELECT platform, "row", members, list, regexp_replace("row", '/[^/]*$', '') AS group_path, len(list_filter(string_split("row", '/'), lambda s: s = '[]')) AS depth, open FROM tr)"""
ORACLES = {
    "new_in_upload": f"{BOTH}{NEW} SELECT * FROM nw",
    "changed_fields": f"{BOTH}{CHANGED} SELECT platform, upload_id, location, field, now, array_to_string(before, ';') AS before FROM chg",
    "changed_names": f"{BOTH}{CHANGED} SELECT platform, upload_id, location, string_agg(field, ',' ORDER BY list_position(['kind', 'type', 'shape', 'format'], field)) AS fields FROM chg GROUP BY ALL",
    "review_scopes": f"{BOTH}{CHANGED}{NEW} SELECT o.platform, o.upload_id, o.location, CASE WHEN n.location IS NOT NULL THEN 'new' ELSE 'known' END AS scope FROM obs o LEFT JOIN nw n USING (platform, upload_id, location) LEFT JOIN (SELECT DISTINCT platform, upload_id, location, 1 AS c FROM chg) USING (platform, upload_id, location) WHERE is_data_point AND (n.location IS NOT NULL OR c IS NULL)",
    "missing_locations": f"""{ALL}, pres AS (SELECT DISTINCT o.platform, o.upload_id, annotation, path FROM obs o JOIN loc USING (platform, location))
SELECT u.platform, u.upload_id, l.location FROM up u JOIN loc l USING (platform) WHERE l.annotation IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM pres p WHERE p.platform = u.platform AND p.upload_id = u.upload_id AND p.annotation = l.annotation)
AND NOT (l.path LIKE '%/[]' AND EXISTS (SELECT 1 FROM pres p WHERE p.platform = u.platform AND p.upload_id = u.upload_id AND p.path = l.parent_path))""",
    "latest_observation": f"{BOTH} SELECT platform, location, upload_id, kind, type, shape, format, is_data_point, CAST(requested_at AS VARCHAR) AS requested_at, registered FROM obs WHERE registered QUALIFY row_number() OVER (PARTITION BY platform, location ORDER BY requested_at DESC, upload_id DESC) = 1",
    "location_history": f"{BOTH} SELECT platform, location, upload_id, row_number() OVER (PARTITION BY platform, location ORDER BY requested_at, upload_id) AS seq FROM obs WHERE registered",
    "field_counts": f"{BOTH}{MODES} SELECT * FROM cnt",
    "location_profile": f"{BOTH}{MODES} SELECT * REPLACE (CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen), CASE WHEN main_shape IN ('plain', 'text') THEN '' ELSE main_shape END AS shape_hint, main_kind = 'data' AND main_type IN ('array', 'array|null') AS is_list FROM prof",
    "platform_overview": f"{ALL} SELECT u.platform, (SELECT count(DISTINCT annotation) FROM loc l WHERE l.platform = u.platform) AS annotations, count(*) FILTER (WHERE registered) AS uploads, (SELECT count(DISTINCT location) FROM obs o WHERE o.platform = u.platform AND registered AND is_data_point) AS data_points, CAST(max(requested_at) FILTER (WHERE registered) AS VARCHAR) AS last_registered FROM up u GROUP BY u.platform",
    "filtered_observations": f"{BOTH} SELECT o.platform, o.upload_id, o.location FROM obs o JOIN up u USING (platform, upload_id) WHERE u.registered AND u.requested_at BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND language IN ('en', '') AND request_format = ''",
    "newest_uploads": f"{BOTH} SELECT platform, upload_id FROM up ORDER BY requested_at DESC, platform LIMIT 20",
    "review_progress": f"{ALL} SELECT platform, upload_id, count(*) FILTER (WHERE annotation IS NOT NULL OR ignored) AS decided, count(*) AS total, round_even(count(*) FILTER (WHERE annotation IS NOT NULL OR ignored) * 100 / count(*), 0)::BIGINT AS percent FROM obs JOIN loc USING (platform, location) WHERE is_data_point GROUP BY ALL",
    "representable_items": f"{ALL}, ty AS (SELECT platform, location, CASE WHEN location % 2 = 0 THEN 'null|object' ELSE type END AS type, count(*) AS n FROM obs JOIN loc USING (platform, location) WHERE path LIKE '%/[]' GROUP BY ALL) SELECT platform, location FROM ty GROUP BY ALL HAVING arg_min(type, (-n, type)) IN ('object', 'null|object')",
    "metadata_candidates": f"{ALL} SELECT DISTINCT l.platform, a.anchor, l.path FROM loc l JOIN (SELECT DISTINCT platform, parent_path AS anchor FROM loc) a ON l.platform = a.platform AND starts_with(l.path, a.anchor || '/') WHERE NOT ignored AND EXISTS (SELECT 1 FROM obs o WHERE o.platform = l.platform AND o.location = l.location AND is_data_point)",
    "duplicates_by_hash": "SELECT lang AS platform, CAST(doc_id AS VARCHAR) AS upload_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY lang, text) - 1 AS copies FROM documents QUALIFY copies > 0",
    "proposal_state": f"{PROPOSALS} SELECT target, kind, arg_max(value, (decided_at, proposal_id)) AS value, max(decided_at) AS decided_at, count(*) AS accepted FROM pr WHERE status = 'accepted' GROUP BY ALL",
    "proposals_superseded": f"{PROPOSALS} SELECT proposal_id, target, kind FROM pr p WHERE status = 'open' AND created_at < (SELECT max(decided_at) FROM pr q WHERE q.status = 'accepted' AND q.target = p.target AND q.kind = p.kind)",
    "proposals_withdrawn": f"{PROPOSALS} SELECT proposal_id, target, kind FROM pr WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY target, kind, proposed_by ORDER BY created_at DESC, proposal_id DESC) > 1",
    "proposal_queue": f"{PROPOSALS} SELECT platform, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, platform) AS rank FROM pr WHERE status = 'open' GROUP BY platform",
    "unique_annotation_names": "SELECT p_brand AS platform, p_partkey AS id, p_name || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS name FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey)",
    "plain_labels": f"""{BOTH}{MODES} SELECT platform, location, CASE main_type WHEN 'null|number' THEN 'number (or empty)' WHEN 'array' THEN CASE WHEN location % 3 = 0 THEN 'list of texts' WHEN uploads <= 1 THEN 'empty list' ELSE 'list (always empty so far)' END ELSE main_type END AS label,
  CASE WHEN main_type = 'array' THEN 'array' WHEN main_shape = 'numeric' THEN 'numeric' ELSE replace(main_type, 'null|', '') END || CASE WHEN main_type LIKE 'null%' THEN '?' ELSE '' END AS badge FROM prof""",
    "tree_rows": f"{ALL}{TREE} SELECT * FROM trs",
    "tree_groups": f"{ALL}{TREE}, gr AS (SELECT platform, group_path, count(*) AS n_rows, sum(open)::BIGINT AS open FROM trs GROUP BY ALL) SELECT *, open > 0 AND row_number() OVER (PARTITION BY platform ORDER BY open = 0, group_path) = 1 AS is_first FROM gr",
}
for _f in ("request_format", "root_format"):
    ORACLES[f"{_f}_ranking"] = f"{BOTH} SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, format) AS rank FROM (SELECT platform, coalesce(nullif({_f}, ''), 'unknown') AS format, count(*) AS n FROM up WHERE registered GROUP BY ALL)"
