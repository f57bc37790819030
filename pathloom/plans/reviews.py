"""Queries on reviews: what is untriaged, shown, waiting, stale or moved, and which steps are allowed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import merge, review, timeline
from pathloom.plans import base
from pathloom.plans.uploads_over_time import ALL, BOTH, NEW, PROPOSALS, held, proposals


def points(s, d):
    return base.observations(s, d).join(base.locations(s, d), ["platform", "location"])


def judged(s, d):
    """Documents as uploads in every state."""
    h = held(s, d)
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("arrived") % len(v) + 1).cast("int"))
    told = h.withColumn("status", pick("done", "failed", "parsing", "done")).withColumn("plausibility", pick("passed", "awaiting", "unconfirmed", "approved", "rejected")).withColumn("counts", F.col("arrived") % 3 == 0)
    return told.withColumns({"uploaded_by": F.when(F.col("arrived") % 6 != 0, F.col("arrived") % 6), "has_document": F.col("status") == "done", "registered": F.col("plausibility").isin(*review.COUNTED)})


JUDGED = """h AS (SELECT lang AS platform, CAST(doc_id AS VARCHAR) AS upload_id, doc_id AS arrived, CASE WHEN n_chars % 2 = 0 THEN 'zip' ELSE 'json' END AS root_format,
  ['done', 'failed', 'parsing', 'done'][doc_id % 4 + 1] AS status, ['passed', 'awaiting', 'unconfirmed', 'approved', 'rejected'][doc_id % 5 + 1] AS plausibility, doc_id % 3 = 0 AS counts, nullif(doc_id % 6, 0) AS uploaded_by FROM documents)"""


def based(s, d):
    return proposals(s, d).withColumn("base", F.when(F.col("proposal_id") % 3 != 0, F.col("value")))


def asked(s, d):
    h = base.table(s, d, "documents")
    actions = F.array(*map(F.lit, review.STEPS))
    return h.select(F.col("doc_id").cast("string").alias("upload_id"), F.element_at(actions, (F.length("text") % 4 + 1).cast("int")).alias("action"), (F.length("text") % 7).cast("long").alias("user"), (F.col("doc_id") % 2 == 0).alias("staff"))


def placed(s, d):
    return base.all_paths(s, d).withColumn("parent_path", F.regexp_replace("path", "/[^/]*$", "")).withColumn("type", F.concat(F.lit("t"), (F.length("path") % 5).cast("string")))


def item_rows(s, d):
    """Page paths whose last segments of two letters are list items."""
    p = placed(s, d)
    return p.withColumn("path", F.regexp_replace("path", "/[a-z]{2}$", "/[]")).dropDuplicates(["platform", "path"]).withColumn("type", F.concat(F.lit("t"), (F.length("path") % 5).cast("string")))


def sample_lists(s, d):
    """Lists of one to five priorities: of each seventh of the customers as many as its number says."""
    o = base.table(s, d, "orders").select(F.col("o_orderstatus").alias("path"), (F.col("o_custkey") % 7).alias("part"), "o_orderpriority").distinct()
    every = o.groupBy("path", "part").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("samples"))
    return every.withColumn("samples", F.slice("samples", 1, (1 + F.col("part") * 3 % 5).cast("int")))


def several_references(s, d):
    l_ = base.table(s, d, "lineitem")
    found = l_.select((F.col("l_partkey") % 4).alias("reference"), (F.col("l_suppkey") % 200).cast("string").alias("path"), (F.col("l_linenumber")).cast("string").alias("known_path"), F.round(F.col("l_discount"), 2).alias("score"))
    known = base.table(s, d, "supplier").select((F.col("s_nationkey") % 4).alias("reference"), (F.col("s_suppkey") % 200).cast("string").alias("path")).where(F.col("reference") == 0)
    return review.best_suggestions(found, known)


QUERIES = {
    "untriaged_points": lambda s, d: review.untriaged(points(s, d)),
    "items_without_representation": lambda s, d: review.without_representation(base.locations(s, d), base.locations(s, d).where(F.col("location") % 2 == 0)),
    "review_row_counts": lambda s, d: review.row_counts(points(s, d)),
    "platform_detail": lambda s, d: review.platform_counts(base.locations(s, d), base.observations(s, d), base.uploads(s, d)),
    "shown_missing_annotations": lambda s, d: review.shown(base.all_paths(s, d), F.length("path") % 5 == 0),
    "children_and_items": lambda s, d: review.children_of(item_rows(s, d)),
    "filter_defaults": lambda s, d: review.filter_defaults(base.uploads(s, d)),
    "upload_states": lambda s, d: review.states(judged(s, d)),
    "upload_steps": lambda s, d: review.stepped(judged(s, d), asked(s, d)),
    "stale_proposals": lambda s, d: review.stale(based(s, d)),
    "waiting_counts": lambda s, d: review.waiting(proposals(s, d).withColumn("platform", F.expr("element_at(array('en', 'fr', 'xx'), cast(proposal_id % 3 + 1 as int))")), judged(s, d)),
    "open_proposals_of_targets": lambda s, d: review.open_for(proposals(s, d), proposals(s, d).where("target % 3 = 0").select("target", F.expr("CASE WHEN target % 2 = 0 THEN 'name' END").alias("kind"))),
    "proposal_groups": lambda s, d: review.grouped_queue(proposals(s, d), base.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("target"), F.col("n_name").alias("name"))),
    "plausibility_peers": lambda s, d: review.peers(judged(s, d)),
    "best_suggestions": several_references,
    "merged_samples": lambda s, d: review.merged_samples(sample_lists(s, d)).select("path", F.array_join("samples", ";").alias("samples")),
    "triage_items": lambda s, d: review.triage(points(s, d), timeline.scopes(base.observations(s, d), base.uploads(s, d)), points(s, d).where(F.col("location") % 7 == 0).select("platform", "upload_id", "location", F.explode(F.expr("array(struct('renamed' AS reason, 1 AS rank), struct('moved' AS reason, cast(location % 2 * 2 as int) AS rank))")).alias("x")).select("platform", "upload_id", "location", "x.*")),
    "children_order": lambda s, d: review.children_order(placed(s, d).withColumn("name", F.reverse("path")).withColumn("in_folder", F.length("parent_path") % 2 == 0).withColumn("position", F.length("path") % 3)),
    "inspectable_uploads": lambda s, d: review.inspectable(judged(s, d), asked(s, d)),
    "merged_file_fields": lambda s, d: merge.merged_files(base.table(s, d, "part").select(F.col("p_brand").alias("path"), F.lit("file").alias("kind"), F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("long").alias("size_bytes"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("ext"), F.lit(None).cast("string").alias("mime"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")).alias("files"))),
}
PATHS = f"WITH{base.URL_PATHS}, ap AS (SELECT DISTINCT platform, {base.PREFIXES.format(p='path')} AS path FROM url)"
#: The steps in SQL: what each needs, who may take it, and where it leads.
STEPPED = """CASE WHEN action = 'confirm' THEN plausibility = 'unconfirmed' AND "user" = uploaded_by WHEN action = 'discard' THEN plausibility = 'unconfirmed' AND "user" = uploaded_by
  WHEN action IN ('approve', 'reject') THEN plausibility = 'awaiting' AND staff ELSE FALSE END"""
ASKED = "s AS (SELECT CAST(doc_id AS VARCHAR) AS upload_id, ['confirm', 'discard', 'approve', 'reject'][length(text) % 4 + 1] AS action, length(text) % 7 AS \"user\", doc_id % 2 = 0 AS staff FROM documents)"
ORACLES = {
    "untriaged_points": f"{ALL} SELECT o.platform, o.upload_id, o.location FROM obs o JOIN loc USING (platform, location) WHERE is_data_point AND annotation IS NULL AND NOT ignored",
    "items_without_representation": f"{ALL} SELECT platform, location FROM loc WHERE path LIKE '%/[]' AND location % 2 <> 0",
    "review_row_counts": f"{ALL} SELECT o.platform, o.upload_id, count(DISTINCT regexp_replace(path, '(/\\[\\])+$', '')) AS n_rows FROM obs o JOIN loc USING (platform, location) GROUP BY ALL",
    "platform_detail": f"{ALL}, seen AS (SELECT DISTINCT o.platform, o.location, annotation, ignored FROM obs o JOIN loc USING (platform, location) WHERE registered AND is_data_point) SELECT u.platform, (SELECT count(DISTINCT annotation) FROM loc l WHERE l.platform = u.platform) AS annotations, (SELECT count(*) FROM seen s WHERE s.platform = u.platform) AS data_points, (SELECT count(*) FROM seen s WHERE s.platform = u.platform AND annotation IS NULL AND NOT ignored) AS untriaged, count(*) FILTER (WHERE registered) AS uploads FROM up u GROUP BY u.platform",
    "shown_missing_annotations": f"{PATHS} SELECT * FROM ap a WHERE EXISTS (SELECT 1 FROM ap b WHERE b.platform = a.platform AND length(b.path) % 5 = 0 AND (b.path = a.path OR starts_with(b.path, a.path || '/')))",
    "children_and_items": f"{PATHS}, it AS (SELECT DISTINCT platform, regexp_replace(path, '/[a-z]{{2}}$', '/[]') AS path, regexp_replace(path, '/[^/]*$', '') AS parent_path FROM ap), ty AS (SELECT *, 't' || (length(path) % 5) AS type FROM it) SELECT platform, path, EXISTS (SELECT 1 FROM ty b WHERE b.platform = a.platform AND b.parent_path = a.path AND b.path <> '') AS has_children, coalesce((SELECT max(type) FROM ty b WHERE b.platform = a.platform AND b.parent_path = a.path AND b.path LIKE '%/[]'), '') AS item_type FROM ty a",
    "filter_defaults": f"{BOTH}, n AS (SELECT *, coalesce(nullif(request_format, ''), 'unknown') AS rf FROM up WHERE registered), a AS (SELECT platform, rf FROM (SELECT platform, rf, count(*) AS n FROM n GROUP BY platform, rf) QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, rf) = 1) SELECT platform, rf AS request_format, root_format FROM (SELECT platform, rf, root_format, count(*) AS n FROM n JOIN a USING (platform, rf) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, root_format) = 1",
    "upload_states": f"WITH {JUDGED} SELECT platform, upload_id, plausibility IN ('passed', 'approved') AS counts, status IN ('done', 'failed') AS finished, status = 'done' AND plausibility NOT IN ('passed', 'approved') AS can_inspect, plausibility = 'awaiting' AS can_approve FROM h",
    "upload_steps": f"WITH {JUDGED}, {ASKED}, t AS (SELECT *, coalesce({STEPPED}, FALSE) AS ok FROM s JOIN h USING (upload_id)) SELECT upload_id, action, CASE WHEN NOT ok THEN plausibility WHEN action = 'confirm' THEN 'awaiting' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' END AS plausibility, ok AS allowed FROM t",
    "inspectable_uploads": f"WITH {JUDGED}, {ASKED} SELECT upload_id, \"user\" FROM s JOIN h USING (upload_id) WHERE status = 'done' AND plausibility NOT IN ('passed', 'approved') AND (staff OR \"user\" = uploaded_by)",
    "stale_proposals": f"{PROPOSALS}, b AS (SELECT *, CASE WHEN proposal_id % 3 <> 0 THEN value END AS base FROM pr), n AS (SELECT target, kind, arg_max(value, (decided_at, proposal_id)) AS now FROM pr WHERE status = 'accepted' GROUP BY ALL) SELECT proposal_id, target, kind FROM b LEFT JOIN n USING (target, kind) WHERE status = 'open' AND base IS DISTINCT FROM now",
    "waiting_counts": f"{PROPOSALS}, {JUDGED}, a AS (SELECT ['en', 'fr', 'xx'][proposal_id % 3 + 1] AS platform, count(*) AS proposals FROM pr WHERE status = 'open' GROUP BY ALL), b AS (SELECT platform, count(*) AS approvals FROM h WHERE plausibility = 'awaiting' GROUP BY ALL) SELECT platform, coalesce(proposals, 0) AS proposals, coalesce(approvals, 0) AS approvals FROM a FULL JOIN b USING (platform)",
    "open_proposals_of_targets": f"{PROPOSALS} SELECT proposal_id, target, kind FROM pr WHERE status = 'open' AND CAST(target AS INT) % 3 = 0 AND (CAST(target AS INT) % 2 <> 0 OR kind = 'name')",
    "proposal_groups": f"{PROPOSALS} SELECT lower(coalesce(n_name, target)) AS \"group\", count(*) AS n FROM pr LEFT JOIN nation ON target = CAST(n_nationkey AS VARCHAR) WHERE status = 'open' GROUP BY ALL",
    "plausibility_peers": f"WITH {JUDGED} SELECT platform, upload_id, coalesce(sum(CAST(counts AS INT)) OVER (PARTITION BY platform, root_format ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS peers FROM h",
    "best_suggestions": "WITH k AS (SELECT DISTINCT CAST(s_suppkey % 200 AS VARCHAR) AS path FROM supplier WHERE s_nationkey % 4 = 0) SELECT CAST(l_suppkey % 200 AS VARCHAR) AS path, CAST(l_linenumber AS VARCHAR) AS known_path, max(round(l_discount, 2)) AS score FROM lineitem WHERE CAST(l_suppkey % 200 AS VARCHAR) NOT IN (SELECT path FROM k) GROUP BY ALL",
    "merged_samples": "WITH o AS (SELECT DISTINCT o_orderstatus AS path, o_custkey % 7 AS part, o_orderpriority AS p FROM orders), a AS (SELECT path, part, list_sort(list(p)) AS v FROM o GROUP BY ALL), l AS (SELECT path, part, v[1:1 + part * 3 % 5] AS v FROM a) SELECT path, array_to_string(list_reduce(list(v ORDER BY part), lambda a, b: (a || list_filter(b, lambda x: NOT list_contains(a, x)))[1:greatest(len(a), len(b))]), ';') AS samples FROM l GROUP BY path",
    "triage_items": f"{ALL}{NEW} SELECT o.platform, o.upload_id, o.location, CASE WHEN o.location % 7 = 0 THEN CASE WHEN o.location % 2 = 0 THEN 'moved' ELSE 'renamed' END WHEN n.location IS NOT NULL THEN 'new' ELSE 'seen' END AS status FROM obs o JOIN loc USING (platform, location) LEFT JOIN nw n ON n.platform = o.platform AND n.upload_id = o.upload_id AND n.location = o.location WHERE is_data_point AND annotation IS NULL AND NOT ignored",
    "children_order": f"{PATHS}, p AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS up FROM ap) SELECT platform, path, row_number() OVER (PARTITION BY platform, up ORDER BY CASE WHEN length(up) % 2 = 0 THEN reverse(path) ELSE '' END, length(path) % 3, path) - 1 AS place FROM p",
    "merged_file_fields": "SELECT p_brand AS path, 'file' AS kind, sum(p_size)::BIGINT AS size_bytes, arg_min(p_type, p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS ext, CAST(NULL AS VARCHAR) AS mime, CASE WHEN count(*) FILTER (WHERE p_partkey % 2 = 0) > 0 THEN sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END)::BIGINT END AS files FROM part GROUP BY p_brand",
}
