"""Queries on names, annotations and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators import vocabulary as V
from pathloom.plans import base

ALL = f"WITH {base.OBSERVATIONS.strip()},{base.LOCATIONS}"


def representations(spark, sf):
    o = base.table(spark, sf, "orders")
    slot = lambda n, k: F.when(F.col("o_custkey") % n != 0, F.col("o_custkey") % k)
    pattern = F.when(F.col("o_orderkey") % 3 == 0, "activity").when(F.col("o_orderkey") % 3 == 1, "object").otherwise("unmapped")
    return o.select(F.col("o_orderkey").alias("id"), pattern.alias("pattern"), slot(2, 3).alias("actor"), slot(3, 10).alias("activity"), slot(7, 9).alias("object"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 4).alias("target"))


REPRESENTATIONS = "WITH rp AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'activity' WHEN 1 THEN 'object' ELSE 'unmapped' END AS pattern, CASE WHEN o_custkey % 2 <> 0 THEN o_custkey % 3 END AS actor, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 10 END AS activity, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 9 END AS object, CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 4 END AS target FROM orders)"


def detail(spark, sf):
    out = V.annotation_detail(base.locations(spark, sf), base.observations(spark, sf), base.uploads(spark, sf))
    return out.withColumns({"languages": F.array_join("languages", ","), "formats": F.array_join("formats", ","), "last_seen": F.col("last_seen").cast("string")})


def terms(spark, sf):
    return base.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 3 == 0).alias("approved"), (F.col("p_partkey") % 7).alias("created_by"))


QUERIES = {
    "annotation_list": lambda s, d: V.annotation_list(base.locations(s, d), base.observations(s, d), base.uploads(s, d)).withColumn("last_seen", F.col("last_seen").cast("string")),
    "annotation_detail": detail,
    "vocabulary_usage": lambda s, d: V.usage(representations(s, d)),
    "slot_violations": lambda s, d: V.slot_violations(representations(s, d)),
    "terms_for_user": lambda s, d: V.terms_for(terms(s, d), 3, 11).select("id", N.slug(F.col("name")).alias("slug")),
    "taken_terms": lambda s, d: V.taken_terms(terms(s, d).where("approved"), base.table(s, d, "part").select(F.upper("p_name").alias("name")).distinct()),
    "visible_uploads": lambda s, d: V.visible_to(base.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("owner")), "owner", 4),
    "appended_examples": lambda s, d: V.with_examples(base.table(s, d, "nation").select(F.col("n_nationkey").alias("location"), F.array("n_name").alias("values")), base.table(s, d, "customer").select(F.col("c_nationkey").alias("location"), F.col("c_custkey").alias("pos"), F.concat(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("value"))).select("location", F.array_join("values", ",").alias("values")),
    "misplaced_metadata": lambda s, d: V.misplaced_metadata(base.url_paths(s, d).select(F.col("page_id").alias("id"), F.lit("/ththre.example.com").alias("anchor"), "path", (F.col("page_id") % 2 == 0).alias("filled"))),
    "anonymous_names": lambda s, d: base.table(s, d, "pages").select("page_id", N.anonymous_file_name(F.concat(F.regexp_replace("url", "[?].*$", ""), F.lit("_my_Data.json")), ("my", "data", "json")).alias("name"), N.short_id(F.col("url")).alias("short")),
}
ORACLES = {
    "annotation_list": f"{ALL} SELECT l.platform, annotation, count(DISTINCT l.location) AS locations, CAST(max(requested_at) AS VARCHAR) AS last_seen FROM loc l LEFT JOIN obs USING (platform, location) WHERE annotation IS NOT NULL GROUP BY ALL",
    "annotation_detail": f"{ALL} SELECT o.platform, annotation, o.location, string_agg(DISTINCT coalesce(nullif(language, ''), 'unknown'), ',' ORDER BY coalesce(nullif(language, ''), 'unknown')) AS languages, string_agg(DISTINCT coalesce(nullif(request_format, ''), 'unknown'), ',' ORDER BY coalesce(nullif(request_format, ''), 'unknown')) AS formats, CAST(max(u.requested_at) AS VARCHAR) AS last_seen FROM obs o JOIN up u USING (platform, upload_id) JOIN loc l USING (platform, location) WHERE u.registered AND annotation IS NOT NULL GROUP BY ALL",
    "vocabulary_usage": f"{REPRESENTATIONS} SELECT kind, term, count(*) AS n FROM (SELECT 'actor' AS kind, actor AS term FROM rp UNION ALL SELECT 'activity', activity FROM rp UNION ALL SELECT 'object', object FROM rp UNION ALL SELECT 'object', target FROM rp) WHERE term IS NOT NULL GROUP BY ALL",
    "slot_violations": f"{REPRESENTATIONS} SELECT id, pattern FROM rp WHERE NOT CASE pattern WHEN 'activity' THEN actor IS NOT NULL AND activity IS NOT NULL AND object IS NOT NULL WHEN 'object' THEN object IS NOT NULL AND actor IS NULL AND activity IS NULL AND target IS NULL ELSE coalesce(actor, activity, object, target) IS NULL END",
    "terms_for_user": "SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') AS slug FROM part WHERE p_size % 3 = 0 OR p_partkey % 7 = 3 OR p_partkey = 11",
    "taken_terms": "SELECT DISTINCT upper(p_name) AS name FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size % 3 = 0)",
    "visible_uploads": "SELECT doc_id, doc_id % 6 AS owner FROM documents WHERE doc_id % 6 = 4",
    "appended_examples": "WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS v, min(c_custkey) AS first_at FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL) SELECT n_nationkey AS location, n_name || coalesce((SELECT ',' || string_agg(v, ',' ORDER BY first_at) FROM m WHERE k = n_nationkey), '') AS values FROM nation",
    "misplaced_metadata": f"WITH{base.URL_PATHS} SELECT page_id AS id FROM url WHERE NOT (starts_with(path, '/ththre.example.com/') AND page_id % 2 = 0)",
    "anonymous_names": "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?].*$', ''), '[^/]*$'), '\\pL', 'x', 'g'), '[0-9]', '0', 'g') || '_my_Data.json' AS name, left(sha1(url), 10) AS short FROM pages",
}
