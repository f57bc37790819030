"""Queries on whole schemas: profiles, merging, comparison, suggestions and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.operators import compare, merge, normalize, profile
from pathloom.plans import base
from pathloom.sources.shred import shred


def events_json(spark, sf):
    """Events as JSON texts, each event one of the items of its event type's document."""
    e = base.table(spark, sf, "events")
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id": '), F.col("user_id").cast("string"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    return e.select(F.col("event_type").alias("doc_id"), F.lit("event.json").alias("name"), line.alias("text"))


def labelled(nodes):
    keep = ["doc_id", "path", "n_present", "n_null", "n_count", "length_min", "length_max"]
    return nodes.select(*[c for c in keep if c in nodes.columns], F.array_join("type", "|").alias("type"), "shape")


def events_profile(spark, sf):
    found = profile.nodes(shred(events_json(spark, sf), "/[]"), with_dates=True)
    return labelled(found.where("path <> ''")).drop("length_min", "length_max")


def documents_nodes(spark, sf, dates=False):
    return profile.nodes(base.document_values(spark, sf), with_dates=dates)


def merged(spark, sf):
    out = merge.merged(documents_nodes(spark, sf))
    return out.select("path", "documents", F.array_join("type", "|").alias("type"), "n_present", "n_null", "n_count", "length_min", "length_max", "shape")


def page_schemas(spark, sf, odd):
    """Nodes of page paths: a pair of schemas per thousand pages, of which one side has fewer and renamed paths."""
    p = base.url_paths(spark, sf).where(F.col("page_id") % 2 == int(odd)).withColumn("pair", F.expr("string(page_id % 4 div 2 + page_id div 400 * 2)"))
    path = F.regexp_replace("path", r"^/([^.]{2})[^/]*", "/$1")
    rows = p.select("pair", F.explode(P.ancestors(path)).alias("path")).distinct()
    if odd:
        rows = rows.select("pair", F.regexp_replace("path", "/fr(/|$)", "/fra$1").alias("path"))
    parents = rows.select("pair", P.parent(F.col("path")).alias("path")).distinct().withColumn("inner", F.lit(True))
    rows = rows.join(parents, ["pair", "path"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return rows.select("pair", "path", F.lit("data").alias("kind"), P.last(F.col("path")).alias("name"), F.array(F.when(F.col("inner"), "object").otherwise("integer")).alias("type"), F.when(~F.col("inner"), "plain").alias("shape"), F.lit(None).cast("string").alias("format"), F.lit(0).alias("position"))


def both_sides(run):
    return lambda s, d: run(page_schemas(s, d, False), page_schemas(s, d, True))


def comparison(before, after):
    return compare.compare(before, after).withColumn("fields", F.array_join("fields", ","))


def statuses(before, after):
    paths = before.select("pair", "path").union(after.select("pair", "path")).distinct()
    return compare.status_of(paths, compare.compare(before, after))


def signatures(spark, sf):
    o = base.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("g"), "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("signature"))


def key_nodes(spark, sf):
    """Objects keyed by customer names and by page words: a document per nation."""
    c = base.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), "c_custkey", "c_name", "c_mktsegment")
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Chat with "), F.col("c_name"))).otherwise(F.col("c_custkey").cast("string"))
    rows = c.select("doc_id", F.explode(F.array(F.concat(F.lit("/chats/"), key), F.concat(F.lit("/chats/"), key, F.lit("/text")), F.concat(F.lit("/chats/"), key, F.lit("/at")))).alias("path")).distinct()
    top = c.select("doc_id", F.lit("/chats").alias("path")).distinct()
    return rows.union(top).select("doc_id", "path", P.last(F.col("path")).alias("name"), F.lit("data").alias("kind"), F.lit(0).alias("position"))


def jaccard(spark, sf):
    """Share of users that each two event types have in common, over pairs of platforms and not of users."""
    users = base.table(spark, sf, "events").select("event_type", "user_id").distinct()
    sizes = users.groupBy("event_type").agg(F.count("*").alias("n"))
    other = users.select(F.col("event_type").alias("other"), "user_id")
    common = users.join(other, "user_id").where("event_type < other").groupBy("event_type", "other").agg(F.count("*").alias("common"))
    rows = common.join(sizes, "event_type").join(sizes.select(F.col("event_type").alias("other"), F.col("n").alias("m")), "other")
    return rows.select("event_type", "other", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("share"))


QUERIES = {
    "events_profile": events_profile,
    "documents_profile": lambda s, d: labelled(documents_nodes(s, d)),
    "documents_profile_dates": lambda s, d: labelled(documents_nodes(s, d, dates=True)),
    "merge_presence": lambda s, d: merge.presence(documents_nodes(s, d)),
    "merged_schema": merged,
    "compared_schemas": both_sides(comparison),
    "path_statuses": both_sides(statuses),
    "moved_subtrees": both_sides(compare.moves),
    "suggested_matches": both_sides(compare.suggestions),
    "inspected_upload": both_sides(compare.inspect),
    "upload_similarity": both_sides(lambda a, b: compare.share(compare.inspect(a, b))),
    "look_alike_groups": lambda s, d: normalize.alike(signatures(s, d), ["g"], "o_orderstatus", 0.8),
    "normalized_keys": lambda s, d: normalize.renames(key_nodes(s, d), ["/chats/Chat with *"]),
    "normalized_keys_by_shape": lambda s, d: normalize.renames(key_nodes(s, d)),
    "shared_users": jaccard,
    "data_points": lambda s, d: base.all_paths(s, d).select("platform", "path", profile.is_data_point(F.when(F.length("path") % 4 == 0, "file").when(F.length("path") % 4 == 1, "media").otherwise("data"), F.col("path"), F.when(F.length("path") % 3 == 0, F.array(F.lit("null"), F.lit("object"))).otherwise(F.array(F.lit("array")))).alias("point")),
}
DOCS = f"""
d AS (SELECT source AS doc_id, lang, n_chars, quality, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT *, CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://\\S+$') THEN 'url' WHEN regexp_matches(x, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'numeric'
  WHEN regexp_matches(x, '^\\pL+$') THEN 'alpha' WHEN regexp_matches(x, '^[\\pL\\pN]+$') THEN 'alphanumeric' WHEN x IS NOT NULL THEN 'text' END AS sh FROM d),
hs AS (SELECT doc_id, sh, count(*) AS n FROM k WHERE sh IS NOT NULL GROUP BY ALL)"""
DOMINANT = "CASE WHEN count(*) FILTER (WHERE sh <> 'empty') = 0 THEN 'empty' WHEN max(n) FILTER (WHERE sh <> 'empty') / sum(n) FILTER (WHERE sh <> 'empty') >= 0.95 THEN arg_min(sh, (-n, sh)) FILTER (WHERE sh <> 'empty') ELSE 'mixed' END"
NODES = f"""
SELECT doc_id, '' AS path, count(*) AS n_present, 0 AS n_null, count(*) AS n_count, NULL::BIGINT AS length_min, NULL::BIGINT AS length_max, 'object' AS type, NULL AS shape FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, '/lang', count(*), 0, count(*), min(length(lang)), max(length(lang)), 'string', 'alpha' FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, '/n_chars', count(*), 0, count(*), NULL, NULL, 'integer', 'plain' FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, '/quality', count(quality), 0, count(*), NULL, NULL, 'integer', 'plain' FROM k GROUP BY doc_id HAVING count(quality) > 0
UNION ALL SELECT doc_id, '/text', count(*), count(*) FILTER (WHERE text IS NULL), count(*), min(length(text)), max(length(text)),
  CASE WHEN count(text) = 0 THEN 'null' WHEN count(text) < count(*) THEN 'null|string' ELSE 'string' END,
  (SELECT {DOMINANT} FROM hs WHERE hs.doc_id = k.doc_id HAVING count(*) > 0) FROM k GROUP BY doc_id"""
ORACLES = {
    "events_profile": """WITH e AS (SELECT event_type AS doc_id, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT unnest(['/[]', '/[]/event_id', '/[]/user_id', '/[]/event_type', '/[]/props', '/[]/props/k']) AS path,
unnest(['object', 'integer', 'integer', 'string', 'object', 'integer']) AS type, unnest([NULL, 'plain', 'plain', 'alpha', NULL, 'plain']) AS shape)
SELECT doc_id, path, n AS n_present, 0 AS n_null, n AS n_count, type, shape FROM e CROSS JOIN p""",
    "documents_profile": f"WITH{DOCS}{NODES}",
    "merge_presence": f"WITH{DOCS}, nd AS ({NODES}) SELECT path, count(DISTINCT doc_id) AS documents FROM nd GROUP BY path",
    "merged_schema": f"""WITH{DOCS}, nd AS ({NODES}), al AS (SELECT sh, sum(n) AS n FROM hs GROUP BY sh)
SELECT path, count(DISTINCT doc_id) AS documents, CASE WHEN path = '/text' AND (SELECT count(*) > count(text) FROM k) THEN 'null|string' ELSE min(type) END AS type, sum(n_present)::BIGINT AS n_present, sum(n_null)::BIGINT AS n_null,
  CASE WHEN path = '' THEN sum(n_count) ELSE (SELECT count(*) FROM k) END::BIGINT AS n_count, min(length_min) AS length_min, max(length_max) AS length_max,
  CASE path WHEN '/text' THEN (SELECT {DOMINANT} FROM al) ELSE min(shape) END AS shape FROM nd GROUP BY path""",
    "look_alike_groups": """WITH s AS (SELECT o_custkey % 50 AS g, o_orderstatus, list(DISTINCT o_orderpriority) AS sig FROM orders GROUP BY ALL), m AS (SELECT g, p, count(*) AS c FROM (SELECT g, unnest(sig) AS p FROM s) GROUP BY ALL),
z AS (SELECT g, count(*) AS n FROM s GROUP BY g), c AS (SELECT g, list(p) AS common FROM m JOIN z USING (g) WHERE c * 2 > n GROUP BY g)
SELECT g, avg(len(list_intersect(sig, coalesce(common, []))) / len(sig)) >= 0.8 AS alike FROM s LEFT JOIN c USING (g) GROUP BY g""",
    "shared_users": """WITH u AS (SELECT DISTINCT event_type, user_id FROM events), n AS (SELECT event_type, count(*) AS n FROM u GROUP BY ALL), c AS (SELECT a.event_type, b.event_type AS other, count(*) AS common FROM u a JOIN u b USING (user_id) WHERE a.event_type < b.event_type GROUP BY ALL)
SELECT c.event_type, other, round(common / (n.n + m.n - common), 6) AS share FROM c JOIN n ON c.event_type = n.event_type JOIN n m ON m.event_type = other""",
    "normalized_keys": """WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Chat with ' || c_name ELSE CAST(c_custkey AS VARCHAR) END AS key, CASE WHEN c_custkey % 2 = 0 THEN '/chats/Chat with {*}' ELSE '/chats/{*}' END AS new_path FROM customer)
SELECT doc_id, '/chats/' || key || tail AS path, new_path || tail AS new_path FROM k, (SELECT unnest(['', '/text', '/at']) AS tail)""",
    "normalized_keys_by_shape": """WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_custkey % 2 = 0 AS named, CASE WHEN c_custkey % 2 = 0 THEN 'Chat with ' || c_name ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer),
n AS (SELECT *, CASE WHEN NOT named THEN '/chats/{*}' WHEN count(*) FILTER (WHERE named) OVER (PARTITION BY doc_id) >= 2 THEN '/chats/Chat with {*}' END AS np FROM k)
SELECT doc_id, '/chats/' || key || tail AS path, np || tail AS new_path FROM n, (SELECT unnest(['', '/text', '/at']) AS tail) WHERE np IS NOT NULL""",
    "data_points": f"WITH{base.URL_PATHS}, ap AS (SELECT DISTINCT platform, {base.PREFIXES.format(p='path')} AS path FROM url) SELECT platform, path, CASE length(path) % 4 WHEN 0 THEN length(path) % 3 <> 0 WHEN 1 THEN TRUE ELSE length(path) % 3 <> 0 END AS point FROM ap",
}
