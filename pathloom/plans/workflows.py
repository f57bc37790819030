"""Queries on the work of many uploads: references and suggestions, renormalizing, moved curation, replayed suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.operators import explorer, normalize, proposals, references, renormalize, timeline
from pathloom.plans import base
from pathloom.sources.staging import staged

RULES = [("0", "variable_key", "/chats/Chat with *"), ("1", "variable_key", "/chats/Chat with *"), ("2", "keep_key", "/chats/Chat with *"), ("2", "keep_key", "/chats/[0-9]*")]


def page_uploads(s, d):
    """Blocks of thirty pages as uploads of three platforms, requested on twenty days in another order than they came."""
    block = F.expr("page_id div 30")
    rows = base.table(s, d, "pages").select((F.col("page_id") % 3).cast("string").alias("platform"), block.alias("created_at")).distinct()
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("created_at") * 37 % 20).cast("int"))
    return rows.select("platform", F.col("created_at").cast("string").alias("upload_id"), day.alias("requested_at"), "created_at", F.when(F.col("created_at") % 3 == 0, "json").otherwise("zip").alias("root_format"), (F.col("created_at") % 5 != 4).alias("registered"))


def page_nodes(s, d):
    """The page paths of each upload with all above them, whole; every other block has a language's folder by another name."""
    pages = base.url_paths(s, d).withColumn("block", F.expr("page_id div 30"))
    path = F.when(F.col("block") % 2 == 1, F.regexp_replace("path", "/fr(/|$)", "/fra$1")).otherwise(F.col("path"))
    ups = pages.select("platform", F.col("block").cast("string").alias("upload_id"), "page_id", path.alias("leaf"), F.explode(F.concat(F.array(F.lit("")), P.ancestors(path))).alias("path"))
    leaf = F.when(F.col("leaf") == F.col("path"), F.col("page_id") % 4)
    rows = ups.groupBy("platform", "upload_id", "path").agg(F.min("page_id").alias("position"), F.bool_and(F.col("leaf") == F.col("path")).alias("is_leaf"), F.max(leaf).alias("of"))
    depth = P.depth(F.col("path"))
    kind = F.when(depth == 0, "container").when(depth == 1, "file").otherwise("data")
    types = F.when(depth == 0, F.array().cast("array<string>")).when(~F.col("is_leaf") | (depth == 1), F.array(F.lit("object")))
    types = types.when(F.col("of") == 0, F.array(F.lit("integer"))).when(F.col("of") == 1, F.array(F.lit("null"), F.lit("string"))).otherwise(F.array(F.lit("string")))
    text = F.array_contains("type", F.lit("string"))
    shape = F.when(text & (F.col("of") == 3), "text").when(text, "date").when(F.array_contains("type", F.lit("integer")), "plain")
    rows = rows.withColumn("type", types).withColumn("shape", shape)
    fmt = F.when(F.col("shape") == "date", F.when(F.col("position") % 5 == 0, "%d.%m.%Y").otherwise("%Y-%m-%d"))
    return rows.select("platform", "upload_id", "path", P.parent(F.col("path")).alias("parent_path"), kind.alias("kind"), F.when(F.col("path") != "", P.last(F.col("path"))).alias("name"), "type", "shape", fmt.alias("format"), "position")


def reference_schemas(s, d):
    up = page_uploads(s, d)
    found = references.as_of(up, page_nodes(s, d), up.where("registered"))
    return found.withColumns({"type": F.array_join("type", "|"), "requested_at": F.col("requested_at").cast("string"), "position": F.col("position").cast("long")})


def unknown_points(s, d):
    return references.unknown_points(page_uploads(s, d), page_nodes(s, d)).withColumn("requested_at", F.col("requested_at").cast("string"))


def upload_suggestions(s, d):
    return references.suggested(page_uploads(s, d), page_nodes(s, d))


def rules(s):
    """The rules of each platform, as they are kept with it."""
    return references.path_rules(s.createDataFrame(RULES, "platform string, kind string, pattern string"))


def by_platform(s):
    found = rules(s).collect()  # as many as there are platforms
    return [{r.platform: list(r[c]) for r in found if r[c]} for c in ("variable_keys", "keep_keys")]


def chat_nodes(s, d):
    """Customers as chats of a nation's document: a platform per fifth nation, keys by name or number."""
    c = base.table(s, d, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Chat with "), "c_name")).otherwise(F.col("c_custkey").cast("string"))
    doc = normalize.document_id(F.col("c_nationkey") % 5, F.col("c_nationkey"))
    at = F.concat(F.lit("/chats/"), key)
    cell = lambda path, *types: F.struct(path.alias("path"), F.array(*map(F.lit, types)).alias("type"))
    rows = c.select(doc.alias("doc_id"), "c_custkey", F.explode(F.array(cell(F.lit(""), "object"), cell(F.lit("/chats"), "object"), cell(at, "object"), cell(F.concat(at, F.lit("/text")), "string"), cell(F.concat(at, F.lit("/at")), "integer"))).alias("x"))
    one = rows.groupBy("doc_id", "x.path").agg(F.first("x.type").alias("type"), F.min("c_custkey").alias("position"), F.count("*").alias("n_present"))
    shape = F.when(F.array_contains("type", F.lit("string")), "text").when(F.array_contains("type", F.lit("integer")), "plain")
    one = one.withColumn("shape", shape).withColumn("shapes", F.when(shape.isNotNull(), F.array(F.struct(shape.alias("shape"), F.col("n_present").alias("n")))))
    return one.select("doc_id", "path", P.parent(F.col("path")).alias("parent_path"), F.when(F.col("path") != "", P.last(F.col("path"))).alias("name"), F.when(F.col("path") == "", "file").otherwise("data").alias("kind"), "type", "shape", "shapes", F.lit(None).cast("string").alias("format"), "n_present", F.lit(0).cast("long").alias("n_null"), F.col("n_present").alias("n_count"), "position")


def renormalized_paths(s, d):
    return renormalize.renamed_paths(staged(chat_nodes(s, d), "stored-nodes"), *by_platform(s))


def renormalize_report(s, d):
    return renormalize.report(renormalized_paths(s, d)).withColumn("paths", F.array_join("paths", ";"))


def renormalized_nodes(s, d):
    nodes = chat_nodes(s, d)
    found = renormalize.renormalized(nodes, *by_platform(s))[2]
    return found.select("doc_id", "path", "name", F.array_join("type", "|").alias("type"), "shape", "n_present", "n_count", "position", "keys")


def moved(s, d):
    """Users' locations whose numbers became a pattern, with the patterns' own locations, which carry curation too."""
    loc = base.locations(s, d).withColumn("examples", F.array(F.concat(F.lit("e"), (F.col("location") % 3).cast("string"))))
    old = loc.select("platform", "location", "path", "annotation", "ignored", "examples")
    new = old.groupBy("platform", F.regexp_replace("path", "/[0-9]+", "/{*}").alias("path")).agg((F.min("location") + 1_000_000).alias("location"), F.min(F.when(F.col("location") % 4 == 0, F.lit("kept"))).alias("annotation"))
    new = new.select("platform", "location", "path", "annotation", F.lit(False).alias("ignored"), F.array(F.lit("e0")).alias("examples"))
    moves = old.select("platform", "path", F.regexp_replace("path", "/[0-9]+", "/{*}").alias("new_path"), F.col("location").alias("ord"))
    seen = old.where("location % 9 = 0").select("platform", "location")
    return renormalize.moved_curation(old.unionByName(new), moves, seen)


def moved_curation(s, d):
    return moved(s, d)[0].withColumn("examples", F.array_join("examples", ";"))


def event_proposals(s, d):
    """Events as suggestions of every kind about users' locations, the annotations and representations of their types."""
    e = base.table(s, d, "events")
    kinds = F.array(*map(F.lit, ("link", "new_annotation", "ignore", "unassign", "edit_annotation", "new_representation", "edit_representation", "delete_representation")))
    kind = F.element_at(kinds, (F.col("event_id") % 8 + 1).cast("int"))
    at = lambda n: F.concat(F.col("event_type"), F.lit("-"), n.cast("string"))
    k = F.get_json_object("props", "$.k")
    named = F.struct(F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("n"), k)).alias("name"), F.concat(F.lit("d"), k).alias("description"), F.lit("").alias("note"), (F.col("event_id") % 3 == 0).alias("pii"), F.when(F.col("event_id") % 16 == 1, F.array(at(F.col("user_id").bitwiseXOR(F.lit(1))))).alias("also"), F.when(F.col("event_id") % 32 > 15, F.array(F.struct(F.lit("activity").alias("subject"), F.lit(1).alias("role"), F.col("user_id").alias("location")))).alias("metadata"))
    number = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    action = F.element_at(F.array(*map(F.lit, ("accept", "accept", "reject", "withdraw"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("proposal_id"), kind.alias("kind"), F.col("event_type").alias("platform"), F.when(kind.isin(*proposals.LOCATION_KINDS, "new_representation"), at(F.col("user_id"))).alias("location"),
        F.when(kind.isin("link", "edit_annotation"), at(F.col("user_id") % 9)).alias("annotation"), F.when(kind.isin("edit_representation", "delete_representation"), at(F.col("user_id") % 30)).alias("representation"),
        F.col("event_type").alias("annotation_platform"), F.to_json(named).alias("values"), (F.col("user_id") % 7).alias("proposed_by"), (F.col("event_id") % 23 == 0).alias("staff"), number.alias("created_at"),
        F.when(F.col("event_id") % 5 != 0, action).alias("action"), (number + F.col("event_id") * 7919 % 200_000).alias("decided_at"), (F.col("event_id") % 3 == 0).alias("stale_ok"),
    )


def event_targets(s, d):
    e = base.table(s, d, "events").select("event_type", "user_id").distinct()
    cell = lambda prefix, n, state: F.struct(F.concat(F.lit(prefix), "event_type", F.lit("-"), n.cast("string")).alias("target"), F.lit(state).alias("state"))
    some = F.array(cell("location:", F.col("user_id"), '{"annotation": null, "ignored": false}'), cell("location:", F.col("user_id").bitwiseXOR(F.lit(1)), '{"annotation": null, "ignored": false}'), cell("annotation:", F.col("user_id") % 9, '{"description": "", "name": "first", "note": "", "pii": false}'), cell("representation:", F.col("user_id") % 30, '{"metadata": [], "name": "first"}'))
    return e.select(F.explode(some).alias("x"), F.col("event_type").alias("platform")).select("x.target", "platform", "x.state").distinct()


def group_places(s, d):
    nodes = page_nodes(s, d)
    groups = nodes.where("path <> ''").select("platform", F.col("parent_path").alias("path"))
    names = nodes.select("platform").distinct().withColumn("root_name", F.concat(F.lit("Pages of "), "platform"))
    found = explorer.places(groups, nodes.select("platform", "path", F.when((F.col("kind") == "file") & (F.col("position") % 2 == 0), "folder").otherwise(F.col("kind")).alias("kind")), names)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x[f].cast("string"))), "|")
    return found.withColumns({"title": joined("title", "last"), "crumbs": joined("crumbs", "is_key")})


def stored_flags(s, d):
    return page_nodes(s, d).select("platform", "upload_id", "path", (F.col("position") % 3 == 0).alias("is_data_point"))


def read_uploads(s, d):
    """Documents as uploads of a declared format, of which some can't be read and some weren't yet."""
    docs = base.table(s, d, "documents").select(F.col("doc_id").alias("upload_id"), F.length("text").alias("n"))
    pick = lambda at, *v: F.element_at(F.array(*map(F.lit, v)), (at + 1).cast("int"))
    uploads = docs.select("upload_id", pick(F.col("upload_id") % 4, "zip", "json", "csv", "").alias("file_format"))
    kind = pick(F.col("n") % 4, "container", "file", "file", "unmatched")
    roots = docs.where("upload_id % 11 <> 0").select("upload_id", kind.alias("kind"), pick(F.col("n") % 3, ".json", ".CSV", ".zip").alias("ext"), F.when((F.col("n") % 4 == 3) & (F.col("n") % 5 != 0), "broken").alias("error"))
    return explorer.parsed_states(uploads, roots)


def profile_children(s, d):
    """Page paths whose language folders are list items, and what was seen below each in registered uploads."""
    nodes = page_nodes(s, d).join(page_uploads(s, d).where("registered").select("platform", "upload_id"), ["platform", "upload_id"])
    item = lambda c: F.regexp_replace(c, "/en(/|$)", "/[]$1")
    seen = nodes.select("platform", item("path").alias("path"), item("parent_path").alias("parent_path"), F.array_join("type", "|").alias("type"))
    found = timeline.with_children(seen, seen)
    return found.withColumn("item_types", F.array_join(F.transform("item_types", lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), ","))


def choices(s, d):
    found = explorer.filter_choices(base.uploads(s, d))
    return found.withColumns({c: F.array_join(c, ",") for c in ("languages", "request_formats", "root_formats")})


QUERIES = {
    "group_places": group_places,
    "refreshed_observations": lambda s, d: explorer.refreshed(stored_flags(s, d), page_nodes(s, d))[0],
    "refresh_counts": lambda s, d: explorer.refreshed(stored_flags(s, d), page_nodes(s, d))[1],
    "parsed_states": read_uploads,
    "filter_choices": choices,
    "profile_children": profile_children,
    "reference_schemas": reference_schemas,
    "unknown_points": unknown_points,
    "upload_suggestions": upload_suggestions,
    "renormalized_paths": renormalized_paths,
    "renormalize_report": renormalize_report,
    "renormalized_nodes": renormalized_nodes,
    "moved_curation": moved_curation,
    "curation_conflicts": lambda s, d: moved(s, d)[1],
    "replayed_proposals": lambda s, d: proposals.replayed(event_proposals(s, d), event_targets(s, d))[0],
    "replayed_targets": lambda s, d: proposals.replayed(event_proposals(s, d), event_targets(s, d))[1],
}

UPLOADS = f"""WITH{base.URL_PATHS}, up AS (SELECT DISTINCT CAST(page_id % 3 AS VARCHAR) AS platform, CAST(page_id // 30 AS VARCHAR) AS upload_id, DATE '2024-01-01' + CAST(page_id // 30 * 37 % 20 AS INT) AS requested_at, page_id // 30 AS created_at,
  CASE WHEN page_id // 30 % 3 = 0 THEN 'json' ELSE 'zip' END AS root_format, page_id // 30 % 5 <> 4 AS registered FROM pages),
lf AS (SELECT platform, page_id, CAST(page_id // 30 AS VARCHAR) AS upload_id, CASE WHEN page_id // 30 % 2 = 1 THEN regexp_replace(path, '/fr(/|$)', '/fra\\1', 'g') ELSE path END AS leaf FROM url),
an AS (SELECT platform, upload_id, page_id, leaf, unnest(list_concat([''], list_transform(range(2, len(string_split(leaf, '/')) + 1), lambda i: array_to_string(string_split(leaf, '/')[1:i], '/')))) AS path FROM lf),
g AS (SELECT platform, upload_id, path, min(page_id) AS position, bool_and(leaf = path) AS is_leaf, max(CASE WHEN leaf = path THEN page_id % 4 END) AS kind4, len(string_split(path, '/')) - 1 AS depth FROM an GROUP BY ALL),
ty AS (SELECT *, CASE depth WHEN 0 THEN 'container' WHEN 1 THEN 'file' ELSE 'data' END AS kind, CASE WHEN depth = 0 THEN []::VARCHAR[] WHEN NOT is_leaf OR depth = 1 THEN ['object'] WHEN kind4 = 0 THEN ['integer'] WHEN kind4 = 1 THEN ['null', 'string'] ELSE ['string'] END AS type FROM g),
sh AS (SELECT *, CASE WHEN list_contains(type, 'string') AND kind4 = 3 THEN 'text' WHEN list_contains(type, 'string') THEN 'date' WHEN list_contains(type, 'integer') THEN 'plain' END AS shape FROM ty),
nd AS (SELECT *, CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path, CASE WHEN path <> '' THEN regexp_extract(path, '[^/]*$') END AS name, CASE WHEN shape = 'date' THEN CASE WHEN position % 5 = 0 THEN '%d.%m.%Y' ELSE '%Y-%m-%d' END END AS format FROM sh)"""
CHATS = """WITH k AS (SELECT c_nationkey, c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'Chat with ' || c_name ELSE CAST(c_custkey AS VARCHAR) END AS key, c_nationkey % 5 AS platform, '{"platform":"' || (c_nationkey % 5) || '","upload_id":"' || c_nationkey || '"}' AS doc_id FROM customer),
n AS (SELECT *, count(*) FILTER (WHERE c_custkey % 2 = 0) OVER (PARTITION BY c_nationkey) AS named FROM k),
r AS (SELECT *, CASE WHEN c_custkey % 2 = 1 THEN '/chats/{*}' WHEN platform < 2 OR named >= 2 THEN '/chats/Chat with {*}' ELSE '/chats/' || key END AS np FROM n WHERE platform <> 2),
m AS (SELECT doc_id, platform, key, c_name, c_custkey, '/chats/' || key || tail AS path, np || tail AS new_path, tail FROM r, (SELECT unnest(['', '/text', '/at']) AS tail))"""
CURATED = f"""WITH {base.OBSERVATIONS.strip()},{base.LOCATIONS}, old AS (SELECT platform, location, path, regexp_replace(path, '/[0-9]+', '/{{*}}') AS np, annotation, ignored, 'e' || (location % 3) AS ex FROM loc),
mv AS (SELECT * FROM old WHERE location % 9 <> 0), nw AS (SELECT platform, np AS path, min(location) + 1000000 AS location, min(CASE WHEN location % 4 = 0 THEN 'kept' END) AS annotation FROM old GROUP BY ALL),
mg AS (SELECT platform, np AS path, arg_min(annotation, location) FILTER (WHERE annotation IS NOT NULL) AS first, coalesce(bool_or(ignored AND annotation IS NULL), FALSE) AS ig, list(ex ORDER BY location) AS exs FROM mv GROUP BY ALL),
res AS (SELECT nw.platform, nw.location, nw.path, coalesce(annotation, first) AS annotation, CASE WHEN annotation IS NOT NULL OR first IS NOT NULL THEN FALSE ELSE coalesce(ig, FALSE) END AS ignored,
  array_to_string(list_reduce(['e0'] || coalesce(exs, []::VARCHAR[]), lambda a, b: CASE WHEN list_contains(string_split(a, ';'), b) THEN a ELSE a || ';' || b END), ';') AS joined FROM nw LEFT JOIN mg USING (platform, path))"""
FLAGS = """, fl AS (SELECT platform, upload_id, path, position % 3 = 0 AS was, CASE WHEN path LIKE '%/[]' THEN kind = 'data' WHEN kind = 'file' THEN list_contains(type, 'array') ELSE kind = 'data' AND type <> ['object'] END AS now FROM nd)"""
ORACLES = {
    "group_places": f"""{UPLOADS}, kn AS (SELECT platform, path, bool_or(kind = 'file' AND position % 2 <> 0) AS is_file, bool_or(kind = 'data') AS is_key FROM nd GROUP BY ALL),
gp AS (SELECT DISTINCT platform, parent_path AS path FROM nd WHERE path <> ''),
up2 AS (SELECT platform, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM gp), st AS (SELECT u.platform, u.path, i, array_to_string(string_split(u.path, '/')[1:i + 1], '/') AS up FROM up2 u),
se AS (SELECT st.*, coalesce(is_file, FALSE) AS is_file, coalesce(is_key, FALSE) AS is_key FROM st LEFT JOIN kn ON kn.platform = st.platform AND kn.path = st.up),
rt AS (SELECT gp.platform, gp.path, max(i) FILTER (WHERE is_file) AS pos, gp.path = '' OR coalesce(bool_or(is_key) FILTER (WHERE i = 1), FALSE) AS top FROM gp LEFT JOIN se ON se.platform = gp.platform AND se.path = gp.path GROUP BY gp.platform, gp.path),
ro AS (SELECT *, CASE WHEN pos IS NOT NULL THEN array_to_string(string_split(path, '/')[1:pos + 1], '/') WHEN top THEN '' ELSE path END AS root FROM rt)
SELECT platform, path, root, CASE WHEN root = '' THEN 'Pages of ' || platform || ':true' ELSE array_to_string(list_transform(string_split(root, '/')[2:], lambda n, i: n || CASE WHEN i < len(string_split(root, '/')) - 1 THEN ':false' WHEN pos IS NULL THEN '/:true' ELSE ':true' END), '|') END AS title,
  coalesce((SELECT string_agg(regexp_extract(up, '[^/]*$') || ':' || CAST(is_key AS VARCHAR), '|' ORDER BY i) FROM se WHERE se.platform = ro.platform AND se.path = ro.path AND (i > pos OR (pos IS NULL AND top))), '') AS crumbs FROM ro""",
    "refreshed_observations": f"{UPLOADS}{FLAGS} SELECT platform, upload_id, path, now AS is_data_point FROM fl WHERE was <> now",
    "refresh_counts": f"{UPLOADS}{FLAGS} SELECT now AS is_data_point, count(*) AS changed FROM fl WHERE was <> now GROUP BY ALL",
    "parsed_states": """WITH u AS (SELECT doc_id AS upload_id, ['zip', 'json', 'csv', ''][doc_id % 4 + 1] AS file_format, length(text) AS n FROM documents),
r AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'zip' ELSE ['json', 'csv', 'zip'][n % 3 + 1] END AS root_format, CASE WHEN n % 4 = 3 AND n % 5 <> 0 THEN 'broken' END AS bad FROM u WHERE upload_id % 11 <> 0),
e AS (SELECT upload_id, root_format, coalesce(bad, CASE WHEN file_format <> '' AND file_format <> root_format THEN 'Declared as a ' || CASE file_format WHEN 'zip' THEN 'ZIP archive' WHEN 'json' THEN 'JSON file' ELSE 'CSV file' END || ', but the file is ' || upper(root_format) || '.' END) AS error FROM r)
SELECT upload_id, CASE WHEN e.upload_id IS NULL THEN 'pending' WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error, root_format FROM u LEFT JOIN e USING (upload_id)""",
    "profile_children": f"""{UPLOADS}, se AS (SELECT n.platform, regexp_replace(path, '/en(/|$)', '/[]\\1', 'g') AS path, regexp_replace(parent_path, '/en(/|$)', '/[]\\1', 'g') AS up, array_to_string(type, '|') AS type FROM nd n JOIN up u USING (platform, upload_id) WHERE registered),
ct AS (SELECT platform, up, type, count(*) AS n FROM se WHERE path LIKE '%/[]' AND type <> '' GROUP BY ALL), it AS (SELECT platform, up, string_agg(type || ':' || n, ',' ORDER BY n DESC, type) AS item_types FROM ct GROUP BY ALL)
SELECT DISTINCT a.platform, a.path, EXISTS (SELECT 1 FROM se b WHERE b.platform = a.platform AND b.up = a.path) AS has_children, coalesce(item_types, '') AS item_types FROM se a LEFT JOIN it ON it.platform = a.platform AND it.up = a.path""",
    "filter_choices": f"WITH {base.OBSERVATIONS.strip()} SELECT platform, array_to_string(list_sort(list(DISTINCT nullif(language, ''))), ',') AS languages, array_to_string(list_sort(list(DISTINCT nullif(request_format, ''))), ',') AS request_formats, array_to_string(list_sort(list(DISTINCT nullif(root_format, ''))), ',') AS root_formats FROM up WHERE registered GROUP BY platform",
    "reference_schemas": f"""{UPLOADS}, asked AS (SELECT DISTINCT platform, requested_at FROM up WHERE registered),
seen AS (SELECT a.platform, a.requested_at, u.root_format, n.*  EXCLUDE (platform), (u.created_at, u.upload_id) AS stamp FROM asked a JOIN up u ON a.platform = u.platform AND u.registered AND u.requested_at < a.requested_at JOIN nd n ON n.platform = u.platform AND n.upload_id = u.upload_id),
cnt AS (SELECT platform, requested_at, root_format, path, shape, count(*) AS n FROM seen WHERE shape IS NOT NULL GROUP BY ALL),
dom AS (SELECT platform, requested_at, root_format, path, CASE WHEN max(n) >= 0.95 * sum(n) THEN arg_max(shape, n) ELSE 'mixed' END AS shape FROM cnt GROUP BY ALL),
one AS (SELECT platform, requested_at, root_format, path, min(['data', 'file', 'container'][list_position(['data', 'file', 'container'], kind)]) AS kind, arg_max(coalesce(name, '?'), stamp) AS name, arg_max(coalesce(parent_path, '?'), stamp) AS up, list_sort(list_distinct(flatten(list(type)))) AS types, max(stamp) AS stamp, arg_max(position, stamp) AS place FROM seen GROUP BY ALL),
fmt AS (SELECT s.platform, s.requested_at, s.root_format, s.path, CASE WHEN min(s.format) = max(s.format) THEN min(s.format) END AS format FROM seen s JOIN dom d USING (platform, requested_at, root_format, path) WHERE s.shape = d.shape GROUP BY ALL)
SELECT platform, CAST(requested_at AS VARCHAR) AS requested_at, root_format, path, kind, nullif(name, '?') AS name, array_to_string(types, '|') AS type, dom.shape, format,
  row_number() OVER (PARTITION BY platform, requested_at, root_format, up ORDER BY stamp DESC, place, path) - 1 AS position FROM one LEFT JOIN dom USING (platform, requested_at, root_format, path) LEFT JOIN fmt USING (platform, requested_at, root_format, path)""",
    "unknown_points": f"""{UPLOADS} SELECT n.platform, n.upload_id, CAST(u.requested_at AS VARCHAR) AS requested_at, n.path FROM nd n JOIN up u USING (platform, upload_id) WHERE registered AND kind = 'data' AND type <> ['object']
AND EXISTS (SELECT 1 FROM up v WHERE v.platform = n.platform AND v.registered AND v.requested_at < u.requested_at)
AND NOT EXISTS (SELECT 1 FROM up v JOIN nd m ON m.platform = v.platform AND m.upload_id = v.upload_id WHERE v.platform = n.platform AND v.registered AND v.requested_at < u.requested_at AND m.path = n.path)""",
    "renormalized_paths": f"{CHATS} SELECT doc_id, path, new_path FROM m WHERE path <> new_path",
    "renormalize_report": f"{CHATS} SELECT CAST(platform AS VARCHAR) AS platform, count(DISTINCT doc_id) AS uploads, array_to_string(list_sort(list(DISTINCT new_path)), ';') AS paths FROM m WHERE path <> new_path GROUP BY ALL",
    "moved_curation": f"{CURATED} SELECT platform, location, path, annotation, ignored, joined AS examples FROM res UNION ALL SELECT platform, location, path, annotation, ignored, ex FROM old WHERE location % 9 = 0",
    "curation_conflicts": f"{CURATED} SELECT mv.platform, mv.np AS path, res.annotation AS kept, mv.annotation AS dropped FROM mv JOIN res ON res.platform = mv.platform AND res.path = mv.np WHERE mv.annotation <> res.annotation",
}
