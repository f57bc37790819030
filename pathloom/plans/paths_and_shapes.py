"""Queries on scalar classification, masks, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions import shapes as S
from pathloom.functions.dates import date_fits
from pathloom.operators import compare, curation, normalize, profile, timeline, views
from pathloom.plans import base

VALUES = """
v AS (SELECT 'customer' AS t, 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer
  UNION ALL SELECT 'part', 'p_name', p_name FROM part UNION ALL SELECT 'part', 'p_brand', p_brand FROM part
  UNION ALL SELECT 'pages', 'url', url FROM pages UNION ALL SELECT 'documents', 'lang', lang FROM documents
  UNION ALL SELECT 'documents', 'text', text FROM documents
  UNION ALL SELECT 'orders', 'o_orderkey', CAST(o_orderkey * 100000 AS VARCHAR) FROM orders
  UNION ALL SELECT 'orders', 'order_id', CAST(o_orderkey * 100000 AS VARCHAR) FROM orders)"""
SHAPE = f"""
CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '{S.UUID}') THEN 'uuid'
  WHEN regexp_matches(x, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://\\S+$') THEN 'url'
  WHEN name <> 'order_id' AND regexp_matches(x, '^[0-9]{{1,17}}$') AND (TRY_CAST(x AS BIGINT) BETWEEN 631152000 AND 4102444799 OR TRY_CAST(x AS BIGINT) BETWEEN 631152000000 AND 4102444799999
    OR TRY_CAST(x AS BIGINT) BETWEEN 631152000000000 AND 4102444799999999) THEN 'unix_timestamp'
  WHEN regexp_matches(x, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'numeric'
  WHEN regexp_matches(x, '^\\pL+$') THEN 'alpha' WHEN regexp_matches(x, '^[\\pL\\pN]+$') THEN 'alphanumeric' ELSE 'text' END"""
COUNTS = f"{VALUES}, sh AS (SELECT t, name, {SHAPE} AS shape, count(*) AS n FROM (SELECT t, name, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS x FROM v) GROUP BY ALL)"


def values(spark, sf):
    col = lambda table, name, c: base.table(spark, sf, table).select(F.lit(table).alias("t"), F.lit(name).alias("name"), c.cast("string").alias("v"))
    key = F.col("o_orderkey") * 100000
    parts = [("customer", "c_name", F.col("c_name")), ("customer", "c_mktsegment", F.col("c_mktsegment")), ("part", "p_name", F.col("p_name")), ("part", "p_brand", F.col("p_brand")), ("pages", "url", F.col("url")), ("documents", "lang", F.col("lang")), ("documents", "text", F.col("text")), ("orders", "o_orderkey", key), ("orders", "order_id", key)]
    out = None
    for part in parts:
        out = col(*part) if out is None else out.union(col(*part))
    return out


def histogram(spark, sf):
    return values(spark, sf).groupBy("t", "name", S.string_shape(F.col("v"), S.is_id_key(F.col("name"))).alias("shape")).agg(F.count("*").alias("n"))


def number_shapes(spark, sf):
    o = base.table(spark, sf, "orders").select((F.col("o_orderkey") * 100000 + F.col("o_custkey")).cast("double").alias("v"), F.when(F.col("o_orderkey") % 3 == 0, "userId").when(F.col("o_orderkey") % 3 == 1, "user_id").otherwise("paid").alias("name"))
    return o.groupBy("name", S.number_shape(F.col("v"), S.is_id_key(F.col("name"))).alias("shape"), F.coalesce(S.unix_unit(F.col("v")), F.lit("-")).alias("unit")).agg(F.count("*").alias("n"))


def cells(spark, sf):
    o = base.table(spark, sf, "lineitem")
    text = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("0"), F.col("l_suppkey").cast("string")), F.concat(F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".5e3")), F.lit("e5"), F.when(F.col("l_linenumber") % 2 == 0, "TRUE").otherwise("False"), F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".")), F.concat(F.lit("+"), F.col("l_partkey").cast("string")), F.lit(""))
    return o.select(F.posexplode(text).alias("pos", "cell")).groupBy("pos", S.cell_type(F.col("cell")).alias("type")).agg(F.count("*").alias("n"))


def dates(spark, sf):
    """Order dates written day first: the fits of each value, and what they resolve to per status."""
    o = base.table(spark, sf, "orders").select("o_orderstatus", F.date_format("o_orderdate", "dd/MM/yyyy").alias("v"))
    rows = o.groupBy("o_orderstatus", "v").agg(F.count("*").alias("n")).withColumn("d", date_fits(F.col("v"))).select("o_orderstatus", F.col("d.shape").alias("shape"), F.col("d.fits").alias("fits"), "n")
    return rows.groupBy("o_orderstatus", "shape", "fits").agg(F.sum("n").alias("n"))


def path_parts(spark, sf):
    names = base.table(spark, sf, "part").select(F.concat(F.col("p_name"), F.lit("/~"), F.col("p_brand")).alias("name"), "p_partkey")
    path = P.join(F.lit("/parts"), F.col("name"))
    return names.select("p_partkey", path.alias("path"), P.parent(path).alias("parent"), P.unescape(P.last(path)).alias("last"), P.depth(path).cast("long").alias("depth"))


def masks(spark, sf):
    c = base.table(spark, sf, "customer").select("c_custkey", S.mask(F.col("c_name")).alias("masked"), S.mask_name(F.col("c_name")).alias("kinds"), S.pattern_of(F.col("c_name")).alias("pattern"))
    return c


def samples(spark, sf):
    o = base.document_values(spark, sf).withColumn("shape", F.when(F.col("json_type") == "string", S.string_shape(F.col("s"), F.lit(False))))
    return profile.sampled(o, 3).select("doc_id", "path", F.array_join("samples", "\n").alias("samples"), "redacted")


QUERIES = {
    "shape_histogram": histogram,
    "dominant_shape_by_column": lambda s, d: profile.dominant(histogram(s, d), ["t", "name"], 0.6),
    "number_shapes": number_shapes,
    "csv_cell_types": cells,
    "date_format_candidates": lambda s, d: dates(s, d).withColumn("fits", F.array_join("fits", ";")),
    "date_format_resolved": lambda s, d: profile.resolved_formats(dates(s, d), ["o_orderstatus"]).select("o_orderstatus", "format", F.array_join(F.transform("formats", lambda f: F.concat(f["f"], F.lit("="), f["n"].cast("string"))), ";").alias("formats"), "ambiguous"),
    "path_parts": path_parts,
    "masked_names": masks,
    "mask_of_group": lambda s, d: normalize.most_common_mask(base.table(s, d, "pages").select((F.col("page_id") % 9).alias("g"), F.regexp_replace("url", "[?].*$", "").alias("name")), ["g"]),
    "numbered_names": lambda s, d: normalize.grouped_names(base.table(s, d, "customer").select((F.col("c_nationkey") % 5).alias("folder"), F.concat(F.col("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 3 == 0, ".zip").otherwise(".json")).alias("name"))),
    "variable_keys": lambda s, d: values(s, d).groupBy("t", "name", S.is_variable_key(F.col("v")).alias("variable")).agg(F.count("*").alias("n")),
    "sampled_values": samples,
    "path_rules": lambda s, d: base.all_paths(s, d).select("platform", "path", P.matches(F.col("path"), ["/*/fr/*", "/t*/??/*", "/[a-m]*/de"]).alias("hit")),
    "ancestor_pairs": lambda s, d: base.url_paths(s, d).select("page_id", F.explode(P.ancestors(F.col("path"))).alias("up")),
    "file_order": lambda s, d: timeline.file_order(base.all_paths(s, d).withColumn("position", F.length("path") % 7)),
    "alphabetical_order": lambda s, d: timeline.alphabetical_order(base.all_paths(s, d)),
    "text_filter": lambda s, d: views.matching(base.all_paths(s, d).withColumn("name", P.last(F.col("path"))), "FR"),
    "muted_rows": lambda s, d: views.muted(base.all_paths(s, d).withColumn("parent_path", P.parent(F.col("path"))).withColumn("kind", F.when(F.length("path") % 3 == 0, "file").otherwise("data")).withColumn("type", F.when(F.length("path") % 2 == 0, "null|object").otherwise("string"))).select("platform", "path", "muted"),
    "added_tops": lambda s, d: compare.tops(base.all_paths(s, d).withColumnRenamed("platform", "pair").join(base.all_paths(s, d).select(F.expr("string((int(platform) + 2) % 3)").alias("pair"), "path"), ["pair", "path"], "left_anti")),
    "register_locations": lambda s, d: curation.registered(base.all_paths(s, d).withColumn("upload_id", F.lit("u")).withColumn("parent_path", P.parent(F.col("path"))).withColumn("position", F.lit(0)), base.all_paths(s, d).where(F.length("path") % 2 == 0))[0],
}
FITS = "(CASE WHEN day(o_orderdate) <= 12 THEN '%d/%m/%Y;%m/%d/%Y' ELSE '%d/%m/%Y' END)"
PATHS = f"{base.URL_PATHS}, ap AS (SELECT DISTINCT platform, {base.PREFIXES.format(p='path')} AS path FROM url)"
MASK = "regexp_replace(regexp_replace({0}, '\\pL', 'x', 'g'), '\\p{{Nd}}', '0', 'g')"
KINDS = "regexp_replace(regexp_replace(regexp_replace(" + MASK + ", '[^x0]', 's', 'g'), 'x+', 'x', 'g'), '0+', '0', 'g')"
ORACLES = {
    "shape_histogram": f"WITH{COUNTS} SELECT * FROM sh",
    "dominant_shape_by_column": f"WITH{COUNTS}, f AS (SELECT t, name, sum(n) AS total FROM sh WHERE shape <> 'empty' GROUP BY ALL) SELECT t, name, CASE WHEN max(n) / any_value(total) >= 0.6 THEN arg_min(shape, (-n, shape)) ELSE 'mixed' END AS shape FROM sh JOIN f USING (t, name) WHERE shape <> 'empty' GROUP BY t, name",
    "number_shapes": """WITH o AS (SELECT o_orderkey * 100000 + o_custkey AS v, CASE o_orderkey % 3 WHEN 0 THEN 'userId' WHEN 1 THEN 'user_id' ELSE 'paid' END AS name FROM orders),
u AS (SELECT *, CASE WHEN v >= 631152000 AND v < 4102444800 THEN 's' WHEN v >= 631152000000 AND v < 4102444800000 THEN 'ms' WHEN v >= 631152000000000 AND v < 4102444800000000 THEN 'us' ELSE '-' END AS unit FROM o)
SELECT name, CASE WHEN name = 'paid' AND unit <> '-' THEN 'unix_timestamp' ELSE 'plain' END AS shape, unit, count(*) AS n FROM u GROUP BY ALL""",
    "csv_cell_types": """WITH l AS (SELECT [CAST(l_linenumber AS VARCHAR), '0' || l_suppkey, '-' || l_suppkey || '.5e3', 'e5', CASE WHEN l_linenumber % 2 = 0 THEN 'TRUE' ELSE 'False' END, l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), l_linenumber || '.', '+' || l_partkey, ''] AS cells FROM lineitem),
c AS (SELECT unnest(range(10)) AS pos, unnest(cells) AS cell FROM l)
SELECT pos, CASE WHEN regexp_full_match(cell, '[+-]?(0|[1-9][0-9]*)') THEN 'integer' WHEN regexp_full_match(cell, '[+-]?((0|[1-9][0-9]*)([.][0-9]+)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'number' WHEN lower(cell) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS type, count(*) AS n FROM c GROUP BY ALL""",
    "date_format_candidates": f"SELECT o_orderstatus, 'date' AS shape, {FITS} AS fits, count(*) AS n FROM orders GROUP BY ALL",
    "date_format_resolved": f"SELECT o_orderstatus, CASE WHEN count(DISTINCT {FITS}) = 1 AND min({FITS}) <> '%d/%m/%Y' THEN NULL ELSE '%d/%m/%Y' END AS format, CASE WHEN min({FITS}) <> '%d/%m/%Y' THEN '%d/%m/%Y=' || count(*) || ';%m/%d/%Y=' || count(*) END AS formats, min({FITS}) <> '%d/%m/%Y' AS ambiguous FROM orders GROUP BY o_orderstatus",
    "path_parts": "SELECT p_partkey, '/parts/' || p_name || '~1~0' || p_brand AS path, '/parts' AS parent, p_name || '/~' || p_brand AS last, 2 AS depth FROM part",
    "masked_names": f"SELECT c_custkey, substring(c_name, 1, 1) || {MASK.format('substring(c_name, 2)')} AS masked, regexp_replace({KINDS.format('c_name')}, 's+', 's', 'g') AS kinds, regexp_replace(c_name, '\\p{{Nd}}+', '{{n}}', 'g') AS pattern FROM customer",
    "mask_of_group": f"WITH m AS (SELECT page_id % 9 AS g, regexp_replace({KINDS.format(chr(39).join(['regexp_replace(url, ', '[?].*$', ', ', '', ')']))}, 's+', 's', 'g') AS mask, count(*) AS w FROM pages GROUP BY ALL) SELECT g, arg_min(mask, (-w, mask)) AS mask FROM m GROUP BY g",
    "numbered_names": "WITH f AS (SELECT DISTINCT c_nationkey % 5 AS folder, c_mktsegment || '_' || (c_custkey % 50) || '.json' AS name, c_mktsegment || '_{n}.json' AS pattern FROM customer WHERE c_custkey % 3 <> 0) SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY folder, pattern) >= 2",
    "variable_keys": f"WITH{VALUES} SELECT t, name, regexp_matches(v, '^\\d+$') OR (regexp_matches(v, '^[A-Za-z0-9_-]{{16,}}$') AND regexp_matches(v, '\\d') AND regexp_matches(v, '[A-Za-z]')) OR regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://\\S+$') OR regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS variable, count(*) AS n FROM v GROUP BY ALL",
    "path_rules": f"WITH{PATHS} SELECT platform, path, regexp_full_match(path, '/[^/]*/fr/[^/]*') OR regexp_full_match(path, '/t[^/]*/[^/][^/]/[^/]*') OR regexp_full_match(path, '/[a-m][^/]*/de') AS hit FROM ap",
    "ancestor_pairs": f"WITH{base.URL_PATHS} SELECT page_id, {base.PREFIXES.format(p='path')} AS up FROM url",
    "file_order": f"WITH{PATHS}, an AS (SELECT platform, path, {base.PREFIXES.format(p='path')} AS up FROM ap), od AS (SELECT platform, path, list((length(up) % 7, up) ORDER BY length(up)) AS k FROM an GROUP BY ALL) SELECT platform, path, row_number() OVER (PARTITION BY platform ORDER BY k) AS place FROM od",
    "alphabetical_order": f"WITH{PATHS} SELECT platform, path, row_number() OVER (PARTITION BY platform ORDER BY string_split(lower(path), '/'), string_split(path, '/')) AS place FROM ap",
    "text_filter": f"WITH{PATHS}, hit AS (SELECT * FROM ap WHERE contains(lower(path), 'fr')) SELECT *, regexp_extract(path, '[^/]*$') AS name FROM ap a WHERE EXISTS (SELECT 1 FROM hit h WHERE h.platform = a.platform AND (a.path = h.path OR starts_with(a.path, h.path || '/') OR starts_with(h.path, a.path || '/')))",
    "muted_rows": f"WITH{PATHS} SELECT platform, path, NOT EXISTS (SELECT 1 FROM ap b WHERE b.platform = a.platform AND starts_with(b.path, a.path || '/')) AND path <> '' AND (length(path) % 3 = 0 OR length(path) % 2 = 0) AS muted FROM ap a",
    "added_tops": f"WITH{PATHS}, x AS (SELECT platform AS pair, path FROM ap a WHERE NOT EXISTS (SELECT 1 FROM ap b WHERE b.path = a.path AND b.platform = CAST((CAST(a.platform AS INT) + 1) % 3 AS VARCHAR))) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE x.pair = y.pair AND starts_with(x.path, y.path || '/'))",
    "register_locations": f"WITH{PATHS} SELECT platform, path, regexp_replace(path, '/[^/]*$', '') AS parent_path, 0 AS position FROM ap WHERE length(path) % 2 <> 0",
}
