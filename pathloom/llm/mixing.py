"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A budget of tokens is dealt down a domain-language-source tree by weight. A child takes at most what its subtree
holds; what it leaves goes to its siblings by their weights, and only what no sibling can take goes back to the
ancestors' other children. Each leaf then gives its whole epochs and the token prefix of one more: an epoch is the
leaf's documents in the order of a seeded digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import DOCUMENT_COLUMNS, documents, staged, text_or_empty

LEVELS = ["domain", "lang", "source"]
SEED = 17
BUCKET_DIGITS, BUCKET_LEVELS = 2, 2
#: Target weights of the query and the stage; a child that isn't named weighs 1.
WEIGHTS = {"domain": {"web": 3, "forum": 2, "reference": 4}, "lang": {"en": 6, "fr": 2, "de": 2, "es": 1}, "source": {"src0": 2}}
BUDGET_PERMILLE = 800


def domain_of(source: Column) -> Column:
    """The domain of a source: the hot crawl is the web, single-digit sources are forums, the others reference."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "forum").otherwise("reference")


def token_estimate(text: Column) -> Column:
    """Four bytes to a token, rounded up."""
    return F.expr("1L") * F.floor((F.octet_length(text) + 3) / 4).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level) or {}
    out = F.lit(1)
    for name, w in sorted(known.items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def dealt(children: DataFrame, level: str, parents: list[str]) -> DataFrame:
    """children (parents..., level, capacity, budget of the parent, weight) with budget replaced by each child's own.

    Children whose capacity is under their share, by capacity to weight, keep all they hold; the others share the rest.
    Shares are rounded down, so a parent's budget is met to within one token a child.
    """
    by = W.partitionBy(*parents)
    ordered = by.orderBy(F.col("capacity") / F.col("weight"), level)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    rows = children.withColumn("_before", F.coalesce(F.sum("capacity").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_after", F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("_all", exact("capacity") * F.col("_after") <= (F.col("budget") - F.col("_before")).cast("decimal(20,0)") * F.col("weight"))
    rows = rows.withColumn("_kept", F.coalesce(F.sum(F.when(F.col("_all"), F.col("capacity"))).over(by), F.lit(0)))
    rows = rows.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_all"), F.col("weight"))).over(by), F.lit(1)))
    share = F.expr("cast(cast(budget - _kept as decimal(20,0)) * weight div _open as long)")
    return rows.withColumn("budget", F.when(F.col("_all"), F.col("capacity")).otherwise(share)).drop("_before", "_after", "_all", "_kept", "_open")


def leaf_budgets(sizes: DataFrame, weights: dict[str, dict[str, int]], budget_permille: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf; sizes: (domain, lang, source, tokens)."""
    leaves = sizes.withColumn("capacity", F.col("tokens") * max_epochs)
    total = sizes.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {budget_permille} div 1000 as long)").alias("budget"))
    above, parents = total.withColumn("_root", F.lit(0)), ["_root"]
    for level in LEVELS:
        here = parents[1:] + [level]
        children = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("_root", F.lit(0))
        children = children.join(above.select(*parents, "budget"), parents).withColumn("weight", _weight(level, weights))
        above, parents = dealt(children, level, parents), parents + [level]
    return leaves.join(above.select(*LEVELS, "budget"), LEVELS).select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_permille: int = BUDGET_PERMILLE, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, domain, lang, source, tokens, epoch) of the mixture; a document may come once per epoch.

    The budget is budget_permille thousandths of all tokens of docs. A leaf's last, partial epoch takes documents in
    digest order as long as something of its budget is left before them; the last of these is taken whole, so a leaf
    gets its budget and less than one document more. Null texts have no tokens; a null lang or source is the leaf "";
    rows without doc_id can't be picked and don't count. Rows that repeat are rows of their own.
    """
    return _mixed(docs, weights, budget_permille, max_epochs, seed).drop("mark")


def _mixed(docs: DataFrame, weights: dict[str, dict[str, int]], budget_permille: int, max_epochs: int, seed: int) -> DataFrame:
    """The rows of mix() with mark, which tells the texts of one doc_id apart."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), token_estimate(text_or_empty()).alias("tokens"), F.xxhash64("text").alias("mark"))
    rows = staged(named.select("doc_id", "mark", domain_of(F.col("source")).alias("domain"), "lang", "source", "tokens"), "mixing-rows")
    sizes = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = leaf_budgets(sizes, weights, budget_permille, max_epochs).where("tokens > 0")
    leaves = leaves.select(*LEVELS, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    leaves = staged(leaves.coalesce(1), "mixing-leaves")
    picked = rows.join(leaves, LEVELS)
    whole = picked.where("epochs > 0").select("doc_id", "mark", *LEVELS, "tokens", F.explode(F.expr("sequence(0L, epochs - 1)")).alias("epoch"))

    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.col("doc_id")))
    part = picked.where("rest > 0").select("doc_id", "mark", *LEVELS, "tokens", "epochs", "rest", order.alias("h"), F.lit(0).cast("long").alias("base"))
    key, inside = [*LEVELS, "bucket"], []
    for level in range(BUCKET_LEVELS):  # the prefix ends in one bucket of a leaf; only that one is looked into further
        part = part.withColumn("bucket", F.substring("h", 1 + level * BUCKET_DIGITS, BUCKET_DIGITS))
        sums = part.groupBy(*key).agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket")))
        part = part.join(sums, key).withColumn("base", F.col("base") + F.col("upto") - F.col("n"))
        inside.append(part.where("base + n < rest"))
        part = staged(part.where("base + n >= rest and base < rest").drop("bucket", "n", "upto"), "mixing-edge")  # one bucket a leaf; else each level's plan holds those before it several times
    running = F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("h", "doc_id", "tokens", "mark").rowsBetween(W.unboundedPreceding, 0))
    edge = part.withColumn("upto", F.col("base") + running).where("upto - tokens < rest")
    columns = ["doc_id", "mark", *LEVELS, "tokens", F.col("epochs").alias("epoch")]
    for some in (*inside, edge):
        whole = whole.union(some.select(*columns))
    return whole


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), WEIGHTS, max_epochs=2)


def _sql_level(level: str, parents: list[str], below: str, above: str) -> str:
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    here = ", ".join([*parents, level])
    weight = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items()) + " ELSE 1 END"
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    return f"""
{level}_c AS (SELECT {here}, sum(capacity)::HUGEINT AS capacity, ({weight})::HUGEINT AS weight FROM {below} GROUP BY {here}),
{level}_b AS (SELECT c.*, budget AS parent FROM {level}_c c {join}),
{level}_s AS (SELECT *, capacity * sum(weight) OVER ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (parent - coalesce(sum(capacity) OVER ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS whole FROM {level}_b),
{level}_d AS (SELECT {here}, CASE WHEN whole THEN capacity ELSE
  (parent - coalesce(sum(CASE WHEN whole THEN capacity END) OVER ({by}), 0)) * weight // coalesce(sum(CASE WHEN NOT whole THEN weight END) OVER ({by}), 1) END AS budget FROM {level}_s)"""


def mixing_sql(table: str = "documents", max_epochs: int = 2) -> str:
    """DuckDB SQL of mix() with the default parameters: (doc_id, domain, lang, source, tokens, epoch)."""
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'forum' ELSE 'reference' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM {table} WHERE doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(tokens) AS size, sum(tokens) * {max_epochs} AS capacity FROM d GROUP BY ALL),
total AS (SELECT coalesce(sum(size), 0)::HUGEINT * {BUDGET_PERMILLE} // 1000 AS budget FROM leaf),
{_sql_level("domain", [], "leaf", "total")},
{_sql_level("lang", ["domain"], "leaf", "domain_d")},
{_sql_level("source", ["domain", "lang"], "leaf", "lang_d")},
e AS (SELECT domain, lang, source, budget // size AS epochs, budget % size AS rest FROM leaf JOIN source_d USING (domain, lang, source) WHERE size > 0),
o AS (SELECT d.*, epochs, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || doc_id), doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epochs::BIGINT AS epoch FROM o WHERE upto - tokens < rest AND rest > 0
UNION ALL SELECT doc_id, domain, lang, source, tokens::BIGINT, unnest(range(epochs::BIGINT)) FROM o WHERE epochs > 0
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each at most once, so that deduplication's work isn't undone.

    A row goes by its doc_id and its text, so of one doc_id each text is picked by itself; rows that repeat both stay or
    go together. Rows without doc_id aren't in a mixture and go.
    """
    picked = _mixed(docs, WEIGHTS, BUDGET_PERMILLE, 1, SEED).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("_own"))
    return rows.join(picked, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_semi").drop("_own")
