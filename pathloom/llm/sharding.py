"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Every shard bids for every key: ln(u) / weight, with u a uniform number from a digest of key and shard; the highest bid
takes the record. A bid depends on nothing but its key and its shard, so a shard that is added takes records from the
others in proportion to its weight and moves none between them, and one that is removed gives up only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import documents, staged

SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A digest has 32 hexadecimal digits, enough for the bids of so many shards.
PER_DIGEST, DIGITS = 4, 8


def bids(key: Column, shards: dict[int, float]) -> Column:
    """Array of (bid, minus the shard) of every shard for a key; shards: weight above zero by number from 0 on."""
    if not shards or any(n < 0 or not w > 0 for n, w in shards.items()):
        raise ValueError("shards are numbered from 0 on and have weights above zero")
    digests = {block: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(block))).cast("binary")) for block in {n // PER_DIGEST for n in shards}}

    def bid(n: int, weight: float) -> Column:
        part = F.substring(digests[n // PER_DIGEST], 1 + n % PER_DIGEST * DIGITS, DIGITS)
        uniform = (F.conv(part, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((F.log(uniform) / F.lit(float(weight))).alias("bid"), F.lit(-n).alias("minus"))

    return F.array(*(bid(n, w) for n, w in sorted(shards.items())))


def sharded(rows: DataFrame, shards: dict[int, float], grown: dict[int, float] | None = None, key: str = "doc_id", order: str = "tie") -> DataFrame:
    """rows with shard int, slot long (gapless from 0 in each shard, in order of key and order) and grown_shard int.

    shards: weight by number. grown: further shards; grown_shard is the owner when they are there too, null without any.
    Rows of one key, null included, share a shard; they and rows that repeat have slots of their own. rows are written
    as they are, so they should be narrow.

    Slots are numbered by ranges of the order, each small, whatever the keys: rows of one key are told apart by a row
    number, so no key is too large for its range. A range's start in a shard is a sum over the ranges before it.
    """
    best = F.array_max("_bids")
    out = rows.withColumn("_bids", bids(F.col(key), shards)).withColumn("_best", best).drop("_bids")
    new = F.lit(None).cast("int")
    if grown:
        out = out.withColumn("_bids", bids(F.col(key), grown))
        new = (-F.greatest("_best", best)["minus"]).cast("int")
    numbered = out.select(*rows.columns, (-F.col("_best.minus")).cast("int").alias("shard"), new.alias("grown_shard"), F.monotonically_increasing_id().alias("_row"))
    numbered = staged(numbered, "sharded")
    within = [F.asc_nulls_first(key), F.asc_nulls_first(order), F.asc("_row")]
    ranges = staged(numbered.repartitionByRange(*within).withColumn("_range", F.spark_partition_id()), "sharded-ranges")
    counts = ranges.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    # One row a range and shard: a fixed number of rows, whatever the input.
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranges.withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_range").orderBy(*within)))
    slot = (F.col("_start") + F.col("_rank") - 1).cast("long")
    return ranked.join(starts.select("shard", "_range", "_start"), ["shard", "_range"]).select(*rows.columns, "shard", slot.alias("slot"), "grown_shard")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = documents(spark, sf_dir).select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    out = sharded(rows, {n: 1.0 for n in range(SHARDS)}, {SHARDS: 1.0}, order="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The polynomial of CRC-32 in DuckDB SQL: 256 entries by its rule, then one step a byte.
OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
step AS (SELECT list(c ORDER BY i) AS after FROM t WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a // 256, after[1 + xor(a % 256, b)]))) AS text_crc32 FROM documents, step),
b AS (SELECT *, list_transform(range({SHARDS + 1}), lambda s: {{'bid': ln((('0x' || substr(md5(concat_ws(':', doc_id, s // {PER_DIGEST})), 1 + s % {PER_DIGEST} * {DIGITS}, {DIGITS}))::BIGINT + 0.5) / {16**DIGITS}), 'minus': -s}}) AS bids FROM d),
o AS (SELECT doc_id, size, text_crc32, -list_max(bids[1:{SHARDS}]).minus AS shard, -list_max(bids).minus AS grown FROM b)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown::INT AS grown_shard FROM o
"""
