"""Token ids as ORC: integer run-length encoded lists in ascending document order, found again by stripe metadata.

Documents are range partitioned and sorted by id before they are encoded, so that each file holds one range of ids and
stripe and row-group statistics, with Bloom filters on doc_id, let a reader skip all but what it asks for.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import documents, shared_folder, small_batches, text_or_empty
from pathloom.llm.tokens import encoder, tokenizer_path

SCHEMA = "part int, doc_id long, part_start long, ids array<int>"
END_ID = 2


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pieces: str = "text", end_id: int = END_ID, stripe_bytes: int = 64 << 20) -> None:
    """Encodes every text of docs (null: empty) and writes (part, doc_id, part_start, ids) in ascending doc_id order.

    part numbers the ranges of ids in order; part_start counts the ids of the range before the document. Rows with
    one doc_id follow each other, shorter and smaller texts first; rows without doc_id come first of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = encoder(tokenizer, pieces).encode_with_end(batch.column(1), end_id)
            ends = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    batch.column(0),
                    pa.array(before + ends[:-1]),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                ],
                names=["part", "doc_id", "part_start", "ids"],
            )
            before += int(ends[-1])

    small_batches(docs.sparkSession, 500)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    writer = ordered.mapInArrow(run, SCHEMA).write.format("orc").option("compression", "zstd")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_bytes)).save(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows, by stripes in parallel; low and high (inclusive) prune files, stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def positions(rows: DataFrame) -> DataFrame:
    """Adds start, the number of ids of all documents before: one running sum over the ranges, not over documents."""
    parts = rows.groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("part_start"))


def checksums(rows: DataFrame) -> DataFrame:
    """(part, doc_id, part_start, n_tokens, ids_crc32) of written rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.asarray(lists.values, dtype="<u4")
            at = np.asarray(lists.offsets)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}.orc"
    write_tokens(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), "space")
    sums = checksums(read_tokens(spark, path))
    parts = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return sums.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
