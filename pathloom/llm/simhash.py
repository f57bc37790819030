"""SimHash near-duplicate detection with multi-index hashing.

A 64-bit fingerprint is cut into segments. Fingerprints within r bits agree to within r // m bits in one of m
segments, so small Hamming balls around each segment's value, looked up in that segment's table, give every
candidate; a candidate counts if the distance over all 64 bits is at most r. Everything after fingerprinting works
on distinct fingerprints, so a group of copies of any size is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches, staged, without
from pathloom.llm.graph import connected_components
from pathloom.llm.near import near_copies, text_mark

BITS = 64
BLOCK = 1 << 15


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    return simhash_of((text or "").encode("utf-8", "surrogatepass").lower().split(), words_per_shingle)


def simhash_of(words: list[bytes], words_per_shingle: int = 3) -> int:
    """As simhash, of a text's words in lower case."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        values = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row of docs. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"]
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _flipped(key: Column, segment: int, width: int) -> Column:
    """The values one bit above key: each zero bit set in turn."""
    zeros = F.filter(F.array(*(F.lit(1 << i).cast("long") for i in range(width))), lambda bit: key.bitwiseAND(bit) == 0)
    return F.transform(zeros, lambda bit: F.struct(F.lit(segment).alias("s"), key.bitwiseOR(bit).alias("key"), F.lit(True).alias("flip")))


def links(fps: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (u, v) of ids of distinct fingerprints that differ in at most radius bits.

    fps: (fp long, id long), one row per fingerprint. The first radius % segments + 1 segments are searched with
    balls of radius // segments bits, the others with one bit less, which is enough by the pigeonhole principle.
    A ball of one bit only flips zeros: of two values one bit apart, one has the zero.
    """
    ball, more = divmod(radius, segments)
    if ball > 1:
        raise ValueError("use more segments: balls of more than one bit are not enumerated")
    width = BITS // segments
    tables, probes = [], []
    for s in range(segments):
        wide = width if s < segments - 1 else BITS - width * s
        mask = (1 << wide) - 1 if wide < BITS else -1
        key = F.shiftrightunsigned(F.col("fp"), width * s).bitwiseAND(F.lit(mask))
        reach = ball if s <= more else ball - 1
        if reach < 0:
            continue
        tables.append(F.struct(F.lit(s).alias("s"), key.alias("key")))
        probes.append(F.array(F.struct(F.lit(s).alias("s"), key.alias("key"), F.lit(False).alias("flip"))))
        if reach == 1:
            probes.append(_flipped(key, s, wide))
    table = fps.select("fp", "id", F.explode(F.array(*tables)).alias("t")).select(F.col("t.s").alias("s"), F.col("t.key").alias("key"), F.col("fp").alias("fp_t"), F.col("id").alias("v"))
    probe = fps.select("fp", "id", F.explode(F.concat(*probes)).alias("p")).select(F.col("p.s").alias("s"), F.col("p.key").alias("key"), F.col("p.flip").alias("flip"), "fp", F.col("id").alias("u"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_t"))) <= radius
    return probe.join(table, (probe.s == table.s) & (probe.key == table.key) & near & (F.col("flip") | (F.col("fp") < F.col("fp_t"))) & (F.col("fp") != F.col("fp_t"))).select("u", "v")


def near_duplicates(docs: DataFrame, radius: int = 2, segments: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows appear as often as they
    came; rows without doc_id are kept, with the component of their fingerprint. Further columns are ignored.
    """
    fps = staged(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    component = connected_components(links(nodes.where("id is not null"), radius, segments))
    of = nodes.join(component, nodes.id == component.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of every component of near copies, that of the smallest doc_id.

    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more. Texts that near_duplicates would link, with
    fingerprints of 2 or fewer differing bits, are checked for it, and those that it can't reach are found by MinHash.

    A row goes by its doc_id and its text. Rows without doc_id stay and take nobody away. Of one doc_id on rows with
    different texts, each text is judged by itself; if such texts are near copies of each other, one of them stays. Rows
    that repeat the doc_id and the text that stay all stay.
    """
    return without(docs, near_copies(docs, simhash_of, links), text_mark())
