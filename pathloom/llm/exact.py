"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests of what was accepted before are dealt to shards of bounded size. Each shard is a minimal perfect
hash by hash and displace: a seed per small bucket sends its digests to free slots, and as many slots as digests hold
the full digest, the winner and its count. A later batch looks its distinct digests up; the bytes in the slot decide,
because a minimal perfect hash answers for nonmembers too. Nonmembers are grouped by themselves.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import documents, lower_ascii, staged, text_or_empty, without

SHARD = 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each digest (rows of 32 bytes) that pick its bucket and its slot."""
    w = np.ascontiguousarray(digests).view("<u8")
    return _mix(w[:, 1] ^ GOLD), w[:, 2] ^ w[:, 3]


def _slots(key: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (_mix(key + (seed.astype(np.uint64) + np.uint64(1)) * GOLD) % np.uint64(n)).astype(np.int64)


def build_mph(digests: np.ndarray, per_bucket: int = 4, tries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each digest) of a minimal perfect hash over distinct digests, an (n, 32) array of bytes.

    A bucket's seed >= 0 displaces its digests; a bucket of one digest stores its slot s as -s - 1.
    """
    n = len(digests)
    buckets = max(1, ceil(n / per_bucket))
    pick, key = _words(digests)
    bucket = (pick % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(counts) - counts
    seeds, slot, free = np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for b in np.argsort(-counts, kind="stable"):
        own = order[starts[b] : starts[b] + counts[b]]
        if len(own) < 2:
            break
        at = 0
        while True:
            trial = _slots(key[own][None, :], np.arange(at, at + tries)[:, None], n)
            ordered = np.sort(trial, axis=1)
            good = free[trial].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                hit = int(np.argmax(good))
                seeds[b], slot[own] = at + hit, trial[hit]
                free[trial[hit]] = False
                break
            at += tries
    single = np.flatnonzero(counts == 1)
    left = np.flatnonzero(free)
    seeds[single] = -left - 1
    slot[order[starts[single]]] = left
    return seeds, slot


def lookup_mph(seeds: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """The slot of each digest; of a nonmember, any slot."""
    pick, key = _words(digests)
    seed = seeds[(pick % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, _slots(key, np.maximum(seed, 0), n))


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(shard["digest"])
    seeds, slot = build_mph(digests)
    at = np.argsort(slot)
    ids, sizes = shard["keep_id"].astype("Int64").array, shard["n"].to_numpy()
    return pd.DataFrame(
        {
            "shard": [shard["shard"].iloc[0]],
            "seeds": [seeds.tobytes()],
            "slots": [digests[at].tobytes()],
            "winners": [[None if pd.isna(ids[i]) else int(ids[i]) for i in at]],
            "sizes": [sizes[at].tolist()],
        }
    )


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of history with what the batch adds to them, and the batch's own groups."""
    parts, member = [], np.zeros(len(new), dtype=bool)
    if len(index):
        slots = np.frombuffer(index["slots"].iloc[0], dtype=np.uint8).reshape(-1, 32)
        size = np.array(index["sizes"].iloc[0], dtype=np.int64)
        if len(new):
            digests = _matrix(new["digest"])
            slot = lookup_mph(np.frombuffer(index["seeds"].iloc[0], dtype=np.int64), len(slots), digests)
            member = (slots[slot] == digests).all(axis=1)
            np.add.at(size, slot[member], new["n"].to_numpy()[member])
        parts.append(pd.DataFrame({"digest": [s.tobytes() for s in slots], "keep_id": pd.Series(list(index["winners"].iloc[0]), dtype="Int64"), "n": size}))
    parts.append(new.loc[~member, ["digest", "keep_id", "n"]].astype({"keep_id": "Int64"}))
    return pd.concat([p for p in parts if len(p)] or parts[:1])


def _groups(digests: DataFrame, shards: int | None) -> DataFrame:
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return groups if shards is None else groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def mph_index(history: DataFrame) -> tuple[DataFrame, int]:
    """The staged index of history (doc_id, digest binary) and its number of shards, about SHARD digests each."""
    groups = staged(_groups(history, None), "history")
    shards = max(1, ceil(groups.count() / SHARD))
    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    built = dealt.groupBy("shard").applyInPandas(_build, "shard long, seeds binary, slots binary, winners array<long>, sizes array<long>")
    return staged(built, "perfect-hash"), shards


def classes(history: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest, keep_id, n) of every distinct digest in history or batch; a member's winner is history's."""
    index, shards = mph_index(history)
    new = _groups(batch, shards)
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, "digest binary, keep_id long, n long")


def text_digest() -> Column:
    return F.unhex(F.sha2(lower_ascii(text_or_empty()), 256))


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


def exact_duplicates(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per row of history and batch: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. A text that history has keeps history's
    largest doc_id; one that only the batch has keeps the batch's. Rows without doc_id never win over rows with one.
    Rows that repeat a winner's doc_id and text are all marked as kept: they are one document.
    """
    before, after = with_digest(history), with_digest(batch)
    of = classes(before, after)
    return before.union(after).join(of, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def two_snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as an earlier snapshot (upper half of the id range, whose ids win) and the batch that came after it."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    upper = F.coalesce(F.col("doc_id") > ((low or 0) + (high or 0)) // 2, F.lit(False))
    return docs.where(upper), docs.where(~upper)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(*two_snapshots(documents(spark, sf_dir)))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest doc_id.

    A row goes by its doc_id and its text. Of rows without doc_id, those go whose text a row with doc_id has too; those
    whose text no such row has all stay. A doc_id on rows with different texts is judged for each text by itself.
    """
    found = exact_duplicates(*two_snapshots(docs))
    return without(docs, found.where(~F.col("kept")).select("doc_id", F.unhex("text_sha256").alias("mark")).distinct(), text_digest())
