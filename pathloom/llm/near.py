"""Near copies by fingerprints, and beyond their reach by the overlap of word shingles.

Candidates come first from the SimHash that the caller names. Alike texts that its radius can't reach are candidates by
MinHash bands. An exact check of every candidate pair follows.

Texts of one bucket that the bucket's smallest doesn't link are paired by their rarest shingles, with all shingles in one
order of frequency: of two alike texts, the first shingle that they share stands so early in both that enough of either
follows it. So a text is looked up by few of its shingles, and by those only where the other's size and place leave room
for the overlap. Texts around a common passage of which each has too much of its own share nothing that early, and no
pair of them is made, however many there are.

Shingles are compared by 64 bits of XXH64; two different ones of a pair's texts agree with a chance of about 10 ** -13.

A 64-bit SimHash alone is too short for this rule: a Jaccard similarity of 0.8 is about 10 of 64 bits, with a spread that
asks for a radius near 19, and segments for such a radius are three bits wide, so nearly all pairs would be candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches, staged
from pathloom.llm.graph import star_forest

#: Words per shingle and least similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of so many minima each: a pair at similarity s is a candidate with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9999 at 0.8.
BANDS, ROWS = 24, 5
BLOCK = 1 << 11
#: A shingle with this share of all shared ones' rows or more is frequent; there are at most so many.
SHARE = 10_000
NODE = "struct<id: bigint, mark: bigint>"
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> set[bytes]:
    """All runs of SHINGLE words; a shorter text is one shingle, and one without words has none."""
    if not words:
        return set()
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return {joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist())}


def band_keys(own: set[bytes]) -> list[int]:
    """One key per band, or none for a text without words."""
    if not own:
        return []
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(s, 42) for s in own), dtype=np.uint64, count=len(own))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), BLOCK):
        np.minimum(least, (values[None, at : at + BLOCK] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([digest(bands[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def text_mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, fingerprint: Callable[[list[bytes]], int]) -> DataFrame:
    """(doc_id, mark, digest of the words, fp, keys) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys = [], [], []
            for t in batch.column(2):
                words = _words(t.as_py())
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                prints.append(fingerprint(words))
                keys.append(band_keys(shingles(words)))
            fps = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), fps, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "digest", "fp", "keys"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, mark long, digest binary, fp long, keys array<long>")


def hashed_shingles(texts: DataFrame) -> DataFrame:
    """(node, tokens) of (node, text): the hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in shingles(_words(t.as_py()))), dtype=np.uint64).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])

    return texts.select("node", "text").mapInArrow(run, f"node {NODE}, tokens array<long>")


def rarest(hashed: DataFrame) -> DataFrame:
    """(node, size, token, rank, prev): of each text's shingles the rarest m - ceil(SIMILAR * m) + 1, less those no other text has.

    Frequencies are those in hashed. Shingles of a SHARE-th of all or more, at most SHARE of them, are looked up by
    broadcast, so that no task gets a frequent one's rows.
    """
    tokens = hashed.select("node", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    often = staged(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, cold = often.where(F.col("n") * SHARE >= total), often.where(F.col("n") * SHARE < total)
    rows = tokens.join(F.broadcast(hot), "token").unionByName(tokens.join(F.broadcast(hot), "token", "left_anti").join(cold, "token"))
    # Shingles of one text alone come first in the order and need no rows: size less the shared ones counts them.
    of_text = W.partitionBy("node")
    ranked = rows.withColumn("rank", F.row_number().over(of_text.orderBy("n", "token")) + F.col("size") - F.count("*").over(of_text)).withColumn("prev", F.lag("token").over(of_text.orderBy("n", "token")))
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * SIMILAR - 1e-9) + 1).select("node", "size", "token", "rank", "prev")


def alike_pairs(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose shingles are SIMILAR or more; hashed: (node, tokens), one row per node.

    A node of very many pairs is one row of one side of a plain join, so Spark can split the other.
    """
    of_v = pairs.join(hashed.select(F.col("node").alias("v"), F.col("tokens").alias("tokens_v")), "v")
    both = of_v.join(hashed.select(F.col("node").alias("u"), F.col("tokens").alias("tokens_u")), "u")
    fits = F.least(F.size("tokens_u"), F.size("tokens_v")) + 1e-9 >= F.greatest(F.size("tokens_u"), F.size("tokens_v")) * SIMILAR
    shared = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return both.where(fits).where(shared + 1e-9 >= (F.size("tokens_u") + F.size("tokens_v") - shared) * SIMILAR).select("u", "v")


def rare_pairs(members: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v) of members (node, label) with different labels whose first shared shingle leaves room for enough overlap.

    own: what rarest() says of them. Two texts of a and b shingles need an overlap of SIMILAR / (1 + SIMILAR) * (a + b).
    After a shingle at place i of a text of a, a - i follow. The smaller text of a pair stands in the index by the places
    that leave room for a partner of its own size, the larger one looks it up. Where both have the same shingle before,
    that one is shared as well and leaves more room, so a pair is made once for each run of shingles that they share.
    """
    share = SIMILAR / (1 + SIMILAR)
    rows = own.join(members, "node")
    room = lambda x: F.col(f"size_{x}") - F.col(f"rank_{x}") + 1 + 1e-9
    u, v = (rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "rank", "prev"))) for x in "uv")
    index = v.where(room("v") >= 2 * share * F.col("size_v"))
    asked = u.join(index.select("token").distinct(), "token", "left_semi")
    needed = share * (F.col("size_u") + F.col("size_v"))
    order = F.expr("label_u <> label_v and (size_v < size_u or (size_v = size_u and node_v < node_u))")
    fits = order & (F.col("size_v") + 1e-9 >= F.col("size_u") * SIMILAR) & (room("u") >= needed) & (room("v") >= needed)
    pairs = asked.join(index, "token").where(fits & ~F.coalesce(F.col("prev_u") == F.col("prev_v"), F.lit(False)))
    return pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def central(members: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v): the most common text of each bucket of members (key, node, label), with those of other labels in it.

    Most common is the one whose shared shingles begin earliest in its order, so that the fewest are its own. Most of a
    group of near copies is alike to such a text, whichever of them has the smallest id.
    """
    begins = own.groupBy("node").agg((F.min("rank") / F.first("size")).alias("begins"))
    told = members.join(begins, "node")
    best = told.groupBy("key").agg(F.min(F.struct("begins", "node", "label")).alias("x")).select("key", F.col("x.node").alias("center"), F.col("x.label").alias("its"))
    pairs = members.join(best, "key").where("label <> its")
    return pairs.select(F.least("center", "node").alias("u"), F.greatest("center", "node").alias("v")).distinct()


def printed_pairs(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) of nodes (node, fp): each with the smallest of its fingerprint, and these by links between fingerprints."""
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("id")), "fingerprints")
    same = nodes.join(prints, "fp").where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    near = links(prints).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return same.union(near).distinct()


def near_copies(docs: DataFrame, fingerprint: Callable[[list[bytes]], int], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, mark) of the rows that go: all of a component of near copies but the smallest (doc_id, mark).

    fingerprint is a text's by its words, links gives the pairs (u, v) of (fp, id) that are linked; see simhash. Texts of
    the same words after lower-casing A-Z are one node, named by its smallest (doc_id, mark). Nodes whose fingerprints link
    are checked; what follows adds the alike texts that fingerprints miss. Every member of a
    bucket is compared with the bucket's smallest, and where that leaves several components, with its most common text.
    The members of buckets that still hold several are then compared with all members of other components that may be
    alike by their rarest shingles, so a large group of near copies needs no pairs, texts around a common passage give
    none, and no two alike texts go unchecked.
    """
    rows = staged(signatures(docs.where("doc_id is not null"), fingerprint), "signatures")
    nodes = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), "mark")).alias("node"), F.max("fp").alias("fp"), F.max("keys").alias("keys"))
    nodes = staged(nodes, "distinct-words")
    in_bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = in_bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    members = staged(in_bands.join(shared, "key"), "buckets")
    printed = staged(printed_pairs(nodes, links), "printed-pairs")
    candidates = members.select("node").union(printed.select("u")).union(printed.select("v")).distinct()
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.col("text").cast("string").alias("text"))
    texts = wanted.join(candidates, (F.col("doc_id") == F.col("node.id")) & (F.col("mark") == F.col("node.mark"))).select("node", "text")
    hashed = staged(hashed_shingles(texts).dropDuplicates(["node"]), "shingles")  # equal rows give equal shingles
    stars = members.select(F.col("first").alias("u"), F.col("node").alias("v")).where("u <> v").union(printed).distinct()
    found = star_forest(alike_pairs(stars, hashed))  # what comes later is added to these, not to all pairs

    def labels() -> DataFrame:
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def mixed() -> DataFrame:
        """The members, with labels, of buckets that hold several components."""
        named = members.join(labels(), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
        return staged(named.join(several, "key"), "open-buckets")

    left = mixed()
    own = staged(rarest(hashed.join(left.select("node").distinct(), "node", "left_semi")), "rarest-shingles")
    found = star_forest(found.union(alike_pairs(central(left, own), hashed)))
    left = mixed().select("node", "label").distinct()
    pairs = staged(rare_pairs(left, own).join(stars, ["u", "v"], "left_anti"), "rare-pairs")
    found = star_forest(found.union(alike_pairs(pairs, hashed)))

    of = nodes.join(labels(), "node", "left").select("digest", F.coalesce("component", "node").alias("stays"))
    return rows.join(of, "digest").where(F.struct(F.col("doc_id").alias("id"), "mark") != F.col("stays")).select("doc_id", "mark").distinct()
