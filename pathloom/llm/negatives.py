"""Hard negatives by norm-bucketed search.

Candidates are sorted by label and falling norm and cut into runs of buckets. By the Cauchy-Schwarz inequality no
candidate of a bucket scores more than the anchor's norm times the bucket's largest norm, so a bucket (and, before any
vector moves, a whole run) is skipped for an anchor when that is under what the anchor still asks for: its window's
lower limit, or its running kth score. The runs with each label's largest norms are searched first; what they give is
the running score that all others start from.

Anchors are dealt into blocks; a block meets a run in one group of bounded size, as one product of two matrices. Scores
are sums of integers and exact: in 64-bit floats where all sums fit 53 bits, in Python's integers where they may not.
A score beyond 63 bits counts as the largest number of its sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches, staged

BUCKET, RUN, BLOCK = 512, 1 << 13, 512
RUN_BYTES = 8 << 20
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 2
FOUND = "anchor long, slot int, score long, id long"


def components(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles; those of 2 to the 53rd and more are whole as they are."""
    wide = lambda x: x.cast("double") * F.lit(float(scale))
    return F.transform(embedding, lambda x: F.when(F.abs(wide(x)) < EXACT, F.floor(wide(x)).cast("double")).otherwise(wide(x)))


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, norm) of the distinct rows that take part: no null, and no component that isn't finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where("vec_id is not null and label is not null and embedding is not null")
    parts = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), components(F.col("embedding"), scale).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    return parts.where(finite).distinct().withColumn("norm", norm)


def _packed(vectors: list[np.ndarray]) -> tuple[bytes, int, str]:
    """The rows of a matrix in the smallest exact type, shorter ones with zeros at their ends; its width and type."""
    width = max(map(len, vectors))
    matrix = np.zeros((len(vectors), width))
    for row, v in zip(matrix, vectors):
        row[: len(v)] = v
    kind = "<i2" if np.abs(matrix).max(initial=0) < 1 << 15 else "<f8"
    return matrix.astype(kind).tobytes(), width, kind


def runs_of(vectors: DataFrame) -> DataFrame:
    """(run, label, top, ids, norms, matrix, width, kind): candidates by label and falling norm, up to RUN in a run."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, norms = np.array([r[1] for r in rows], "<i8"), np.array([r[2] for r in rows])
            matrix, width, kind = _packed([r[3] for r in rows])
            return pa.RecordBatch.from_pylist([{"run": base + seq, "label": rows[0][0], "top": float(norms.max()), "ids": ids.tobytes(), "norms": norms.tobytes(), "matrix": matrix, "width": width, "kind": kind}], schema=schema)

        schema = pa.schema([("run", pa.int64()), ("label", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("norms", pa.binary()), ("matrix", pa.binary()), ("width", pa.int32()), ("kind", pa.string())])
        size = 0
        for batch in batches:
            for label, vec, norm, v in zip(*(batch.column(i).to_pylist() for i in range(3)), (x.values.to_numpy(zero_copy_only=False) for x in batch.column(3))):
                if rows and (rows[0][0] != label or len(rows) == RUN or size + 8 * len(v) > RUN_BYTES):
                    yield flush()
                    rows, size, seq = [], 0, seq + 1
                rows.append((label, vec, norm, np.array(v)))
                size += 8 * len(v)
        if rows:
            yield flush()

    small_batches(vectors.sparkSession)
    order = [F.asc("label"), F.desc("norm"), F.asc("vec_id")]
    ordered = vectors.select("label", "vec_id", "norm", "v").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(pack, "run long, label long, top double, ids binary, norms binary, matrix binary, width int, kind string")


def _products(a: list[np.ndarray], norms: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of a with rows of b as 64-bit integers; a shorter row counts as ending in zeros."""
    left = np.zeros((len(a), b.shape[1]))
    for row, v in zip(left, a):
        row[: len(v)] = v[: len(row)]
    if norms.max(initial=0) * most * (1 + 1e-9) < EXACT:
        return (left @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(left) @ whole(b).T, -LARGEST, LARGEST).astype(np.int64)


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each slot, by slot: larger scores, then smaller ids."""
    order = np.lexsort((ids, -score, slot))
    by = slot[order]
    start = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return order[rank < k]


class Block:
    """What a block of anchors asks for: per slot its anchor, least and most score, and the best k found so far."""

    def __init__(self, anchors: pd.DataFrame, k: int) -> None:
        slots = [(i, x["slot"], x["least"], x["most"], x["kth"], x["kth_id"]) for i, asked in enumerate(anchors.asked) for x in asked]
        self.owner, self.slot, self.least, self.most, self.kth, self.kth_id = (np.array(x, dtype=np.int64) for x in zip(*slots))
        self.k, self.vectors, self.norms = k, [np.asarray(v, dtype=float) for v in anchors.v], anchors.norm.to_numpy()
        self.labels, self.own, self.anchor = anchors.label.to_numpy(), anchors.vec_id.to_numpy(), anchors.anchor.to_numpy()[self.owner]
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))

    def search(self, label: int, ids: np.ndarray, matrix: np.ndarray, norms: np.ndarray, same: bool) -> None:
        """Takes in a bucket of candidates of one label."""
        reach = self.norms[self.owner] * norms.max() * (1 + 1e-9) + 1e-9
        counts = (self.labels == label) == same
        live = np.flatnonzero((reach >= np.maximum(self.least, self.kth)) & counts[self.owner])
        if not len(live):
            return
        used, at = np.unique(self.owner[live], return_inverse=True)
        scores = _products([self.vectors[i] for i in used], self.norms[used], matrix, norms.max())[at]
        least, most, kth, kth_id, own = (x[live][:, None] for x in (self.least, self.most, self.kth, self.kth_id, self.own[self.owner]))
        good = (scores >= np.maximum(least, kth)) & (scores <= most)
        good &= ((scores > kth) | (ids < kth_id)) & (ids != own)
        row, column = np.nonzero(good)
        if not len(row):
            return
        slot, score, vec = (np.concatenate(x) for x in zip(self.held, (live[row], scores[row, column], ids[column])))
        keep = _best(slot, score, vec, self.k)
        self.held = slot, score, vec = slot[keep], score[keep], vec[keep]
        # A slot whose k are full asks for what beats the last of them, or what it was told at first if that is better.
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        last = last[np.diff(np.append(-1, last)) >= self.k]
        s = slot[last]
        better = (score[last] > self.kth[s]) | ((score[last] == self.kth[s]) & (vec[last] < self.kth_id[s]))
        self.kth[s[better]], self.kth_id[s[better]] = score[last][better], vec[last][better]


def searched(anchors: DataFrame, runs: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id): the best k of each slot within every run, less what can't be among the best k of all.

    anchors: (anchor, block, vec_id, label, v, norm, asked), asked an array of (slot, least, most, kth, kth_id). Only runs
    of the anchor's label count (same), or only those of others. A block and a run meet only if one of the block's anchors
    may find what it asks for in the run.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"anchor": [], "slot": [], "score": [], "id": []})
        out = Block(left, k)
        for r in right.itertuples():
            ids, norms = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.norms)
            matrix = np.frombuffer(r.matrix, r.kind).reshape(len(ids), r.width).astype(float)
            for at in range(0, len(ids), BUCKET):
                here = slice(at, at + BUCKET)
                out.search(r.label, ids[here], matrix[here], norms[here], same)
        slot, score, vec = out.held
        return pd.DataFrame({"anchor": out.anchor[slot], "slot": out.slot[slot], "score": score, "id": vec})

    blocks = anchors.agg(F.max("block")).first()[0]
    if blocks is None:
        return anchors.sparkSession.createDataFrame([], FOUND)
    need = F.array_min(F.transform("asked", lambda x: F.greatest(x.least, x.kth))).cast("double")
    # The largest norm that a run must have for an anchor; no run is too short for one that asks for zero or less.
    asks = F.when(need <= 0, 0.0).otherwise(need / F.greatest("norm", F.lit(1e-12)))
    of_block = anchors.groupBy("block").agg(F.min(asks).alias("asks"), F.collect_set("label").alias("labels"))
    pairs = runs.select("run", "label", "top", F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block")).join(of_block, "block")
    fits = F.array_contains("labels", F.col("label")) if same else (F.size("labels") > 1) | ~F.array_contains("labels", F.col("label"))
    pairs = staged(pairs.where(fits & (F.col("top") * (1 + 1e-9) + 1e-9 >= F.col("asks"))).select("block", "run"), "negatives-pairs")
    left, right = anchors.join(pairs, "block").groupBy("block", "run"), runs.join(pairs, "run").groupBy("block", "run")
    return left.cogroup(right).applyInPandas(meet, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(anchors: DataFrame, runs: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, rank): the best k of each slot, first among each label's largest norms, then among all others."""
    of_label = W.partitionBy("label").orderBy(F.desc("top"), "run")
    placed = runs.join(runs.select("run", F.row_number().over(of_label).alias("_place")), "run")
    first = staged(_top(searched(anchors, placed.where("_place = 1"), k, same), k), "negatives-first")
    full = first.where(F.col("rank") == k).select("anchor", F.struct("slot", F.struct("score", "id").alias("last")).alias("x"))
    told = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list("x")).alias("_told"))
    told_of = lambda x, name, none: F.coalesce(F.col("_told")[x.slot][name], none).alias({"score": "kth", "id": "kth_id"}[name])
    asked = F.transform("asked", lambda x: F.struct(x.slot.alias("slot"), x.least.alias("least"), x.most.alias("most"), told_of(x, "score", x.kth), told_of(x, "id", x.kth_id)))
    rest = searched(anchors.join(told, "anchor", "left").withColumn("asked", asked), placed.where("_place > 1"), k, same)
    return _top(first.drop("rank").unionByName(rest), k)


def _asked(slot: Column, least: Column, most: Column) -> Column:
    of = lambda c, name: c.cast("long").alias(name)
    return F.struct(of(slot, "slot"), of(least, "least"), of(most, "most"), of(F.lit(-LARGEST - 1), "kth"), of(F.lit(LARGEST), "kth_id"))


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, embedding).

    A score is the inner product of the vectors whose components are floor(scale * x). Of each anchor (is_anchor, over
    vec_id and label) the positives best rows of its label are its positives; of each the negatives best rows of other
    labels whose score is from low to high hundredths of the positive's are returned. Ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. Rows that repeat
    wholly count once; of a vec_id on different rows each is a row of its own, and none is its own positive or negative.
    A shorter vector counts as ending in zeros. An anchor without positives, or a positive without negatives, has no row.
    """
    vectors = staged(usable(rows, scale), "negatives-vectors")
    runs = staged(runs_of(vectors), "negatives-runs")
    anchors = vectors.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id())
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int")
    anchors = staged(anchors.withColumn("block", block), "negatives-anchors")

    every = F.array(_asked(F.lit(0), F.lit(-LARGEST), F.lit(LARGEST)))
    found = staged(search(anchors.withColumn("asked", every), runs, positives, same=True), "negatives-positives")
    least, most = F.expr(f"cast(ceil(cast(score as decimal(38,0)) * {low} / 100) as long)"), F.expr(f"cast(floor(cast(score as decimal(38,0)) * {high} / 100) as long)")
    asked = found.select("anchor", _asked(F.col("rank"), least, most).alias("x")).where("x.least <= x.most")
    windows = asked.groupBy("anchor").agg(F.collect_list("x").alias("asked"))
    negative = search(anchors.join(windows, "anchor"), runs, negatives, same=False)
    pairs = negative.select("anchor", F.col("slot").alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = found.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(positive, ["anchor", "of"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
