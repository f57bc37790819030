"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

A queue is a source's documents in ascending doc_id. In every round each queue's deficit grows by its quantum, its
target share of a window; it sends whole packets while its deficit covers them, and what is left of the deficit is
carried to the next round, over windows and partitions alike. A round sends about a window, so every window meets the
target proportions to within a packet or so of each source. A queue that runs dry leaves; the others keep their quanta,
so their shares among each other stay.

After how many rounds a token is sent depends on its place in its queue, its quantum and nothing else, so rounds are
computed where the documents are. Only numbers are ordered and added up to find places in the stream (running sums over
ranges); ids are moved once, to meet the places of their document, and cut there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches, staged, text_or_empty
from pathloom.llm.tokens import encoder, tokenizer_path

END_ID = 2
#: Tokens of a window and of a packet; quanta and deficits are counted in parts of a token.
WINDOW, PACKET, PARTS = 4096, 64, 1 << 16
#: Rounds whose sizes are added up together.
ROUNDS = 1024


def encoded(docs: DataFrame, tokenizer: str, pieces: str, end_id: int) -> DataFrame:
    """(part, row, queue, doc_id, n, crc, ids) of every row of docs; part and row name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = encoder(tokenizer, pieces).encode_with_end(batch.column(2), end_id)
            ends = np.concatenate(([0], np.cumsum(counts)))
            data = np.asarray(ids, dtype="<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(np.arange(row, row + len(counts))),
                    batch.column(1),
                    batch.column(0),
                    pa.array(counts.astype(np.int64)),
                    pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                ],
                names=["part", "row", "queue", "doc_id", "n", "crc", "ids"],
            )
            row += len(counts)

    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "part int, row long, queue string, doc_id long, n long, crc long, ids array<int>")


def queued(rows: DataFrame) -> DataFrame:
    """(part, row, queue, begin, n, total): where each document begins in its queue, and the queue's tokens.

    Ranges of (queue, doc_id) are summed up apart; a queue's sum is then carried from range to range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            starts = []
            for queue, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                before = before if queue == last else 0
                starts.append(before)
                before, last = before + n, queue
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(starts), at, np.int32)), pa.array(starts, pa.int64())], names=["part", "row", "queue", "n", "range", "range_start"])

    order = ["queue", "doc_id", "n", "crc", "part", "row"]
    ranges = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "queue", "n")
    ranges = staged(ranges.mapInArrow(run, "part int, row long, queue string, n long, range int, range_start long"), "packing-queues")
    sums = ranges.groupBy("queue", "range").agg(F.sum("n").alias("s"))
    by = W.partitionBy("queue").orderBy("range")
    before = F.coalesce(F.sum("s").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("queue", "range", before.alias("base"), F.sum("s").over(W.partitionBy("queue")).alias("total"))
    return ranges.join(bases, ["queue", "range"]).select("part", "row", "queue", (F.col("base") + F.col("range_start")).alias("begin"), "n", "total")


def quantum(share: Column, window: int = WINDOW) -> Column:
    """What a queue's deficit grows by in a round, in parts of a token."""
    return F.greatest(F.lit(1), F.rint(share * window * PARTS)).cast("long")


def turns_of(begin: np.ndarray, n: np.ndarray, total: np.ndarray, quanta: np.ndarray, packet: int = PACKET) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, round, start in the queue, length): the turns of deficit round-robin in which documents are sent.

    Packet k is sent in the first round after which the deficits of all rounds together cover it and those before it.
    """
    first = begin // packet
    many = (begin + n - 1) // packet - first + 1
    own = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[own]
    low, high = np.maximum(begin[own], k * packet), np.minimum(begin[own] + n[own], (k + 1) * packet)
    turn = -(-np.minimum((k + 1) * packet, total[own]) * PARTS // quanta[own])
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (turn[1:] != turn[:-1])))) if len(own) else own
    return own[head], turn[head], low[head], np.add.reduceat(high - low, head) if len(head) else low


def turns(places: DataFrame, packet: int) -> DataFrame:
    """(part, row, queue, round, at, start, length) of queued documents with their quanta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n, total, quanta = (np.asarray(batch.column(i), dtype=np.int64) for i in (3, 4, 5, 6))
            own, turn, at, length = turns_of(begin, n, total, quanta, packet)
            for a in range(0, len(own), 50_000):
                b = slice(a, a + 50_000)
                here = pa.array(own[b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(here) for i in range(3)), pa.array(turn[b]), pa.array(at[b]), pa.array(at[b] - begin[own[b]]), pa.array(length[b])],
                    names=["part", "row", "queue", "round", "at", "start", "length"],
                )

    return places.select("part", "row", "queue", "begin", "n", "total", "quantum").mapInArrow(run, "part int, row long, queue string, round long, at long, start long, length long")


def placed(sent: DataFrame) -> DataFrame:
    """(part, row, start, length, place) of turns: their places in the stream of all rounds, queues in order of name."""
    sizes = sent.groupBy("round").agg(F.sum("length").alias("size")).withColumn("block", F.floor(F.col("round") / ROUNDS))
    blocks = sizes.groupBy("block").agg(F.sum("size").alias("s"))
    before = lambda c, by: F.coalesce(F.sum(c).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before("s", W.orderBy("block")).alias("base"))  # one row for ROUNDS windows
    bases = sizes.join(blocks, "block").select("round", (F.col("base") + before("size", W.partitionBy("block").orderBy("round"))).alias("base"))
    inside = before("length", W.partitionBy("round").orderBy("queue", "at"))
    return sent.withColumn("inside", inside).join(bases, "round").select("part", "row", "start", "length", (F.col("base") + F.col("inside")).alias("place"))


class Sequences:
    """Where sequences begin: full windows, then powers of two for the rest, which need no padding."""

    def __init__(self, total: int, window: int) -> None:
        self.window, self.full = window, total // window * window
        tail, edges = total - self.full, [self.full]
        while tail:
            step = 1 << (tail.bit_length() - 1)
            edges.append(edges[-1] + step)
            tail -= step
        self.edges = np.array(edges, dtype=np.int64)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset in it, room to its end) of each place."""
        tail = np.clip(np.searchsorted(self.edges, at, side="right") - 1, 0, max(0, len(self.edges) - 2))
        in_tail = at >= self.full
        sequence = np.where(in_tail, self.full // self.window + tail, at // self.window)
        begin = np.where(in_tail, self.edges[tail], sequence * self.window)
        end = np.where(in_tail, self.edges[np.minimum(tail + 1, len(self.edges) - 1)], begin + self.window)
        return sequence, at - begin, end - at

    def pieces(self, own: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of documents' turns, cut where sequences end and joined where they go on."""
        order = np.lexsort((start, own))
        own, start, length, place = own[order], start[order], length[order], place[order]
        on = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + length[:-1])))) if len(own) else own
        own, start, place, length = own[on], start[on], place[on], np.add.reduceat(length, on) if len(on) else length
        done = []
        while len(start) or not done:
            sequence, offset, room = self.of(place)
            now = np.minimum(length, room)
            done.append((own, start, now, sequence, offset))
            more = length > room
            own, start, length, place = own[more], (start + now)[more], (length - now)[more], (place + now)[more]
        own, start, length, sequence, offset = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((start, own))
        return own[order], start[order], length[order], sequence[order], offset[order]


PIECES = "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, pieces: str = "text", end_id: int = END_ID, weights: dict[str, float] | None = None, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """Pieces of all documents: doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    weights: target proportions of sources (1 if not named). None targets the proportions of docs themselves, so that
    all queues end together and every window looks like the whole. Every id is in one piece; all sequences are full up
    to window, the rest fills powers of two. The result doesn't depend on how docs is stored. Null texts are empty and
    give the end id alone; a null source is the queue "". Rows that repeat are packed as often as they came; rows
    without doc_id come first in their queue. Further columns are ignored. An empty table gives an empty result.
    """
    rows = staged(encoded(docs, tokenizer, pieces, end_id), "packing-ids")
    places = queued(rows)
    if weights is None:
        weight = F.col("total").cast("double")
    else:
        weight = F.lit(1.0)
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("queue") == name, float(w)).otherwise(weight)
    by_queue = rows.groupBy("queue").agg(F.sum("n").alias("total"))
    total, every = by_queue.agg(F.sum("total"), F.sum(weight)).first()
    sequences = Sequences(int(total or 0), window)
    sent = staged(turns(places.withColumn("quantum", quantum(weight / F.lit(float(every or 1)), window)), packet), "packing-turns")
    lists = placed(sent).groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "place")).alias("turns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.asarray(batch.column(3).values, dtype="<u4"), np.asarray(batch.column(3).offsets, dtype=np.int64)
            sent, ends = batch.column(4).values, np.asarray(batch.column(4).offsets, dtype=np.int64)
            columns = [np.asarray(sent.field(i), dtype=np.int64)[ends[0] : ends[-1]] for i in range(3)]
            own, start, length, sequence, offset = sequences.pieces(np.repeat(np.arange(batch.num_rows), np.diff(ends)), *columns)
            n = np.asarray(batch.column(2), dtype=np.int64)
            low = (at[own] + start).tolist()
            data = pa.array([ids[x : x + m].tobytes() for x, m in zip(low, length.tolist())], pa.binary())
            out = [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), *map(pa.array, (start, length, n[own], sequence, offset)), data]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in PIECES.split(", ")])

    return rows.join(lists, ["part", "row"]).select("doc_id", "queue", "n", "ids", "turns").mapInArrow(cut, PIECES)


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "word"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all of docs as the query does; nulls, empty texts and repeated rows as in pack()."""
    return digested(pack(docs, tokenizer_path("word_bpe_49k.json"), "word"))
