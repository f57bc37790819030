"""Removal of long repeated byte strings by longest-previous-factor arrays over anchored contexts.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier in the corpus. Every such string holds an
anchor, the KGRAM-byte string of least hash in it, and equal strings hold the same anchor at the same place. So only
strings around one anchor can be equal, and the context of an anchor (all LENGTH-byte strings that hold it) is all
that is compared:

1. Contexts of the same bytes (by 128 bits of BLAKE2) are repeats throughout, but for the earliest. Repeats within a
   batch of documents never leave it, so groups of copies are small before they are shuffled.
2. Of anchors with several different contexts, the earliest of each context is cut from its text and suffix-sorted
   together with the others. Previous and next smaller text positions in suffix order, with what they share, give each
   string's longest previous factor; LENGTH bytes or more are an earlier match.

Anchors with many different contexts are split before that, however common they are: the strings of a context fall
into ranges by where they have the anchor, and all strings of a range share more bytes than the anchor. These longer
shared bytes are the key of the next round, whose groups are smaller; in the last round a range is one string and a
group is one text. Anchors that are common in single batches are found in a first pass and dealt out by context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches, staged, text_or_empty

LENGTH, KGRAM = 100, 32
REACH = LENGTH - KGRAM
BLOCK, SEGMENT = 1 << 20, 1 << 20
#: Contexts that are suffix-sorted together at most; more are split by longer shared bytes, in ranges of so many starts.
GROUP, WIDTHS = 1024, (18, 5, 1)
#: An anchor with so many contexts in a batch is counted in the first pass; how many counted ones are dealt out by context.
LOCAL, HEAVY = 8, 1 << 16
#: Shares that the rows of one key are dealt to when they meet their number.
SALTS = 16
FACTOR = 0xD6E8FEB86659FD93
VALUES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(FACTOR)), np.full(n, np.uint64(pow(FACTOR, -1, 2**64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_CACHE = _powers(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _CACHE
    if len(_CACHE[0]) < n:
        _CACHE = _powers(max(n, 2 * len(_CACHE[0])))
    return _CACHE


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every width values in a row."""
    pick = np.minimum if least else np.maximum
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def anchors(text: bytes, ends: np.ndarray, exact: bool = True, kgram: int = KGRAM, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, context digest as two numbers, position, left, right) of all anchors in texts one after the other.

    Digests that aren't exact are quick hashes, for counting only.

    ends: where each text ends. A context is [position - left, position + right) within its text.
    """
    data, reach = np.frombuffer(text, dtype=np.uint8), length - kgram
    n = len(data)
    if n < length:
        return tuple(np.zeros(s, d) for s, d in ((0, np.uint64), ((0, 2), np.uint64), (0, np.int64), (0, np.int64), (0, np.int64)))
    up, down = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[data] * up[:n])))
    hashes = _mix((sums[kgram:] - sums[:-kgram]) * down[: n - kgram + 1])
    sizes = np.diff(ends, prepend=0)
    end = np.repeat(ends, sizes)
    begin = end - np.repeat(sizes, sizes)
    at = np.arange(n - kgram + 1)
    least = _sliding(hashes, reach + 1, True)
    least[at[: len(least)] + length > end[: len(least)]] = 0
    highest = _sliding(np.pad(least, (reach, reach)), reach + 1, False)
    found = np.flatnonzero((hashes == highest[: len(hashes)]) & (at + kgram <= end[: len(hashes)]))
    left = np.minimum(found - begin[found], reach)
    right = np.minimum(end[found] - found, length)
    if not exact:
        quick = _mix((sums[found + right] - sums[found - left]) * down[found - left] + (left * 1000 + right).astype(np.uint64))
        return hashes[found], np.stack([quick, quick], axis=1), found, left, right
    view = memoryview(text)
    digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip((found - left).tolist(), (found + right).tolist())])
    digest = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2).copy()
    digest[:, 0] ^= _mix(left.astype(np.uint64) + GOLD)  # a text that repeats itself may hold an anchor at several places
    return hashes[found], digest, found, left, right


def document_anchors(texts: list[bytes], exact: bool = True) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, context digest, position, left, right) over whole texts; long ones in segments."""
    parts, block, number, size = [], [], [], 0

    def flush() -> None:
        nonlocal block, number, size
        if block:
            ends = np.cumsum([len(b) for b in block])
            got = anchors(b"".join(block), ends, exact)
            own = np.searchsorted(ends, got[2], side="right")
            parts.append((np.array(number)[own], got[0], got[1], got[2] - np.concatenate(([0], ends))[own], got[3], got[4]))
        block, number, size = [], [], 0

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) <= 2 * SEGMENT:
            block.append(text)
            number.append(i)
            size += len(text)
            if size >= BLOCK:
                flush()
            continue
        for a in range(0, len(text), SEGMENT):
            low, high = max(0, a - 2 * LENGTH), min(len(text), a + SEGMENT + 2 * LENGTH)
            h, c, p, left, right = anchors(text[low:high], np.array([high - low]), exact)
            mine = (p + low >= a) & (p + low < a + SEGMENT)
            parts.append((np.full(int(mine.sum()), i), h[mine], c[mine], p[mine] + low, left[mine], right[mine]))
    flush()
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), *anchors(b"", np.zeros(0, np.int64)))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each owner; those that touch become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    span = int(end.max()) + 1
    group = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1])))
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])))
    head = np.flatnonzero(new)
    return owner[head], start[head], np.maximum.reduceat(end, head)


ANCHORS = "state byte, anchor long, context long, more long, doc_id long, position int, head int, tail int"
#: What a row of anchors is: a context, an interval that is known to repeat, or a context of a common anchor.
CONTEXT, KNOWN, COMMON = range(3)


def _batch_anchors(batch: pa.RecordBatch, exact: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor, digest, doc, position, left, right) of a batch (doc_id, text), equal contexts together, earliest first."""
    ids = np.asarray(batch.column(0))
    number, anchor, digest, position, left, right = document_anchors([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], exact)
    doc = ids[number] if len(number) else np.zeros(0, np.int64)
    order = np.lexsort((position, doc, digest[:, 1], digest[:, 0], anchor))
    return tuple(x[order] for x in (anchor, digest, doc, position, left, right))


def _repeats(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1]).all(axis=1)))[: len(anchor)]


def common_anchors(docs: DataFrame, local: int = LOCAL, least: int = GROUP, heavy: int = HEAVY) -> dict[int, int]:
    """Anchors that have local contexts or more in a batch, with the sum of those, of least and more; the heavy most common.

    They only say how rows are dealt to tasks. An anchor that isn't listed has under local contexts in every batch, or
    less than one in heavy of all contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, digest, *_ = _batch_anchors(batch, exact=False)
            found, n = np.unique(anchor[~_repeats(anchor, digest)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= local].view(np.int64)), pa.array(n[n >= local])], names=["anchor", "n"])

    counts = docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.anchor: r.n for r in counts.orderBy(F.desc("n"), "anchor").limit(heavy).collect()}


def _occurrences(common: dict[int, int], group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The earliest occurrence of each context in a batch, and as known repeats the intervals of all others."""
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    often = np.array(sorted(common), dtype=np.int64)
    shares = np.array([max(1, -(-common[a] // group)) for a in often.tolist()], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, digest, doc, position, left, right = _batch_anchors(batch)
            again = _repeats(anchor, digest)
            one = ~again
            owner, start, end = merged(doc[again], (position - left)[again], (position + right)[again])
            anchor, digest = anchor[one], digest[one]
            place = np.searchsorted(often, anchor.view(np.int64))
            is_common = np.zeros(len(anchor), bool)
            if len(often):
                place = np.minimum(place, len(often) - 1)
                is_common = often[place] == anchor.view(np.int64)
                anchor = np.where(is_common, _mix(anchor + digest[:, 0] % shares[place] * GOLD), anchor)
            mark = _mix(owner.astype(np.uint64) * GOLD + start.astype(np.uint64))  # deals the intervals to all tasks
            columns = [
                np.concatenate([np.where(is_common, COMMON, CONTEXT), np.full(len(owner), KNOWN)]).astype(np.int8),
                np.concatenate([anchor, mark]).view(np.int64),
                np.concatenate([digest[:, 0], mark]).view(np.int64),
                np.concatenate([digest[:, 1], mark]).view(np.int64),
                np.concatenate([doc[one], owner]),
                np.concatenate([position[one], start]).astype(np.int32),
                np.concatenate([left[one], np.zeros(len(owner), np.int64)]).astype(np.int32),
                np.concatenate([right[one], end - start]).astype(np.int32),
            ]
            for a in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=names)

    return run


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct keys, in order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint64)
    return out


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the first length bytes of every suffix of data, by prefix doubling; only suffixes that long count."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(len(data) + length, dtype=np.uint64)
    for j in range(8):
        rank |= padded[j : j + len(rank)] << np.uint64(56 - 8 * j)
    rank, width = _ranks(rank), 8
    while width < length:
        step = min(width, length - width)
        pair = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        rank, width = _ranks(pair), width + step
    return rank[: len(data)]


def longest_previous(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, given in suffix order.

    position: where each begins in the text; shared: the bytes that each shares with the one before it. The previous
    and the next smaller position are found by following pointers past larger ones; what two suffixes share is the
    least that neighbours between them share.
    """

    def one_way(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
        to, least = np.arange(len(position)) - 1, shared.copy()
        least[:1] = 0
        look = np.flatnonzero(least > 0)
        while len(look := look[(least[look] > 0) & (position[to[look]] >= position[look])]):
            past = to[look]
            least[look] = np.minimum(least[look], least[past])
            to[look] = to[past]
        return least

    before = one_way(position, shared)
    after = one_way(position[::-1], np.concatenate((shared[:1] * 0, shared[:0:-1])))[::-1]
    return np.maximum(before, after)


def repeats_in(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the strings of LENGTH bytes in contexts that also start earlier in one of them."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    rank = suffix_ranks(np.frombuffer(b"".join(contexts), dtype=np.uint8))
    many = sizes - LENGTH + 1
    own = np.repeat(np.arange(len(contexts)), many)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    ids, number = np.unique(doc, return_inverse=True)
    first = start[own] + offset
    span = int(first.max()) + 1 if len(first) else 1
    run = rank[begins[own] + offset]
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    # Only suffixes that share LENGTH bytes with a neighbour can have a factor of that length; between runs it is less.
    shared = np.concatenate(([0], np.where(same, LENGTH, 0)))[: len(order)]
    near = (shared > 0) | np.concatenate((shared[1:] > 0, [False]))[: len(order)]
    order, shared = order[near], shared[near]
    hit = order[longest_previous((number[own] * span + first)[order], shared) >= LENGTH]
    owner, a, b = merged(number[own][hit], first[hit], first[hit] + LENGTH)
    return ids[owner] if len(owner) else np.zeros(0, np.int64), a, b


def _suffix_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (doc_id, start, end) in rows (key, doc_id, start, bytes) that come sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        doc, a, b = repeats_in(table.column("bytes").to_pylist(), column("doc_id"), column("start"))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a), pa.array(b)], names=["doc_id", "start", "end"])

    for batch in batches:
        key = np.asarray(batch.column(0))
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and np.asarray(held[-1].column(0))[-1] != key[0]:
            edges = np.concatenate(([0], edges))
        if len(edges) and rows + edges[-1] >= 4096:  # whole groups only
            yield out([*held, batch.slice(0, edges[-1])])
            held, rows = [batch.slice(edges[-1])], len(key) - edges[-1]
        else:
            held.append(batch)
            rows += len(key)
    if rows:
        yield out(held)


PARTS = "key long, digest binary, doc_id long, start long, low int, bytes binary"


def _split(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, start, low, bytes) cut to ranges of width places of the anchor, keyed by what all in a range share.

    The strings in bytes have the anchor low to low + len(bytes) - LENGTH bytes after their start.
    """
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, low, data in zip(*(c.to_pylist() for c in batch.columns)):
                high = low + len(data) - LENGTH
                for at in range(low // width * width, high + 1, width):
                    a, b = max(low, at), min(high, at + width - 1)
                    own = data[high - b : high - a + LENGTH]
                    core = own[b - at : b - at + LENGTH - width + 1]
                    key = int.from_bytes(blake2b(core, digest_size=8, salt=b"%d" % at).digest(), "little", signed=True)
                    rows.append((key, blake2b(own, digest_size=16).digest(), doc, start + high - b, a, own))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _refined(rows: DataFrame, group: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(intervals that repeat as a whole, rows to suffix-sort) of contexts of anchors that have too many of them."""
    whole, sort = None, None
    add = lambda a, b: b if a is None else a.union(b)
    at = F.struct("doc_id", "start")
    for width in WIDTHS:
        rows = staged(rows.select("doc_id", "start", "low", "bytes").mapInArrow(_split(width), PARTS), "ranges")
        if rows.isEmpty():
            break
        least = staged(rows.groupBy("key", "digest").agg(F.min(at).alias("least")), "first-ranges")
        kinds = least.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key", "kinds", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        marked = rows.join(least, ["key", "digest"])
        whole = add(whole, marked.where(at > F.col("least")).select("doc_id", "start", (F.col("start") + F.length("bytes")).alias("end")))
        left = marked.where(at == F.col("least")).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(kinds, ["key", "salt"])
        sort = add(sort, left.where(F.col("kinds") <= group).select("key", "doc_id", "start", "bytes"))
        rows = left.where(F.col("kinds") > group)
    return whole, sort


def repeated_intervals(docs: DataFrame, group: int = GROUP, local: int = LOCAL) -> DataFrame:
    """(doc_id, start, end) byte intervals of docs (doc_id, text) whose LENGTH-byte strings all start earlier too.

    group and local only say how the work is cut; the intervals cover the same bytes whatever they are.
    """
    small_batches(docs.sparkSession)
    by = W.partitionBy("anchor")
    ordered = by.orderBy("context", "more", "doc_id", "position")
    found = docs.mapInArrow(_occurrences(common_anchors(docs, local, group), group), ANCHORS)
    same = (F.lag("context").over(ordered) == F.col("context")) & (F.lag("more").over(ordered) == F.col("more"))
    found = found.withColumn("first", ~F.coalesce(same, F.lit(False)))
    found = found.withColumn("kinds", F.sum(F.col("first").cast("long")).over(by))
    found = staged(found.where(f"state <> {CONTEXT} or not first or kinds > 1").drop("context", "more"), "anchors")
    start = (F.col("position") - F.col("head")).cast("long").alias("start")
    whole = found.where(f"state = {KNOWN} or not first").select("doc_id", start, (F.col("position") + F.col("tail")).cast("long").alias("end"))
    big = (F.col("state") == COMMON) | (F.col("kinds") > group)
    low = F.greatest(F.lit(LENGTH) - F.col("tail"), F.lit(0)).alias("low")
    cut = found.where(f"state <> {KNOWN} and first").select("anchor", "doc_id", start, low, (F.col("head") + F.col("tail")).alias("size"), big.alias("big"))
    cut = docs.select("doc_id", "text").join(cut, "doc_id").select(F.col("anchor").alias("key"), "doc_id", "start", "low", "big", F.expr("substring(cast(text as binary), start + 1, size)").alias("bytes"))
    cut = staged(cut, "contexts")
    again, more = _refined(cut.where("big"), group)
    sort = cut.where("not big").select("key", "doc_id", "start", "bytes")
    sort = sort if more is None else sort.union(more)
    found = sort.repartition("key").sortWithinPartitions("key").mapInArrow(_suffix_sorted, "doc_id long, start long, end long")
    return whole.union(found) if again is None else whole.union(found).union(again)


RESULT = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with key: doc_id where each names one text, else numbers in the same order, one for each text.

    Then ids are multiplied by the number of texts that one of them has, which must fit 64 bits.
    """
    marks = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark")).distinct()
    most = marks.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if most == 1:
        return rows.withColumn("key", F.col("doc_id"))
    place = marks.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("mark")) - 1)
    keyed = rows.withColumn("mark", F.xxhash64("text")).join(place, ["doc_id", "mark"], "left")
    return keyed.select("doc_id", "text", (F.col("doc_id") * most + F.col("place")).alias("key"))


def without_repeats(docs: DataFrame, group: int = GROUP, local: int = LOCAL) -> DataFrame:
    """doc_id, n_bytes, removed (maximal byte intervals in order) and kept (the bytes that stay) of every row.

    The first of equal strings, by doc_id and then start, stays. Null texts are empty; texts under LENGTH bytes stay
    whole. Rows that repeat doc_id and text are one document and get the same result; of one doc_id on different texts
    each is a document, in order of the texts' hashes. Rows without doc_id stay whole and are compared with nothing.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    spans = repeated_intervals(rows.where("key is not null").select(F.col("key").alias("doc_id"), "text"), group, local)
    spans = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            size, removed, kept = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                starts, ends = (np.array([s[k] for s in spans or []], dtype=np.int64) for k in ("start", "end"))
                _, starts, ends = merged(np.zeros(len(starts), np.int64), starts, ends)
                edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(data)]
                size.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, shape), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
