"""Document fingerprints as invertible Bloom lookup tables of hashed paragraphs.

A paragraph is a piece of a line, cut where a hash of the few bytes before says so (more often after spaces), so that an edit
changes the pieces around it and no others. A text's fingerprint is a table of cells, as many as its paragraphs ask for:
each paragraph key is added to three cells (count, xor of keys, xor of check hashes). Two versions' fingerprints subtract
cell by cell; what they share cancels, and peeling cells that hold one key recovers the keys that differ. Parts of a table
are powers of two, so a larger one folds onto a smaller one's cells. Likenesses come from that. Only where peeling gets
stuck, which two thirds of a text in common don't, both tables are built again, larger. All pairs of a block are peeled
together; difference() does it for two fingerprints as they are returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches, text_or_empty

HASHES, GROWTH = 3, 4
#: Cells for each paragraph of a text, and beyond these; then up to the next power of two a part.
CELLS_EACH, CELLS_MORE = 1.25, 9
#: A paragraph ends after one of so many spaces and after one of so many bytes, on average.
CUT_EVERY, CUT_WITHIN = 16, 160
BLOCK_BYTES = 1 << 20
GOLD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
SEEDS = np.arange(1, HASHES + 1, dtype=np.uint64) * BASE
STEPS = np.arange(1, 4, dtype=np.uint64) * GOLD | np.uint64(1)
LEAST = -(2**63)
#: A cell of a fingerprint as it is written: count, xor of keys, xor of checks.
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraph_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner of each) of the paragraphs of each text; a repeated paragraph gets a key for each time it comes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    ends = ends[sizes > 0]
    begins = np.concatenate(([0], ends[:-1]))
    values = VALUES[data]
    near = values.copy()
    for step, factor in zip((1, 2, 4), STEPS):
        near[step:] = near[step:] + near[:-step] * factor
    near = _mix(near)
    cut = ((data == 0x20) & (near % np.uint64(CUT_EVERY) == 0)) | ((near >> np.uint64(32)) % np.uint64(CUT_WITHIN) == 0)
    first = (begins[:, None] + np.arange(8)).ravel()
    cut[first[first < len(data)]] = False  # what a cut depends on must lie in its own text
    cut |= data == 0x0A
    cut[ends - 1] = True
    stops = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], stops[:-1]))
    place = np.arange(len(data)) - np.repeat(starts, stops - starts)
    powers = np.full(int((stops - starts).max()), BASE)
    powers[0] = 1
    digests = _mix(np.add.reduceat(values * np.cumprod(powers)[place], starts) + (stops - starts).astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), sizes)[starts]
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    new = np.concatenate(([True], (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])))
    head = np.flatnonzero(new)
    time = np.arange(len(digests)) - head[np.cumsum(new) - 1]
    return _mix(digests + time.astype(np.uint64) * GOLD), owner


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ GOLD) >> np.uint64(32)).astype(np.uint32)


class Tables:
    """One table of the same number of cells for each owner."""

    def __init__(self, owners: int, cells: int) -> None:
        self.owners, self.cells, self.part = owners, cells, cells // HASHES
        self.count = np.zeros(owners * cells, dtype=np.int32)
        self.keys = np.zeros(owners * cells, dtype=np.uint64)
        self.checks = np.zeros(owners * cells, dtype=np.uint32)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        check = _check(keys)
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int32), keys.shape)
        for j in range(HASHES):
            at = owner * self.cells + j * self.part + (_mix(keys + SEEDS[j]) % np.uint64(self.part)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, owner, sign) that were recovered, and which owners' tables came out empty."""
        found = []
        look = np.arange(len(self.count))
        while True:
            pure = look[(np.abs(self.count[look]) == 1) & (self.checks[look] == _check(self.keys[look]))]
            if not len(pure):
                break
            owner, keys, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            one = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
            owner, keys, sign = owner[one], keys[one], sign[one]
            self.add(keys, owner, -sign)
            found.append((keys, owner, sign))
            look = np.unique(np.concatenate([owner * self.cells + j * self.part + (_mix(keys + SEEDS[j]) % np.uint64(self.part)).astype(np.int64) for j in range(HASHES)]))
        clean = ~((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.owners, self.cells).any(axis=1)
        keys, owner, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return keys, owner, sign, clean

    def encoded(self, sizes: np.ndarray) -> list[str]:
        """Each table as text: number of paragraphs, then every cell."""
        rows = np.empty(len(self.count), dtype=CELL)
        rows["count"], rows["key"], rows["check"] = self.count, self.keys, self.checks
        data, step = rows.tobytes(), CELL.itemsize * self.cells
        return [base64.b64encode(n.to_bytes(8, "little") + data[i * step : (i + 1) * step]).decode() for i, n in enumerate(sizes.tolist())]


def decode(fingerprint: str) -> tuple[int, Tables]:
    """(number of paragraphs, table) of a fingerprint as it was returned."""
    data = base64.b64decode(fingerprint)
    rows = np.frombuffer(data, dtype=CELL, offset=8)
    out = Tables(1, len(rows))
    out.count[:], out.keys[:], out.checks[:] = rows["count"], rows["key"], rows["check"]
    return int.from_bytes(data[:8], "little"), out


def folded(table: Tables, cells: int) -> Tables:
    """The table of one owner with fewer cells, as if its keys had been added to these."""
    out = Tables(1, cells)
    times = table.part // out.part
    shape = (HASHES, times, out.part)
    out.count = table.count.reshape(shape).sum(axis=1, dtype=np.int32).ravel()
    out.keys = np.bitwise_xor.reduce(table.keys.reshape(shape), axis=1).ravel()
    out.checks = np.bitwise_xor.reduce(table.checks.reshape(shape), axis=1).ravel()
    return out


def difference(a: str, b: str) -> tuple[set[int], set[int]] | None:
    """Paragraph keys that only a or only b has, from two fingerprints; None if they differ by more than they can tell."""
    own, other = decode(a)[1], decode(b)[1]
    cells = min(own.cells, other.cells)
    own, other = folded(own, cells), folded(other, cells)
    own.count -= other.count
    own.keys ^= other.keys
    own.checks ^= other.checks
    keys, _, sign, clean = own.peel()
    return (set(keys[sign > 0].tolist()), set(keys[sign < 0].tolist())) if clean[0] else None


def cells_for(paragraphs: np.ndarray) -> np.ndarray:
    """The cells of fingerprints of texts of so many paragraphs."""
    part = (CELLS_EACH * paragraphs + CELLS_MORE) / HASHES
    return HASHES * 2 ** np.ceil(np.log2(part)).astype(np.int64)


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, pair, sign) on one side only (sign 1: a, -1: b) and the cells that each pair took; a and b: (keys, pair).

    cells: of each pair's smaller fingerprint, which are tried first; a pair that they can't tell gets more.
    """
    keys, owner = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    sign = np.concatenate([np.ones(len(a[0]), np.int32), -np.ones(len(b[0]), np.int32)])
    order = np.argsort(owner, kind="stable")
    keys, owner, sign = keys[order], owner[order], sign[order]
    cells, left, out = cells.copy(), np.ones(len(cells), dtype=bool), []
    while left.any():
        for size in np.unique(cells[left]).tolist():
            pairs = np.flatnonzero(left & (cells == size))
            number = np.full(len(cells), -1)
            number[pairs] = np.arange(len(pairs))
            mine = number[owner] >= 0
            tables = Tables(len(pairs), size)
            tables.add(keys[mine], number[owner[mine]], sign[mine])
            k, o, s, clean = tables.peel()
            good = clean[o]
            out.append((k[good], pairs[o[good]], s[good]))
            left[pairs[clean]] = False
        cells[left] *= GROWTH
    keys, owner, sign = (np.concatenate(x) for x in zip(*out)) if out else (keys, owner, sign)
    return keys, owner, sign, cells


def fingerprints(keys: np.ndarray, owner: np.ndarray, paragraphs: np.ndarray) -> list[str]:
    """The fingerprint of each owner."""
    sizes, out = cells_for(paragraphs), [""] * len(paragraphs)
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        number = np.full(len(sizes), -1)
        number[some] = np.arange(len(some))
        mine = number[owner] >= 0
        tables = Tables(len(some), size)
        tables.add(keys[mine], number[owner[mine]], 1)
        for i, text in zip(some.tolist(), tables.encoded(paragraphs[some])):
            out[i] = text
    return out


def likeness(differing: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of paragraphs, of both texts together, that both have; two texts without paragraphs are alike."""
    both = one + other
    return np.where(both > 0, 1 - differing / np.maximum(both, 1), 1.0)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(texts: list[str]) -> dict[str, list]:
    """Results of all of texts but the last, each with the text after it."""
    m = len(texts) - 1
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw_changed = [t.encode("utf-8", "surrogatepass") for t in changed]
    keys, owner = paragraph_keys(raw)
    keys2, owner2 = paragraph_keys(raw_changed)
    n, n2 = np.bincount(owner, minlength=m + 1), np.bincount(owner2, minlength=m)
    own, after = owner < m, owner > 0
    one, sizes = (keys[own], owner[own]), cells_for(n)
    d2 = np.bincount(differences(one, (keys2, owner2), np.minimum(sizes[:m], cells_for(n2)))[1], minlength=m)
    d1 = np.bincount(differences(one, (keys[after], owner[after] - 1), np.minimum(sizes[:m], sizes[1:]))[1], minlength=m)
    return {
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw_changed],
        "fingerprint": fingerprints(*one, n[:m]),
        "edited_fingerprint": fingerprints(keys2, owner2, n2),
        "near_edited": likeness(d2, n[:m], n2).tolist(),
        "near_next": likeness(d1, n[:m], n[1:]).tolist(),
    }


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt to partitions by ranges of ids and sorted by descending id, each range followed by
    the first row of the next (ghost true), the last one by the very first row. Columns: bucket, ghost, doc_id, text.

    Only split points and the largest id of each range are collected, one of each for a partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), text_or_empty().alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = np.unique(np.array(docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.float64).astype(np.int64))

    def bucket_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(splits, ids, side="left")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for b in np.unique(at := bucket_of(ids)).tolist():
                best[b] = max(best.get(b, LEAST), int(ids[at == b].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["bucket", "head"])

    heads = {r.bucket: r.head for r in rows.select("doc_id").mapInArrow(largest, "bucket long, head long").groupBy("bucket").agg(F.max("head").alias("head")).collect()}
    order = sorted(heads)
    goes = {heads[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_ids = np.array(sorted(goes), dtype=np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            again = np.flatnonzero(np.isin(ids, head_ids))
            row = np.concatenate([np.arange(len(ids)), again])
            bucket = np.concatenate([bucket_of(ids), np.array([goes[i] for i in ids[again].tolist()], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(len(row)) >= len(ids)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["bucket", "ghost", "doc_id", "text"])

    small_batches(spark)
    dealt = rows.mapInArrow(deal, "bucket int, ghost boolean, doc_id long, text string")
    return dealt.repartitionById(max(1, len(splits) + 1), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("doc_id"), "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty; an empty text has an empty table. Rows with one doc_id follow each other by text; rows
    without doc_id come last. Further columns are ignored. A lone document is its own next. The edited text's tail comes from the next document in
    descending doc_id, the first one after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = _compare(texts)
            own = pa.array([None if i == LEAST else i for i in ids[:-1]], pa.int64())
            return pa.RecordBatch.from_arrays([own, *(pa.array(v) for v in out.values())], names=["doc_id", *out])

        bucket = ended = None
        for batch in batches:
            for b, ghost, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, ended, ids, texts, held = b, False, [], [], 0
                if ended:
                    continue
                ids.append(i)
                texts.append(t)
                held += len(t)
                ended = ghost
                if (ghost or held >= BLOCK_BYTES) and len(ids) > 1:
                    yield flush()
                    ids, texts, held = ids[-1:], texts[-1:], 0

    return with_following(docs).mapInArrow(run, RESULT)


def op4_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
