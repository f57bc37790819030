"""Secret scans with an incremental blob ledger.

A text version is a blob, addressed by the SHA-256 of its bytes; many paths (documents, revisions) may hold one blob.
The ledger lists the (blob, rule version) pairs that were scanned before, with what was found. Only pairs that it lacks
are scanned, each blob once, and findings are joined back to every path that holds the blob. A run stages what it scanned,
so that the next run, with more versions or newer rules, reads it as its ledger.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import documents, small_batches, staged, text_or_empty

#: Fixed patterns of the base rules, and how they are held to a length.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Rules that the ledger adds to the base ones.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}")
URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@")


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(k in low for k in KEYWORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text)]


def _where(pattern: re.Pattern[str], needle: str) -> Callable[[str], list[tuple[int, int]]]:
    return lambda text: [m.span() for m in pattern.finditer(text)] if needle in text else []


def _jwt(text: str) -> list[tuple[int, int]]:
    """eyJ and 8 characters or more, and twice a dot with 8 or more, each run of letters, digits, _ and - to its end."""
    if "eyJ" not in text:
        return []
    found = []
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        while i + 2 < len(parts):
            head = parts[i].find("eyJ")
            if head >= 0 and len(parts[i]) - head >= 11 and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
                found.append((starts[i] + head, starts[i + 3] - 1))
                i += 3
            else:
                i += 1
    return found


#: Kind, version and scanner of every rule, in the order in which spans with one start are listed.
RULES: list[tuple[str, int, Callable[[str], list[tuple[int, int]]]]] = [
    ("assign", 1, _assign),
    ("access", 1, _access),
    ("hex", 1, _hex),
    ("pem", 1, _where(PEM, "-----BEGIN ")),
    ("jwt", 1, _jwt),
    ("github", 1, _where(GITHUB, "gh")),
    ("url", 1, _where(URL, "://")),
]
BASE = ("assign", "access", "hex")
#: Rules of the query's earlier run; github and url came after it.
EARLIER = ("assign", "access", "hex", "pem", "jwt")
ORDER = {kind: i for i, (kind, _, _) in enumerate(RULES)}
FINDINGS = "blob string, rules array<string>, spans array<struct<kind: string, start: long, end: long>>"


def scan_text(text: str, kinds: list[str]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as listed."""
    found = [(kind, a, b) for kind, _, scan in RULES if kind in kinds for a, b in scan(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def rule_keys(kinds: tuple[str, ...] | None = None) -> list[str]:
    return [f"{kind}@{version}" for kind, version, _ in RULES if kinds is None or kind in kinds]


def blobs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the blob address of each whole text; null is the empty text."""
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))


def scanned(paths: DataFrame, ledger: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Ledger rows (blob, rules, spans) of the blobs in paths (doc_id, text, blob) with rules of kinds (None: all) that
    the ledger lacks.

    A blob's text comes from one of its paths, so that whatever its number of copies, it moves and is scanned once.
    """
    wanted = F.array(*(F.lit(k) for k in rule_keys(kinds)))
    first = paths.groupBy("blob").agg(F.min(F.struct("doc_id")).alias("at")).select("blob", F.col("at.doc_id").alias("doc_id"))
    if ledger is not None:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        first = first.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("done")
    else:
        first = first.withColumn("todo", wanted)
    unseen = paths.join(first.withColumnsRenamed({"doc_id": "_id", "blob": "_blob"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")), "inner").select("blob", "text", "todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            todo = batch.column(2).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, [r.split("@")[0] for r in rules])] for t, rules in zip(batch.column(1).to_pylist(), todo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, shape)], names=["blob", "rules", "spans"])

    small_batches(paths.sparkSession)
    return unseen.mapInArrow(run, FINDINGS).dropDuplicates(["blob"])


def extended(paths: DataFrame, ledger: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The ledger with what it lacked of paths, scanned and staged."""
    new = staged(scanned(paths, ledger, kinds), "findings")
    return new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)


def secrets(paths: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans) of every path, and the ledger with what this run scanned.

    Null and empty texts are one blob without spans. Rows that repeat are paths of one blob; rows without doc_id are
    paths too. Spans are ordered by start and kind. Columns of docs but doc_id and text are ignored by blobs().
    """
    book = extended(paths, ledger)
    found = book.select("blob", F.explode("spans").alias("span")).groupBy("blob").agg(F.collect_set("span").alias("spans"))
    kinds = F.array(*(F.lit(k) for k in ORDER))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    # staged, so that the join has shuffles of its own, whose hot blobs Spark can split
    found = staged(found.select("blob", F.array_sort(F.transform("spans", order)).alias("spans")), "spans")
    return paths.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start: long, rank: long, end: long, kind: string>>")).alias("spans")), book


def earlier(docs: DataFrame) -> DataFrame:
    """The rows of the lowest eighth of the id range, which an earlier run has seen."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return docs.where(F.col("doc_id") <= (low or 0) + ((high or 0) - (low or 0)) // 8)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: an earlier one over some versions with fewer rules, and one over all that scans what its ledger lacks."""
    docs = documents(spark, sf_dir)
    paths, _ = secrets(blobs(docs), extended(blobs(earlier(docs)), kinds=EARLIER))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
