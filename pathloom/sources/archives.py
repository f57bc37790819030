"""Archives of exports: zips, nested zips and single files, planned into paths by their directories and read as values.

An export is never held whole: its directory says where its members lie, and tasks read the byte ranges of theirs.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import glob
from pathloom.sources import shred
from pathloom.sources.staging import staged

PARSED = (".json", ".jsonl", ".ndjson", ".js", ".csv", ".tsv")
#: First bytes of media files and their types (fixed values).
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"%PDF", "application/pdf"),
    (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"\x1aE\xdf\xa3", "video/webm"), (b"PK\x03\x04", "application/zip"),
)
ENDINGS = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".mp4": "video/mp4", ".mov": "video/quicktime", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".m4a": "audio/mp4", ".txt": "text/plain", ".html": "text/html", ".pdf": "application/pdf"}
#: What systems add to the name of a copy (fixed value).
COPY = re.compile(r"(\s*\(\d+\)|\s+\d+|\s*-?\s*copy(\s*\d+)?)$", re.IGNORECASE)
CHUNK = 1 << 20
#: What reading a damaged entry raises.
DAMAGED = (zipfile.BadZipFile, zlib.error, struct.error, EOFError, OSError, NotImplementedError, RuntimeError, pa.ArrowInvalid)


@dataclass(frozen=True)
class Limits:
    max_depth: int = 3
    max_entries: int = 200_000
    max_entry_size: int = 256 << 20
    max_total_size: int = 4 << 30
    keep_ignored: bool = False
    #: Paths whose folders are always or never collapsed into one; else those that look alike inside are.
    collapse_folders: tuple[str, ...] = ()
    keep_folders: tuple[str, ...] = ()


@dataclass
class _Run:
    limits: Limits
    warnings: list[str] = field(default_factory=list)
    #: Folders that an archive lists itself, so that empty ones are known; those of the archive that is read.
    folders: list[tuple[str, ...]] = field(default_factory=list)


def is_junk(parts: list[str]) -> bool:
    """Files that operating systems leave in archives."""
    last = parts[-1].lower()
    return "__MACOSX" in parts or last.startswith("._") or last in (".ds_store", "thumbs.db", "desktop.ini")


def is_unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name[:1] in ("/", "\\") or ".." in parts or ":" in parts[0]


def entry_name(info: zipfile.ZipInfo) -> str:
    """The entry's name in composed form; names without the UTF-8 flag may still be UTF-8."""
    name = info.filename
    if not info.flag_bits & 0x800:
        try:
            name = name.encode("cp437").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", name)


def mime_of(name: str, head: bytes) -> tuple[str | None, str | None]:
    for magic, mime in MAGIC:
        if head.startswith(magic):
            return mime, "magic"
    if head[4:8] == b"ftyp":
        return "video/mp4", "magic"
    if head[:4] == b"RIFF":
        return ("image/webp" if head[8:12] == b"WEBP" else "audio/x-wav"), "magic"
    mime = ENDINGS.get(_ext(name) or "")
    return (mime, "extension") if mime else (None, None)


def _ext(name: str) -> str | None:
    head, dot, tail = name.rpartition(".")
    return f".{tail}".lower() if dot and head else None


def _same(folder: str, container: str) -> bool:
    """Whether a folder is named like its zip, letter by letter; masked letters and digits of the zip's name stand for any."""
    own, whole = (COPY.sub("", unicodedata.normalize("NFC", n).casefold().strip()) for n in (folder, container[: container.rfind(".")] if container.rfind(".") > 0 else container))
    return len(own) == len(whole) and all(a == b or (b == "x" and a.isalpha()) or (b == "0" and a.isdigit()) for a, b in zip(own, whole))


def _entries(archive: zipfile.ZipFile, run: _Run, name: str | None) -> list[tuple[list[str], zipfile.ZipInfo, bool]]:
    """(parts, entry, ignored): safe ones in order, the last of a name at the first one's place, wrapper folder removed."""
    infos = archive.infolist()
    if len(infos) > run.limits.max_entries:
        run.warnings.append("too_many_entries")
    kept: dict[tuple[str, ...], tuple[zipfile.ZipInfo, bool]] = {}
    for info in infos[: run.limits.max_entries]:
        text = entry_name(info)
        if is_unsafe(text):
            run.warnings.append("unsafe_path")
            continue
        parts = [p for p in text.replace("\\", "/").split("/") if p not in ("", ".")]
        if not parts:
            continue
        junk = is_junk(parts)
        if junk and not run.limits.keep_ignored:
            continue
        if info.is_dir():
            if not junk:
                run.folders.append(tuple(parts))
            continue
        if tuple(parts) in kept:
            run.warnings.append("duplicate_entry")
        kept[tuple(parts)] = (info, junk)
    real = [p for p, (_, junk) in kept.items() if not junk]
    tops = {p[0] for p in real}
    if name and len(tops) == 1 and all(len(p) > 1 for p in real) and real and _same(next(iter(tops)), name):
        run.warnings.append("wrapper_folder")
        kept = {(p[1:] if len(p) > 1 and p[0] in tops else p): v for p, v in kept.items()}
        run.folders = [f[1:] if f[0] in tops else f for f in run.folders]
    return [(list(p), info, junk) for p, (info, junk) in kept.items()]


def _escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _pattern(name: str) -> str:
    return re.sub(r"\d+", "{n}", name)


def _mask(name: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("x" if c.isalpha() else "0" if c.isdigit() else "s" for c in name))


def collapsed(files: list[list[str]], path: str, limits: Limits) -> tuple[list[list[str]], dict[tuple[str, ...], tuple[int, str]]]:
    """(new parts of each file, {folder: (folders in it, mask of their names)}): folders that look alike become {*}.

    Decided from the top: rules first, else folders without files of their own whose folders share half of their names.
    """
    out: list[list[str]] = [[] for _ in files]
    merged: dict[tuple[str, ...], tuple[int, str]] = {}
    ruled = lambda p, rules: any(re.match(glob(r), p) for r in rules)
    todo = [((), [(i, parts) for i, parts in enumerate(files)])]
    while todo:
        at, members = todo.pop()
        folders: dict[str, list[tuple[int, list[str]]]] = {}
        for i, rest in members:
            if len(rest) == 1:
                out[i] = [*at, rest[0]]
            else:
                folders.setdefault(rest[0], []).append((i, rest[1:]))
        here = path + "".join(f"/{_escape(s)}" for s in at)
        inside = [{_pattern(rest[0]) + "/" * (len(rest) > 1) for _, rest in ms} for ms in folders.values()]
        common = {n for names in inside for n in names if 2 * sum(n in other for other in inside) > len(inside)}
        alike = len(folders) > 1 and sum(len(names & common) / len(names) for names in inside) / len(inside) >= 0.5
        loose = any(len(rest) == 1 for _, rest in members)
        if folders and not ruled(here, limits.keep_folders) and (ruled(here, limits.collapse_folders) or (alike and not loose)):
            masks = [_mask(name) for name in folders]
            merged[(*at, "{*}")] = (len(folders), min(masks, key=lambda m: (-masks.count(m), m)))
            todo.append(((*at, "{*}"), [m for ms in folders.values() for m in ms]))
        else:
            todo += [((*at, name), ms) for name, ms in folders.items()]
    return out, merged


@dataclass
class _Group:
    """Files that become one path, in the order of the archive."""

    path: str
    name: str
    members: list[tuple[zipfile.ZipInfo, bool]]


def _planned(archive: zipfile.ZipFile, name: str | None, path: str, run: _Run) -> tuple[list[dict], list[_Group]]:
    """(container and folders, groups of files) of an archive: wrapper removed, look-alike folders and numbered files merged."""
    rows = [{"path": path, "kind": "container", "name": name}]
    run.folders = []
    found = _entries(archive, run, name)
    new, merged = collapsed([p for p, _, _ in found], path, run.limits)
    became = {tuple(old[:i]): tuple(now[:i]) for now, (old, _, _) in zip(new, found) for i in range(1, len(old))}
    found = [(parts, info, junk) for parts, (_, info, junk) in zip(new, found)]
    folders = set(became.values())
    for listed in filter(None, run.folders):  # listed ones that hold no file lie where their parents went
        known = next((i for i in range(len(listed), 0, -1) if listed[:i] in became), 0)
        moved = (*became.get(listed[:known], ()), *listed[known:])
        folders |= {moved[:i] for i in range(1, len(moved) + 1)}
    at = lambda parts: path + "".join(f"/{_escape(s)}" for s in parts)
    for f in sorted(folders):
        many, mask = merged.get(f, (None, f[-1]))
        rows.append({"path": at(f), "kind": "folder", "name": mask, "files": many})
    patterns: dict[tuple[tuple[str, ...], str], set[str]] = {}
    for parts, _, _ in found:
        if re.search(r"\d", parts[-1]) and not parts[-1].lower().endswith(".zip"):
            patterns.setdefault((tuple(parts[:-1]), _pattern(parts[-1])), set()).add(parts[-1])
    groups: dict[str, _Group] = {}
    for parts, info, junk in found:
        folder, pattern = tuple(parts[:-1]), _pattern(parts[-1])
        last = pattern if len(patterns.get((folder, pattern), ())) > 1 else parts[-1]
        groups.setdefault(at((*folder, last)), _Group(at((*folder, last)), last, [])).members.append((info, junk))
    return rows, list(groups.values())


# --- reading members by their byte ranges ---------------------------------------------------------------------------

MEMBER = "member int, offset long, packed long, size long, method int, flags int, crc long"


def opened(source: str):
    """A stream over a file of any file system that Arrow knows, which can be read from any place."""
    plain = re.sub("^file:/+", "/", source)
    system, path = (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(source)
    return system.open_input_file(path)


def modified(infos: list[zipfile.ZipInfo]) -> str | None:
    """The newest change of archive entries, as it is stored: without a time zone, unset ones left out."""
    known = []
    for info in infos:
        try:
            known.append(datetime.datetime(*info.date_time))
        except ValueError:
            continue
    return max(known).isoformat() if known else None


def inflated(stream, m: dict, most: int) -> bytes:
    """The first bytes of a member, most of them, read from its own range of the archive and nothing else.

    A member that is read to its end must be as long as it says, and have its checksum.
    """
    if m["offset"] < 0:  # the whole file is the member
        stream.seek(0)
        return stream.read(most)
    stream.seek(m["offset"])
    head = stream.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry where the directory says")
    if m["flags"] & 1:
        raise RuntimeError("the entry is encrypted")
    stream.seek(m["offset"] + 30 + sum(struct.unpack("<HH", head[26:30])))
    left = m["packed"]
    if m["method"] == zipfile.ZIP_STORED:
        data = stream.read(min(left, most))
    elif m["method"] == zipfile.ZIP_DEFLATED:
        inflate, parts, have = zlib.decompressobj(-15), [], 0
        while left and have < most and not inflate.eof:
            chunk = stream.read(min(left, CHUNK))
            if not chunk:
                raise EOFError("the archive ends within an entry")
            left -= len(chunk)
            parts.append(inflate.decompress(chunk, most - have))
            have += len(parts[-1])
            while inflate.unconsumed_tail and have < most:
                parts.append(inflate.decompress(inflate.unconsumed_tail, most - have))
                have += len(parts[-1])
        data = b"".join(parts)
    else:
        raise NotImplementedError("that compression method is not supported")
    if most > m["size"] and (len(data) != m["size"] or zlib.crc32(data) != m["crc"]):
        raise zipfile.BadZipFile("bad checksum or length")
    return data


def _mine(info: zipfile.ZipInfo, member: int) -> dict:
    return {"member": member, "offset": info.header_offset, "packed": info.compress_size, "size": info.file_size, "method": info.compress_type, "flags": info.flag_bits, "crc": info.CRC}


NODE = "doc_id string, path string, kind string, name string, size_bytes long, ext string, mime string, mime_source string, modified string, files long, reason string, error string, parser string, encoding string, wrapper string, delimiter string, warning array<string>"
#: What a reading task tells: a node, how a member was read, or a value in it.
RECORD = f"tag string, {NODE}, member int, parent_path string, key string, ord long, json_type string, s string, n double, size long"
PLAN = f"{NODE}, depth int, allowed long, {MEMBER}"


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def plan_of(source: str, limits: Limits) -> Iterator[dict]:
    """What is to be read of one export, from its directory alone: its nodes, and a row for each member to read.

    Limits are kept here, by the sizes that the directory gives: entries over max_entry_size, and those that would go
    beyond max_total_size of all that is read before them, aren't read (allowed -1). Nested zips get equal parts of what
    is left for what is in them. A file that is no zip is its own only member.
    """
    name = source.rsplit("/", 1)[-1]
    with opened(source) as stream:
        size = stream.size()
        zipped = stream.read(4) in (b"PK\x03\x04", b"PK\x05\x06") or (size >= zipfile.sizeEndCentDir and zipfile.is_zipfile(stream))
        if not zipped:
            whole = {"member": 0, "offset": -1, "packed": size, "size": size, "method": 0, "flags": 0, "crc": 0}
            yield {"doc_id": source, "path": "", "name": name, "size_bytes": size, "ext": _ext(name), "depth": 1, "allowed": size if size <= min(limits.max_entry_size, limits.max_total_size) else -1, "warning": [], **whole}
            return
        run = _Run(limits)
        rows, groups = _planned(zipfile.ZipFile(stream), name, "", run)
        rows[0]["warning"] = run.warnings
        yield from ({"doc_id": source, **r} for r in rows)
        yield from ({"doc_id": source, **r} for r in _members(groups, 1, limits, limits.max_total_size))


def _members(groups: list[_Group], depth: int, limits: Limits, left: int) -> list[dict]:
    """A row for each member to read of groups, with the bytes that may be read for it."""
    out, inner = [], []
    for g in groups:
        infos = [i for i, _ in g.members]
        row = {"path": g.path, "name": g.name, "size_bytes": sum(i.file_size for i in infos), "ext": _ext(g.name), "files": len(infos) if len(infos) > 1 else None, "modified": modified(infos), "depth": depth}
        if all(junk for _, junk in g.members):
            out.append({**row, "kind": "unmatched", "reason": "ignored"})
            continue
        nested = g.name.lower().endswith(".zip")
        read = nested or g.name.lower().endswith(PARSED)
        for n, info in enumerate(infos if read and not nested else infos[:1]):
            allowed = 0
            if read:
                allowed = info.file_size if info.file_size <= min(limits.max_entry_size, left) else -1
                left -= max(0, allowed)
            out.append({**row, **_mine(info, n), "allowed": allowed})
            if nested and allowed >= 0:
                inner.append(out[-1])
    for row in inner:
        row["allowed"] = left // len(inner)
    return out


def _read(row: dict, stream, limits: Limits) -> Iterator[dict]:
    """Records of one member: how it was read and its values, or all records of a nested zip."""
    part = {k: row[k] for k in ("doc_id", "path", "member")} | {"tag": "part"}
    name, nested = row["name"], row["name"].lower().endswith(".zip") and row["offset"] >= 0
    failed = lambda reason, error=None: {**part, "reason": reason, "error": error}
    if row["allowed"] < 0:
        yield failed("too_large")
        return
    try:
        if nested:
            if row["depth"] >= limits.max_depth:
                yield failed("too_large", "max_depth")
                return
            yield from _nested(row, inflated(stream, row, row["size"] + 1), limits)
            return
        mime, by = mime_of(name, inflated(stream, row, 262))
        part |= {"mime": mime, "mime_source": by}
        if not name.lower().endswith(PARSED):
            yield {**part, "kind": "media"} if (mime or "").split("/")[0] in ("image", "video", "audio") else failed("unsupported_type")
            return
        value, told = shred.read_bytes(name, inflated(stream, row, row["size"] + 1))
    except (*DAMAGED, shred.Unreadable) as e:
        yield failed("parse_error", str(e))
        return
    yield {**part, **told, "kind": "file"}
    for i, (path, up, key, kind, s, n, size) in enumerate(shred.values_of(value, row["path"])):
        yield {"tag": "value", "doc_id": row["doc_id"], "path": path, "parent_path": up, "key": key, "ord": (row["member"] << 40) + i, "json_type": kind, "s": s, "n": n, "size": size}


def _nested(row: dict, data: bytes, limits: Limits) -> Iterator[dict]:
    """Records of a zip in a zip, which fits one member's limit and is held as a whole."""
    with io.BytesIO(data) as stream:
        run = _Run(limits)
        rows, groups = _planned(zipfile.ZipFile(stream), row["name"], row["path"], run)
        rows[0]["warning"] = run.warnings
        yield from ({"tag": "node", "doc_id": row["doc_id"], **r} for r in rows)
        for m in _members(groups, row["depth"] + 1, limits, row["allowed"]):
            m = {**m, "doc_id": row["doc_id"]}
            yield {k: m.get(k) for k in ("doc_id", "path", "kind", "name", "size_bytes", "ext", "modified", "files", "reason")} | {"tag": "node" if m.get("reason") else "file"}
            if "offset" in m:
                yield from _read(m, stream, limits)


@dataclass
class Exports:
    """nodes: the containers, folders and files of exports. values: what is in their files, one row a value."""

    nodes: DataFrame
    values: DataFrame


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, size_bytes) of the files under path; none is read. Empty files hold nothing and aren't listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), F.col("length").alias("size_bytes"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, size_bytes, sha256) of the files under path, read in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for source in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened(source) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "size_bytes", "sha256"])

    return listed(spark, path).mapInArrow(run, "doc_id string, size_bytes long, sha256 string")


def read(spark: SparkSession, path: str, limits: Limits = Limits()) -> Exports:
    """The exports under path: zips, nested zips and single files.

    Their directories are read first, one task an export. Then members are dealt out, whatever export they are of, each
    read from its own byte range and parsed once; so many tasks share a large zip, and none holds more of it than a
    member. A zip that can't be opened is an unmatched root. Files that become one path are one node: a file if one of
    them can be read (with a warning if another can't), else unmatched for the first one's reason.
    """
    plan_schema, record_schema = _schema(PLAN), _schema(RECORD)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                try:
                    rows = list(plan_of(source, limits))
                except DAMAGED as e:
                    rows = [{"doc_id": source, "path": "", "kind": "unmatched", "name": source.rsplit("/", 1)[-1], "reason": "parse_error", "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=plan_schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, stream, out, held = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_id"] != source:
                    if stream is not None:
                        stream.close()
                    source, stream = row["doc_id"], opened(row["doc_id"])
                for r in _read(row, stream, limits):
                    out.append(r)
                    held += 200 + len(r.get("s") or "")
                    if held > CHUNK * 8:
                        yield pa.RecordBatch.from_pylist(out, schema=record_schema)
                        out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=record_schema)

    planned = staged(listed(spark, path).select("doc_id").mapInArrow(plan, PLAN), "export-plans")
    todo = planned.where("offset is not null")
    dealt = todo.repartition("doc_id", "path", "member").sortWithinPartitions("doc_id", "offset")
    found = staged(dealt.mapInArrow(records, RECORD), "export-records")

    names = [c.split()[0] for c in NODE.split(", ")]
    files = todo.select(*names).where("coalesce(reason, '') <> 'ignored'").unionByName(found.where("tag = 'file'").select(*names)).dropDuplicates(["doc_id", "path"])
    ok = F.col("kind").isNotNull()
    first = lambda c: F.min_by(c, F.when(ok, F.col("member"))).alias(c)
    bad = lambda c: F.min_by(c, F.when(~ok, F.col("member"))).alias(f"_{c}")
    parts = found.where("tag = 'part'").groupBy("doc_id", "path").agg(*map(first, ("kind", "parser", "encoding", "wrapper", "delimiter")), F.min_by("mime", "member").alias("mime"), F.min_by("mime_source", "member").alias("mime_source"), bad("reason"), bad("error"), F.count_if(~ok).alias("_bad"))
    own = files.drop("kind", "parser", "encoding", "wrapper", "delimiter", "mime", "mime_source", "reason", "error").join(parts, ["doc_id", "path"])
    failed = F.col("kind").isNull()
    own = own.withColumns({"reason": F.when(failed, F.col("_reason")), "error": F.when(failed, F.col("_error")), "warning": F.when(~failed & (F.col("_bad") > 0), F.array(F.lit("group_member_failed"))).otherwise(F.col("warning")), "kind": F.coalesce("kind", F.lit("unmatched"))})
    nodes = planned.where("offset is null").select(*names).unionByName(found.where("tag = 'node'").select(*names)).unionByName(own.select(*names))
    values = found.where("tag = 'value'").select("doc_id", "path", "parent_path", F.col("key").alias("name"), "ord", "json_type", "s", "n", "size")
    return Exports(nodes, values)
