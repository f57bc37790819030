from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pathloom.functions import names
from pathloom.operators import compare, curation, merge, normalize, profile, timeline, views
from pathloom.sources import archives, documents, shred
from pathloom.streaming import ingest


def nodes_of(spark, texts, **options):
    rows = spark.createDataFrame([(d, n, t) for d, n, t in texts], "doc_id string, name string, text string")
    return profile.nodes(shred.shred(rows), **options)


def by_path(frame):
    return {(r.doc_id, r.path): r for r in frame.collect()}


def test_optional_null_and_empty(spark):
    found = by_path(nodes_of(spark, [("d", "a.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2}, {"a": 1.5, "b": None}, {"a": 3, "b": ""}]))], samples=3))
    a, b, items, root = (found["d", p] for p in ("/[]/a", "/[]/b", "/[]", ""))
    assert (a.n_count, a.n_present, a.n_null, a.type, a.shape) == (4, 4, 0, ["number"], "plain")
    assert (b.n_count, b.n_present, b.n_null, b.type, b.length_min, b.length_max) == (4, 3, 1, ["null", "string"], 0, 1)
    assert b.shape == "alpha" and [(s.shape, s.n) for s in b.shapes] == [("alpha", 1), ("empty", 1)]
    assert (items.n_present, root.type, root.length_max, a.range_max, list(a.samples)) == (4, ["array"], 4, 3.0, ["1", "2", "1.5"])
    assert (a.position, b.position) == (0, 1)


def test_formats(spark):
    values = lambda *v: json.dumps([{"when": x} for x in v])
    found = by_path(nodes_of(spark, [("one", "a.json", values("31/01/2026", "01/02/2026")), ("two", "a.json", values("03/04/2026", "01/02/2026")), ("three", "a.json", values("2026-01-01", "31/01/2026")), ("four", "a.json", values(1700000000, 1700000001))]))
    assert found["one", "/[]/when"].format == "%d/%m/%Y"
    assert found["two", "/[]/when"].ambiguous and [(f.f, f.n) for f in found["two", "/[]/when"].formats] == [("%d/%m/%Y", 2), ("%m/%d/%Y", 2)]
    assert [(f.f, f.n) for f in found["three", "/[]/when"].formats] == [("%Y-%m-%d", 1), ("%d/%m/%Y", 1)]
    assert found["four", "/[]/when"].format == "s" and found["four", "/[]/when"].shape == "unix_timestamp"


def test_reading():
    assert shred.read_json('{"a": 1}\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    with pytest.raises(shred.Unreadable):
        shred.read_json("{broken")
    assert shred.read_js("window.YTD.x.part0 = [1, 2];") == ([1, 2], "window.YTD.x.part0 =")
    assert shred.read_js('window["x"].y = [1]') == ([1], 'window["x"].y =')
    with pytest.raises(shred.Unreadable):
        shred.read_js("[1]")
    assert shred.read_csv("a, b\n1, x\n2, y\n , \n")[0][:2] == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}] and len(shred.read_csv("a;b\n1;2\n;\n3;4\n")[0]) == 3
    rows, delimiter = shred.read_csv("a,b,,a\n1,x,true\n\n007,e5,1.5,2,extra\n")
    assert shred.read_csv("a;b\n1;2\n3;4\n")[1] == ";" and delimiter == "," and rows == [{"a": 1, "b": "x", "column_3": True}, {"a": "007", "b": "e5", "column_3": 1.5, "a_2": 2, "column_5": "extra"}]
    assert shred.decode("é".encode("utf-16")) == ("é", "utf-16-le") and shred.decode(b"\xe9")[0] == "é"
    assert [v[:4] for v in shred.values_of({"a/b": [None, {"c": True}]})] == [("", None, None, "object"), ("/a~1b", "", "a/b", "array"), ("/a~1b/[]", "/a~1b", None, "null"), ("/a~1b/[]", "/a~1b", None, "object"), ("/a~1b/[]/c", "/a~1b/[]", "c", "boolean")]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped([("deep.json", "[1]")])
    data = zipped([
        ("export/message_1.json", '[{"a": 1}]'), ("export/message_2.json", '[{"a": 2, "b": 3}]'), ("export/bad.json", "{"), ("export/pic.jpg", b"\x89PNG\r\n\x1a\n"),
        ("export/inner.zip", inner), ("__MACOSX/x", "junk"), ("../evil.json", "[]"), ("export/readme", "text"), ("export/rows.csv", "a,b\n1,2\n"),
    ])
    (tmp_path / "export.zip").write_bytes(data)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04nothing")
    (tmp_path / "one.json").write_text('{"x": true}')
    exports = archives.read(spark, str(tmp_path))
    found = exports.nodes.cache()
    of = lambda name: {r.path: r for r in found.collect() if r.doc_id.endswith(name)}
    rows = of("export.zip")
    assert {p: r.kind for p, r in rows.items()} == {"": "container", "/message_{n}.json": "file", "/bad.json": "unmatched", "/pic.jpg": "media", "/inner.zip": "container", "/inner.zip/deep.json": "file", "/readme": "unmatched", "/rows.csv": "file"}
    assert rows["/message_{n}.json"].files == 2 and rows["/bad.json"].reason == "parse_error" and rows["/readme"].reason == "unsupported_type" and rows["/pic.jpg"].mime == "image/png"
    assert sorted(rows[""].warning) == ["unsafe_path", "wrapper_folder"]
    assert of("broken.zip")[""].reason == "parse_error" and of("one.json")[""].kind == "file"
    got = {(r.path, r.n_count, r.n_present) for r in profile.nodes(exports.values).collect() if r.doc_id.endswith("export.zip")}
    assert ("/message_{n}.json/[]/b", 2, 1) in got and ("/rows.csv/[]/a", 1, 1) in got and ("/inner.zip/deep.json/[]", 1, 1) in got


def test_damaged_entries_and_empty_folders(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("export 2/good.json", "[1]")
        z.writestr("export 2/bad.json", json.dumps(list(range(500))))
        z.mkdir("export 2/empty/inner")
        at = z.getinfo("export 2/bad.json").header_offset + 30 + len("export 2/bad.json")
    data = bytearray(out.getvalue())
    data[at : at + 40] = bytes(40)
    (tmp_path / "export.zip").write_bytes(bytes(data))
    rows = {r.path: r for r in archives.read(spark, str(tmp_path)).nodes.collect()}
    assert {p: r.kind for p, r in rows.items()} == {"": "container", "/good.json": "file", "/bad.json": "unmatched", "/empty": "folder", "/empty/inner": "folder"}
    assert rows["/bad.json"].reason == "parse_error" and "wrapper_folder" in rows[""].warning


def test_merge(spark):
    both = nodes_of(spark, [("1", "a.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2}])), ("2", "a.json", json.dumps([{"a": 1.5, "c": {"d": 1}}]))])
    found = {r.path: r for r in merge.merged(both).collect()}
    assert (found["/[]/a"].type, found["/[]/a"].n_count, found["/[]/a"].documents) == (["number"], 3, 2)
    assert (found["/[]/b"].n_count, found["/[]/b"].n_present) == (3, 1)
    assert (found["/[]/c"].n_count, found["/[]/c/d"].n_count) == (3, 1)
    assert {r.path: r.documents for r in merge.presence(both).collect()}["/[]/b"] == 1
    kinds = spark.createDataFrame([("1", "/f", "file"), ("1", "/f/[]", "data"), ("2", "/f", "unmatched"), ("2", "/g", "folder"), ("1", "/g", "container"), ("2", "/g/x", "file")], "doc_id string, path string, kind string")
    assert sorted(tuple(r) for r in merge.without_conflicts(kinds).collect()) == [("1", "/f", "file"), ("1", "/f/[]", "data"), ("1", "/g", "container")]


def schema(spark, rows):
    full = [("p", path, kind, path.rpartition("/")[2], list(types), shape, fmt, position) for path, kind, types, shape, fmt, position in rows]
    return spark.createDataFrame(full, "pair string, path string, kind string, name string, type array<string>, shape string, format string, position int")


def test_compare_moves_and_changes(spark):
    before = schema(spark, [("", "container", [], None, None, 0), ("/a", "file", ["array"], None, None, 0), ("/a/[]", "data", ["object"], None, None, 0), ("/a/[]/x", "data", ["integer"], "plain", None, 0), ("/b", "file", ["object"], None, None, 1), ("/b/y", "data", ["string"], "alpha", None, 0)])
    after = schema(spark, [("", "container", [], None, None, 0), ("/n", "folder", [], None, None, 0), ("/n/a", "file", ["array"], None, None, 0), ("/n/a/[]", "data", ["object"], None, None, 0), ("/n/a/[]/x", "data", ["integer"], "plain", None, 0), ("/b", "file", ["object"], None, None, 1), ("/b/y", "data", ["integer", "null"], "mixed", None, 0), ("/b/z", "data", ["string"], "text", None, 1)])
    found = {(r.path, r.status): (list(r.fields), r.other) for r in compare.compare(before, after).collect()}
    assert found == {("/a", "moved_from"): ([], "/n/a"), ("/n/a", "moved_to"): ([], "/a"), ("/n", "added"): ([], None), ("/b/y", "changed"): (["type"], None), ("/b/z", "added"): ([], None)}
    paths = after.select("pair", "path").union(before.select("pair", "path")).distinct()
    status = {r.path: r.status for r in compare.status_of(paths, compare.compare(before, after)).collect()}
    assert status["/n/a/[]/x"] == "moved_to" and status["/a/[]"] == "moved_from" and status["/n"] == "added" and status[""] == "unchanged"


def test_suggestions(spark):
    known = schema(spark, [("", "file", ["array"], None, None, 0), ("/[]", "data", ["object"], None, None, 0), ("/[]/Date", "data", ["string"], "date", "%Y-%m-%d", 0), ("/[]/Title", "data", ["string"], "text", None, 1)])
    new = schema(spark, [("", "file", ["array"], None, None, 0), ("/[]", "data", ["object"], None, None, 0), ("/[]/Datum", "data", ["string"], "date", "%Y-%m-%d", 0), ("/[]/Titel", "data", ["string"], "text", None, 1)])
    got = {(r.path, r.known_path): (r.reason, r.score) for r in compare.suggestions(known, new).where("rank = 0").collect()}
    assert got == {("/[]/Datum", "/[]/Date"): ("renamed", 1.0), ("/[]/Titel", "/[]/Title"): ("renamed", 0.9)}
    seen = {r.path: r.status for r in compare.inspect(known, new).collect()}
    assert seen == {"": "known", "/[]": "known", "/[]/Datum": "matched", "/[]/Titel": "matched"} or seen == {"/[]": "known", "/[]/Datum": "matched", "/[]/Titel": "matched", "": "known"}
    assert compare.share(compare.inspect(known, new)).first().share == 1.0


def test_normalize(spark):
    keys = ["/c/Chat with anna", "/c/Chat with bo", "/c/12345", "/c/67890"]
    rows = [("d", "", None, "file", 0), ("d", "/c", "c", "data", 0)] + [("d", p + t, (p + t).rpartition("/")[2], "data", i) for i, p in enumerate(keys) for t in ("", "/text", "/at")]
    nodes = spark.createDataFrame(rows, "doc_id string, path string, name string, kind string, position int")
    got = {r.path: r.new_path for r in normalize.renames(nodes).collect()}
    assert got["/c/Chat with anna/text"] == "/c/Chat with {*}/text" and got["/c/12345/at"] == "/c/{*}/at" and len(got) == 12
    kept = {r.path: r.new_path for r in normalize.renames(nodes, ["/c/Chat*"], ["/c/1*"]).collect()}
    assert kept["/c/Chat with bo"] == "/c/Chat{*}" and "/c/12345" not in kept
    files = spark.createDataFrame([("f", "m_1.json"), ("f", "m_2.json"), ("f", "x_1.zip"), ("f", "x_2.zip"), ("g", "m_1.json")], "folder string, name string")
    assert sorted(tuple(r) for r in normalize.grouped_names(files).collect()) == [("f", "m_1.json", "m_{n}.json"), ("f", "m_2.json", "m_{n}.json")]


def test_normalized_occurrences_merge(spark):
    rows = spark.createDataFrame([("d", "a.json", json.dumps({"1001": {"n": 1}, "1002": {"n": "x"}}))], "doc_id string, name string, text string")
    values = shred.shred(rows).cache()
    nodes = profile.nodes(values).withColumn("kind", F.lit("data"))
    merged = by_path(profile.nodes(normalize.normalized_occurrences(values, normalize.renames(nodes))))
    assert merged["d", "/{*}/n"].type == ["integer", "string"] and merged["d", "/{*}"].n_present == 2


def observed(spark, rows):
    o = spark.createDataFrame([("p", u, loc, "data", t, s, "", True) for u, loc, t, s in rows], "platform string, upload_id string, location long, kind string, type string, shape string, format string, is_data_point boolean")
    ids = sorted({r[0] for r in rows})
    u = spark.createDataFrame([("p", i, f"2024-01-0{i}", i != "4") for i in ids], "platform string, upload_id string, requested_at string, registered boolean").withColumn("requested_at", F.to_date("requested_at"))
    return o, u


def test_timeline(spark):
    o, u = observed(spark, [("1", 7, "string", "date"), ("2", 7, "null|string", "mixed"), ("3", 7, "integer", "plain"), ("3", 8, "string", "text"), ("4", 9, "string", "text"), ("5", 9, "string", "text"), ("5", 7, "string", "date")])
    assert {(r.upload_id, r.location) for r in timeline.new_in(o, u).collect()} == {("1", 7), ("3", 8), ("4", 9), ("5", 9)}
    assert {(r.upload_id, r.location, r.field): (r.now, list(r.before)) for r in timeline.changes(o, u).collect()} == {("3", 7, "type"): ("integer", ["string"]), ("3", 7, "shape"): ("plain", ["date"])}
    scope = {(r.upload_id, r.location): r.scope for r in timeline.scopes(o, u).collect()}
    assert scope[("2", 7)] == "known" and scope[("3", 8)] == "new" and ("3", 7) not in scope
    best = {r.location: r for r in timeline.profiles(o, u).collect()}
    assert (best[7].uploads, best[7].main_type, best[7].variants) == (4, "string", 4) and best[8].shape_hint == ""
    assert {r.location: r.upload_id for r in timeline.latest(o, u).collect()} == {7: "5", 8: "3", 9: "5"}


def test_missing(spark):
    o, u = observed(spark, [("1", 1, "array", ""), ("1", 2, "object", ""), ("2", 1, "array", ""), ("3", 3, "string", "")])
    places = spark.createDataFrame([("p", 1, "/a", "", "list"), ("p", 2, "/a/[]", "/a", "item"), ("p", 3, "/b", "", "list")], "platform string, location long, path string, parent_path string, annotation string")
    assert {(r.upload_id, r.location) for r in timeline.missing(places, o, u).collect()} == {("3", 2)}
    moved = spark.createDataFrame([("p", "3", "/a/[]")], "platform string, upload_id string, path string")
    assert timeline.missing(places, o, u, moved).count() == 0


def test_decisions(spark):
    rows = [("p", "zip", "1", 1, "h1", None, True), ("p", "zip", "2", 2, "h1", 0.9, False), ("p", "zip", "3", 3, "h3", 0.2, False), ("p", "zip", "4", 4, "h4", 0.5, False), ("p", "csv", "5", 5, "h5", None, False), ("p", "zip", "6", 6, "h6", None, False), ("p", "zip", "7", 7, "h3", 0.7, False)]
    got = {r.upload_id: (r.plausibility, r.reason) for r in curation.decided(spark.createDataFrame(rows, "platform string, root_format string, upload_id string, arrived long, sha256 string, similarity double, approved boolean")).collect()}
    assert got == {"1": ("approved", "first"), "2": ("duplicate", None), "3": ("unconfirmed", "dissimilar"), "4": ("passed", None), "5": ("awaiting", "first"), "6": ("unconfirmed", "dissimilar"), "7": ("passed", None)}


@pytest.mark.parametrize(
    ("kind", "types", "path", "item", "empty", "single", "label"),
    [
        ("media", "", "/x", "", False, False, "media file"), ("data", "string", "/x", "", False, False, "text"), ("data", "null|string", "/x", "", False, False, "text (or empty)"), ("data", "object", "/x", "", False, False, "group of keys"),
        ("data", "object", "/x/[]", "", False, False, "object"), ("data", "object", "/x", "", True, False, "group of keys (always empty so far)"), ("data", "array", "/x", "object", False, False, "list of objects"), ("data", "array", "/x", "", False, True, "empty list"),
        ("data", "array|string", "/x", "integer", False, False, "list of integers or text"), ("file", "array", "/x", "object", False, False, "file: list of objects"), ("data", "null", "/x", "", False, False, "empty"), ("data", "integer|string", "/x", "", False, False, "integer or text"),
    ],
)
def test_labels(spark, kind, types, path, item, empty, single, label):
    row = spark.createDataFrame([(kind, types, path, item, empty, single)], "k string, t string, p string, i string, e boolean, s boolean")
    assert row.select(views.plain_label(*(F.col(c) for c in "ktpies"))).first()[0] == label


def test_skeleton():
    rows = [("", None, "object"), ("/a", "", "array"), ("/a/[]", "/a", "object"), ("/a/[]/x", "/a/[]", "string"), ("/b", "", "object"), ("/b/c", "/b", "integer"), ("/n", "", "integer")]
    assert views.skeleton(rows, "/a/[]/x") == '{\n  "a": [\n    {\n      "x": <string>\n    }\n  ],\n  "b": {…},\n  "n": <integer>\n}'


def test_ingest_reads_each_file_once(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "target", "state"))
    (tmp_path / "landing").mkdir()
    line = lambda i: json.dumps({"upload_id": str(i), "requested_at": f"2024-01-0{i}", "name": "a.json", "text": '{"x": 1}'}) + "\n"
    (tmp_path / "landing" / "1.json").write_text(line(2))
    ingest.ingest(spark, landing, target, state)
    (tmp_path / "landing" / "2.json").write_text(line(1))
    ingest.ingest(spark, landing, target, state)
    ingest.ingest(spark, landing, target, state)
    got = spark.read.parquet(target)
    assert sorted((r.doc_id, r.path) for r in got.collect()) == [("1", ""), ("1", "/x"), ("2", ""), ("2", "/x")]


def test_look_alike_folders_collapse():
    files = [["inbox", "anna_12", "message_1.json"], ["inbox", "anna_12", "photo.jpg"], ["inbox", "bob_7", "message_3.json"], ["inbox", "bob_7", "photo.jpg"], ["other", "x.json"], ["readme.txt"]]
    new, merged = archives.collapsed(files, "", archives.Limits())
    assert new[0] == ["inbox", "{*}", "message_1.json"] and new[3] == ["inbox", "{*}", "photo.jpg"] and new[4:] == files[4:]
    assert merged == {("inbox", "{*}"): (2, "xs0")}
    assert archives.collapsed(files, "", archives.Limits(keep_folders=("/inbox",)))[0] == files
    assert archives.collapsed(files, "", archives.Limits(collapse_folders=("",)))[0][4] == ["{*}", "x.json"]


def test_documents_round_trip(spark):
    nodes = nodes_of(spark, [("d", "a.json", json.dumps([{"b": 1, "a": {"c": None}}]))]).withColumn("kind", F.lit("data"))
    text = documents.to_documents(nodes).first().document
    root = json.loads(text)["root"]
    assert [c["path"] for c in root["children"][0]["children"]] == ["/[]/b", "/[]/a"] and "format" not in root
    back = documents.from_documents(documents.to_documents(nodes))
    assert {(r.path, r.parent_path, r.position) for r in back.collect()} == {(r.path, r.parent_path, r.position) for r in nodes.collect()}


def test_names(spark):
    row = spark.createDataFrame([(r"C:\\x\\Anna_data-2024.json", "mail anna@example.com now", "Chat with {*}", "Chat with bob_1")], "f string, t string, s string, k string")
    assert tuple(row.select(names.anonymous_file_name(F.col("f")), names.masked_addresses(F.col("t")), names.masked_key(F.col("s"), F.col("k")), names.slug(F.lit("My Ärt 2"))).first()) == ("xxxx_data-0000.json", "mail axxx@xxxxxxx.xxx now", "Chat with xs0", "my-rt-2")
    head = spark.createDataFrame([("zip", b"PK\x03\x04.."), ("json", b"  [1"), ("json", b"a"), ("csv", b"a;b\n1"), ("csv", b"plain")], "d string, h binary")
    assert [r.x for r in head.select(names.looks_like(F.col("d"), F.col("h")).alias("x")).collect()] == [True, True, False, True, False]


def test_decisions_are_those_of_one_arrival_after_another(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["zip", "json", None]), f"u{i:03}", rng.randrange(60), rng.choice(["a", "b", "c", "d", "", None]) if rng.random() < 0.6 else f"s{i}", rng.choice([0.1, 0.5, None, float("nan")]), rng.random() < 0.2) for i in range(150)]
    want, taken, counted = {}, set(), set()
    for platform, kind, upload, _, sha, alike, approved in sorted(rows, key=lambda r: (r[3], r[2])):
        reason = None
        if sha and (platform, sha) in taken:
            state = "duplicate"
        elif (platform, kind) not in counted:
            state, reason = ("approved" if approved else "awaiting"), "first"
        elif alike is None or not alike >= 0.3:
            state, reason = "unconfirmed", "dissimilar"
        else:
            state = "passed"
        if sha and state in ("approved", "awaiting", "passed"):
            taken.add((platform, sha))
        if state in ("approved", "passed"):
            counted.add((platform, kind))
        want[upload] = (state, reason)
    found = curation.decided(spark.createDataFrame(rows, "platform string, root_format string, upload_id string, arrived long, sha256 string, similarity double, approved boolean"))
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert {r.upload_id: (r.plausibility, r.reason) for r in found.collect()} == want
