"""Exports read by byte ranges: limits, damage, what is reported, and how the work is dealt out."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from pathloom.__main__ import main as command
from pathloom.schema import nodes_of
from pathloom.sources import archives, shred


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data, *date in files:
            z.writestr(zipfile.ZipInfo(name, *date) if date else name, data, compress_type=method)
    return out.getvalue()


def by_path(exports):
    return {r.path: r for r in exports.nodes.collect()}


def test_reported_fields_and_digests(spark, tmp_path):
    files = [("a.json", '{"é": 1}'.encode("utf-16"), (2024, 5, 6, 7, 8, 10)), ("b.js", "window.YTD.x = [1];"), ("c.csv", "a;b\n1;2\n3;4\n"), ("n_1.jsonl", '{"k": 1}\r{"k": 2}', (2023, 1, 1, 0, 0, 0)), ("n_2.jsonl", "{", (2025, 1, 1, 0, 0, 2)), ("p.bin", b"\x89PNG\r\n\x1a\n"), ("empty/", "")]
    (tmp_path / "e.zip").write_bytes(zipped(files))
    exports = archives.read(spark, str(tmp_path))
    rows = by_path(exports)
    assert (rows["/a.json"].encoding, rows["/a.json"].modified, rows["/a.json"].parser) == ("utf-16-le", "2024-05-06T07:08:10", "json")
    assert (rows["/b.js"].wrapper, rows["/b.js"].parser) == ("window.YTD.x =", "js-json") and (rows["/c.csv"].delimiter, rows["/c.csv"].kind) == (";", "file")
    group = rows["/n_{n}.jsonl"]
    assert (group.files, group.modified, group.warning, group.kind) == (2, "2025-01-01T00:00:02", ["group_member_failed"], "file") and group.size_bytes == 18
    assert (rows["/p.bin"].kind, rows["/p.bin"].mime, rows["/p.bin"].mime_source) == ("media", "image/png", "magic") and rows["/empty"].kind == "folder"
    assert {(r.path, r.s) for r in exports.values.where("s is not null").collect()} == {("/a.json/é", "1"), ("/b.js/[]", "1"), ("/c.csv/[]/a", "1"), ("/c.csv/[]/b", "2"), ("/c.csv/[]/a", "3"), ("/c.csv/[]/b", "4"), ("/n_{n}.jsonl/[]/k", "1"), ("/n_{n}.jsonl/[]/k", "2")}
    data = (tmp_path / "e.zip").read_bytes()
    assert [(r.size_bytes, r.sha256) for r in archives.digests(spark, str(tmp_path)).collect()] == [(len(data), hashlib.sha256(data).hexdigest())]


def test_limits_hold_by_the_directory(spark, tmp_path):
    files = [("a.json", json.dumps(["x" * 100])), ("b.json", json.dumps(["y" * 300])), ("c.json", json.dumps(["z" * 100])), ("d.json", "[1]"), ("m.jpg", b"\xff\xd8\xff" + bytes(5000))]
    (tmp_path / "e.zip").write_bytes(zipped([*files, ("in.zip", zipped([("deep.zip", zipped([("x.json", "[1]")]))]))]))
    rows = by_path(archives.read(spark, str(tmp_path), archives.Limits(max_entry_size=1000, max_total_size=320, max_depth=2)))
    assert {p: (r.kind, r.reason) for p, r in rows.items()} == {"": ("container", None), "/a.json": ("file", None), "/b.json": ("unmatched", "too_large"), "/c.json": ("file", None), "/d.json": ("file", None), "/m.jpg": ("media", None), "/in.zip": ("unmatched", "too_large")}
    rows = by_path(archives.read(spark, str(tmp_path), archives.Limits(max_depth=2)))
    assert rows["/in.zip"].kind == "container" and (rows["/in.zip/deep.zip"].kind, rows["/in.zip/deep.zip"].reason) == ("unmatched", "too_large")
    rows = by_path(archives.read(spark, str(tmp_path), archives.Limits(max_entries=2)))
    assert set(rows) == {"", "/a.json", "/b.json"} and rows[""].warning == ["too_many_entries"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "big.json").write_text("[" + "1," * 600 + "1]")
    single = by_path(archives.read(spark, str(tmp_path / "one"), archives.Limits(max_entry_size=1000)))
    assert (single[""].kind, single[""].reason) == ("unmatched", "too_large")


def test_damage_stays_where_it_is(spark, tmp_path):
    good = zipped([("a.json", json.dumps(list(range(900)))), ("b.json", "[2]"), ("in.zip", zipped([("x.json", "[1]"), ("y.json", "{")]))])
    with zipfile.ZipFile(io.BytesIO(good)) as z:
        at = z.getinfo("a.json").header_offset + 30 + len("a.json")
    bad = bytearray(good)
    bad[at + 20 : at + 30] = bytes(10)
    (tmp_path / "bad.zip").write_bytes(bytes(bad))
    (tmp_path / "not.zip").write_bytes(b"PK\x03\x04" + bytes(50))
    stored = bytearray(zipped([("s.json", "[12345]")], zipfile.ZIP_STORED))
    stored[stored.index(b"[12345]") + 1] = ord("9")
    (tmp_path / "sum.zip").write_bytes(bytes(stored))
    rows = {(r.doc_id.rsplit("/", 1)[-1], r.path): r for r in archives.read(spark, str(tmp_path)).nodes.collect()}
    assert {k: (r.kind, r.reason) for k, r in rows.items()} == {
        ("bad.zip", ""): ("container", None), ("bad.zip", "/a.json"): ("unmatched", "parse_error"), ("bad.zip", "/b.json"): ("file", None), ("bad.zip", "/in.zip"): ("container", None),
        ("bad.zip", "/in.zip/x.json"): ("file", None), ("bad.zip", "/in.zip/y.json"): ("unmatched", "parse_error"), ("not.zip", ""): ("unmatched", "parse_error"),
        ("sum.zip", ""): ("container", None), ("sum.zip", "/s.json"): ("unmatched", "parse_error"),
    }


def test_one_large_zip_is_many_tasks_and_parsed_once(spark, tmp_path, monkeypatch):
    """Members of one export come from several tasks; a member is read from its own range only."""
    (tmp_path / "z").mkdir()
    names = [f"folder/{chr(97 + i % 26)}{chr(97 + i // 26)}.json" for i in range(60)]
    data = zipped([(n, json.dumps([i])) for i, n in enumerate(names)])
    (tmp_path / "z" / "e.zip").write_bytes(data)
    exports = archives.read(spark, str(tmp_path / "z"))
    assert exports.values.where("json_type = 'integer'").count() == 60 and exports.values.select("path", "ord").distinct().count() == 120
    plan = [r for r in archives.plan_of(str(tmp_path / "z" / "e.zip"), archives.Limits()) if "offset" in r]
    assert len(plan) == 60 and sum(r["packed"] for r in plan) < len(data)

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    stream, parses = Counting(data), []
    real = shred.read_bytes
    monkeypatch.setattr(shred, "read_bytes", lambda *a: parses.append(a[0]) or real(*a))
    found = list(archives._read({**plan[7], "doc_id": "d"}, stream, archives.Limits()))
    assert found[0]["kind"] == "file" and len(parses) == 1 and stream.taken < 500


def test_empty_folder_of_exports(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    none = archives.read(spark, str(tmp_path), archives.Limits())
    assert none.nodes.count() == 1 and none.values.select(F.max("json_type")).first()[0] == "array"



def test_schema_of_an_export_in_one_call(spark, tmp_path, capsys):
    files = [("me/anna.JPG", b"\xff\xd8\xff1"), ("me/bo.jpg", b"\xff\xd8\xff22"), ("c.json", json.dumps({"123": {"n": 1}, "456": {"n": "x"}})), ("a.txt", "plain"), ("x/1/m.json", "[1]"), ("x/2/m.json", "[2]")]
    (tmp_path / "e.zip").write_bytes(zipped(files))
    rows = {r.path: r for r in nodes_of(spark, str(tmp_path / "e.zip"), samples=1).collect()}
    assert {p: r.kind for p, r in rows.items()} == {"": "container", "/me": "folder", "/me/{*}.jpg": "media", "/c.json": "file", "/c.json/{*}": "data", "/c.json/{*}/n": "data", "/a.txt": "unmatched", "/x": "folder", "/x/{*}": "folder", "/x/{*}/m.json": "file", "/x/{*}/m.json/[]": "data"}
    media = rows["/me/{*}.jpg"]
    assert (media.name, media.files, media.size_bytes) == ("x.jpg", 2, 9) and rows["/c.json/{*}/n"].type == ["integer", "string"] and rows["/c.json"].type == ["object"] and rows["/c.json"].encoding == "utf-8"
    assert [rows[p].position for p in ("/a.txt", "/c.json", "/me", "/x")] == [0, 1, 2, 3]
    assert command([str(tmp_path / "e.zip"), "--keep", "/x"], spark) == 0
    root = json.loads(capsys.readouterr().out)["root"]
    assert [c["path"] for c in root["children"]] == ["/a.txt", "/c.json", "/me", "/x"] and [c["path"] for c in root["children"][3]["children"]] == ["/x/1", "/x/2"]
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04" + bytes(9))
    assert command([str(tmp_path / "bad.zip")], spark) == 1 and command([str(tmp_path / "none.zip")], spark) == 1
    (tmp_path / "only.zip").write_bytes(zipped([("a.txt", "no values")]))
    assert command([str(tmp_path / "only.zip")], spark) == 0
