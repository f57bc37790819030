"""References, renormalizing, moved curation, replayed suggestions and exclusive matching against plain versions."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom.functions import names
from pathloom.operators import compare, normalize, proposals, references, renormalize, review
from pathloom.plans import workflows
from pathloom.sources import archives, shred

SF = "/root/testdata/sf0.001"
NODE = "pair string, path string, kind string, name string, type array<string>, shape string, format string, position int"


def schema(spark, rows, pair="p"):
    full = [(pair, path, kind, path.rpartition("/")[2], list(types), shape, None, position) for path, kind, types, shape, position in rows]
    return spark.createDataFrame(full, NODE)


# --- exclusive matching -------------------------------------------------------------------------------------------


def test_a_taken_structure_is_no_candidate_of_later_ones(spark):
    known = schema(spark, [("", "file", ["object"], None, 0), ("/x", "data", ["object"], None, 0), ("/x/k", "data", ["integer"], "plain", 0)])
    new = schema(spark, [("", "file", ["object"], None, 0), ("/a", "data", ["object"], None, 0), ("/a/k", "data", ["integer"], "plain", 0), ("/b", "data", ["object"], None, 1), ("/b/k", "data", ["integer"], "plain", 0)])
    got = {(r.path, r.known_path, r.reason, r.score) for r in compare.suggestions(known, new).collect()}
    assert got == {("/a/k", "/x/k", "moved", 1.0)}


def plain_suggestions(known, new):
    """Suggestions for dictionaries {path: node}, one new node after the other in file order (parents first); no moves."""
    below = lambda tree, p: {q[len(p) :] for q in tree if q == p or q.startswith(p + "/")}
    kids = lambda tree, p: sorted((q for q in tree if q and q.rpartition("/")[0] == p), key=lambda q: (tree[q]["position"], q))
    to_known, out = {}, {}

    def mapped(p):
        if p in known:
            return p, 1.0
        for q in sorted(to_known, key=len, reverse=True):
            if p.startswith(q + "/") or p == q:
                return to_known[q][0] + p[len(q) :], to_known[q][1]
        return None, 0.0

    def taken(p):
        if p in new:
            return True
        for q, (old, _) in to_known.items():
            if p == old or p.startswith(old + "/"):
                return q + p[len(old) :] in new
        return False

    order, todo = [], [""]
    while todo:
        p = todo.pop()
        order.append(p)
        todo += reversed(kids(new, p))
    for p in order:
        node = new[p]
        if p in known or not p:
            continue
        at, sure = mapped(p)
        if at in known:
            out[p] = [(at, "moved", sure)]
            continue
        up = p.rpartition("/")[0]
        home, sure = mapped(up)
        if home not in known:
            continue
        place = kids(new, up).index(p)
        structure = bool({"object", "array"} & set(node["type"]))
        real = lambda n: sorted(t for t in n["type"] if t != "null")
        found = []
        for i, q in enumerate(kids(known, home)):
            other = known[q]
            noisy = lambda n: n["shape"] in (None, "mixed", "empty")
            if taken(q) or other["kind"] != node["kind"] or real(other) != real(node) or (not noisy(node) and not noisy(other) and node["shape"] != other["shape"]):
                continue
            score = 0.5 + 0.3 * (i == place)
            if structure:
                a, b = below(new, p), below(known, q)
                share = len(a & b) / len(a | b)
                if share < 0.5:
                    continue
                score += 0.2 * share
            elif node["shape"] and node["shape"] == other["shape"]:
                score += 0.1
            found.append((q, "renamed", round(score * sure, 2)))
        found.sort(key=lambda c: -c[2])
        if found:
            out[p] = found
            if structure and (len(found) == 1 or found[0][2] > found[1][2]):
                to_known[p] = (found[0][0], found[0][2])
    return {p: c for p, c in out.items() if new[p]["kind"] == "data" and real_point(new[p])}


def real_point(node):
    return [t for t in node["type"] if t != "null"] != ["object"]


def tree(rng, names_):
    """A file of objects with values; names are drawn twice over, so that no name and kind stands once and nothing moves."""
    nodes = {"": {"kind": "file", "type": ["object"], "shape": None, "position": 0}}
    for i, a in enumerate(rng.sample(names_, 4)):
        nodes[f"/{a}"] = {"kind": "data", "type": ["object"], "shape": None, "position": i}
        for j, b in enumerate(rng.sample(["k", "l", "m", "n", "o"], 3)):
            inner = rng.random() < 0.3
            nodes[f"/{a}/{b}"] = {"kind": "data", "type": ["object"] if inner else [rng.choice(["integer", "string"])], "shape": None if inner else rng.choice(["plain", "text", "mixed"]), "position": j}
            if inner:
                nodes[f"/{a}/{b}/z"] = {"kind": "data", "type": ["integer"], "shape": "plain", "position": 0}
    return nodes


def test_suggestions_equal_one_node_after_the_other(spark):
    rng = random.Random(4)
    sides, want = ([], []), {}
    for n in range(40):
        known, new = tree(rng, list("ABCDEF")), tree(rng, list("CDEFGH"))
        for side, nodes in zip(sides, (known, new)):
            side += [(str(n), p, x["kind"], "same", x["type"], x["shape"], None, x["position"]) for p, x in nodes.items()]
        want |= {(str(n), p): [(c[0], c[1], c[2]) for c in found] for p, found in plain_suggestions(known, new).items()}
    got = defaultdict(list)
    for r in compare.suggestions(*(spark.createDataFrame(side, NODE) for side in sides)).orderBy("rank").collect():
        got[r.pair, r.path].append((r.known_path, r.reason, r.score))
    loose = lambda found: sorted(found, key=lambda c: (-c[2], c[0]))
    assert {k: loose(v) for k, v in got.items()} == {k: loose(v) for k, v in want.items()}
    assert {k: v[0][2] for k, v in got.items()} == {k: v[0][2] for k, v in want.items()}


# --- references ---------------------------------------------------------------------------------------------------


def test_suggestions_of_all_uploads_and_late_registrations(spark, monkeypatch):
    uploads = workflows.page_uploads(spark, SF).cache()
    nodes = workflows.page_nodes(spark, SF).cache()
    whole = {tuple(r) for r in references.suggested(uploads, nodes).collect()}
    assert whole

    # one upload at a time: its references as they were before it, merged by as_of for its day alone
    rows = uploads.where("registered").collect()
    some = [r for r in rows if any(w[0] == r.platform and w[1] == r.upload_id for w in whole)][:3]
    for u in some:
        earlier = uploads.where((F.col("platform") == u.platform) & F.col("registered") & (F.col("requested_at") < F.lit(u.requested_at)))
        best = {}
        known_paths = {r.path for r in nodes.join(earlier, ["platform", "upload_id"], "left_semi").select("path").collect()}
        for fmt in sorted({r.root_format for r in earlier.collect()}):
            known = references.as_of(earlier, nodes, uploads.where((F.col("platform") == u.platform) & (F.col("upload_id") == u.upload_id))).where(F.col("root_format") == fmt).withColumn("pair", F.lit("x"))
            new = nodes.where((F.col("platform") == u.platform) & (F.col("upload_id") == u.upload_id)).withColumn("pair", F.lit("x"))
            for r in compare.suggestions(known, new).collect():
                if r.path not in known_paths:
                    key = (r.path, r.known_path)
                    best[key] = min(best.get(key, (9, "", 0)), (-r.score, fmt, r["rank"], r.reason))
        mine = {(w[2], w[3]): (w[4], w[5]) for w in whole if w[0] == u.platform and w[1] == u.upload_id}
        assert mine == {k: (v[3], -v[0]) for k, v in best.items()}

    # a late registration changes what a full run would say, and only it and later uploads run again
    late = uploads.where("registered").orderBy("requested_at").limit(30).where("created_at % 2 = 0").select("platform", "upload_id")
    before = uploads.join(late.withColumn("_late", F.lit(True)), ["platform", "upload_id"], "left").withColumn("registered", F.col("registered") & F.col("_late").isNull()).drop("_late")
    stored = references.suggested(before, nodes).cache()
    again = {tuple(r) for r in references.suggested_again(stored, uploads, nodes, late).collect()}
    assert again == whole
    asked = []
    real = references.as_of
    monkeypatch.setattr(references, "as_of", lambda u, n, dates, *a: asked.append({tuple(r) for r in dates.select("platform", "requested_at").collect()}) or real(u, n, dates, *a))
    references.suggested_again(stored, uploads, nodes, late)
    first = {r.platform: r.day for r in uploads.join(late, ["platform", "upload_id"]).groupBy("platform").agg(F.min("requested_at").alias("day")).collect()}
    assert asked and all(day >= first[p] for p, day in asked[0])


def test_references_empty(spark):
    uploads, nodes = workflows.page_uploads(spark, SF), workflows.page_nodes(spark, SF)
    assert references.suggested(uploads.where("false"), nodes).count() == 0
    assert references.suggested(uploads, nodes.where("false")).count() == 0
    assert references.as_of(uploads, nodes, uploads.where("false")).count() == 0


def test_annotation_choices_and_rules(spark):
    found = spark.createDataFrame([("p", "u", "/n", k, "renamed", s, r) for k, s, r in (("/a", 0.9, 0), ("/b", 0.8, 1), ("/c", 0.7, 2))], "platform string, upload_id string, path string, known_path string, reason string, score double, rank int")
    loc = spark.createDataFrame([("p", "/a", None), ("p", "/b", "B"), ("p", "/c", "B"), ("q", "/a", "Q")], "platform string, path string, annotation string")
    assert [(r.annotation, r.score, r.via, r["rank"]) for r in references.annotation_choices(found, loc).collect()] == [("B", 0.8, "/b", 0)]
    rules = references.path_rules(spark.createDataFrame(workflows.RULES, "platform string, kind string, pattern string")).collect()
    assert {r.platform: (r.variable_keys, r.keep_keys) for r in rules}["2"] == ([], ["/chats/Chat with *", "/chats/[0-9]*"])


# --- renormalizing ------------------------------------------------------------------------------------------------

STORED = "doc_id string, path string, parent_path string, name string, kind string, type array<string>, shape string, shapes array<struct<shape: string, n: bigint>>, format string, n_present long, n_null long, n_count long, position int, reason string"


def stored(spark, rows, doc='{"platform":"p","upload_id":"1"}'):
    full = []
    for path, kind, name, *more in rows:
        shape = more[0] if more else None
        full.append((doc, path, path.rpartition("/")[0] if path else None, name, kind, ["string"] if shape else ["object"] if kind == "data" else [], shape, [(shape, 2)] if shape else None, None, 2, 0, 2, 0, more[1] if len(more) > 1 else None))
    return spark.createDataFrame(full, STORED)


def test_wrapper_and_keys_compose_and_settle(spark):
    rows = [("", "container", "Export-2024.zip"), ("/export-2024", "folder", "export-2024"), ("/__MACOSX", "folder", "__MACOSX"), ("/__MACOSX/._a", "unmatched", "._a", None, "ignored"), ("/export-2024/in.zip", "container", "in.zip"), ("/export-2024/in.zip/IN (1)", "folder", "IN (1)"),
            ("/export-2024/in.zip/IN (1)/c.json", "file", "c.json")]
    rows += [(f"/export-2024/in.zip/IN (1)/c.json/{k}{t}", "data", (k + t).rpartition("/")[2], s) for k in ("Chat with anna", "Chat with bo") for t, s in (("", None), ("/text", "text"))]
    rows += [("/export-2024/me.JPG", "media", "me.JPG"), ("/export-2024/you.jpg", "media", "you.jpg")]
    nodes = stored(spark, rows)
    lifts = {r.path: r.new_path for r in renormalize.lifted(nodes).collect()}
    assert lifts["/export-2024"] == "" and lifts["/export-2024/in.zip"] == "/in.zip" and lifts["/export-2024/in.zip/IN (1)"] == "/in.zip" and lifts["/export-2024/in.zip/IN (1)/c.json"] == "/in.zip/c.json"
    map_, report, new = renormalize.renormalized(nodes, {"p": ["/in.zip/c.json/Chat with *"]}, {})
    assert {r.path: r.new_path for r in map_.collect()}["/export-2024/in.zip/IN (1)/c.json/Chat with bo/text"] == "/in.zip/c.json/Chat with {*}/text"
    assert [(r.platform, r.uploads) for r in report.collect()] == [("p", 1)]
    after = {r.path: r for r in new.collect()}
    assert set(after) == {"", "/__MACOSX", "/__MACOSX/._a", "/in.zip", "/in.zip/c.json", "/in.zip/c.json/Chat with {*}", "/in.zip/c.json/Chat with {*}/text", "/{*}.jpg"}
    chat = after["/in.zip/c.json/Chat with {*}"]
    assert (chat.name, chat["keys"], chat.n_present, chat.kind) == ("Chat with x", 2, 4, "data") and after["/in.zip/c.json/Chat with {*}/text"].shapes[0].n == 4
    assert after["/{*}.jpg"].name == "x.jpg" and after["/{*}.jpg"]["keys"] == 2
    again = new.withColumn("reason", F.when(F.col("path").contains("MACOSX/"), "ignored"))
    assert renormalize.renamed_paths(again, {"p": ["/in.zip/c.json/Chat with *"]}).count() == 0


def test_no_wrapper(spark):
    two = stored(spark, [("", "container", "a.zip"), ("/a", "folder", "a"), ("/a/x.json", "file", "x.json"), ("/y.json", "file", "y.json")])
    other = stored(spark, [("", "container", "b.zip"), ("/a", "folder", "a"), ("/a/x.json", "file", "x.json")])
    empty = stored(spark, [("", "container", "a.zip"), ("/a", "folder", "a")])
    assert [renormalize.lifted(n).count() for n in (two, other, empty)] == [0, 0, 0]
    masked = stored(spark, [("", "container", "xx-0000.zip"), ("/ab-2024 - Copy", "folder", "ab-2024 - Copy"), ("/ab-2024 - Copy/x.json", "file", "x.json")])
    assert {r.new_path for r in renormalize.lifted(masked).collect()} == {"", "/x.json"}


def test_unchanged_documents_are_not_rewritten(spark):
    still = stored(spark, [("", "file", "a.json"), ("/k", "data", "k", "text")], '{"platform":"p","upload_id":"2"}')
    moves = stored(spark, [("", "file", "a.json"), ("/123", "data", "123", "text")])
    map_, _, new = renormalize.renormalized(still.unionByName(moves), {}, {})
    assert {r.doc_id for r in new.collect()} == {'{"platform":"p","upload_id":"1"}'} and map_.count() == 1


def test_words_choose_larger_patterns_first(spark):
    rng = random.Random(2)
    keys = [f"{a} {b} {c}" for a in "AB" for b in ("of", "to") for c in "xyz"] + ["lonely key", "no", "Ab  double"]
    rows = [("d", "", None, "file")] + [("d", f"/{k}{t}", (k + t).rpartition("/")[2], "data") for k in keys for t in ("", "/p", "/q" if rng.random() < 0.9 else "/r")]
    got = {r.path: r.new_path for r in normalize.renames(spark.createDataFrame(rows, "doc_id string, path string, name string, kind string").distinct()).collect()}
    assert got["/A of x"] == "/A of {*}" and got["/B to z/p"] == "/B to {*}/p"


def test_chains_and_circles_of_moves(spark):
    moves = spark.createDataFrame([("p", "/a", "/b", 1), ("p", "/b", "/c", 2), ("p", "/c", "/d", 3), ("p", "/x", "/y", 4), ("p", "/y", "/x", 5), ("p", "/s", "/s", 6)], "platform string, path string, new_path string, ord int")
    assert {(r.path, r.new_path) for r in renormalize.ends(moves, rounds=4).collect()} >= {("/a", "/d"), ("/b", "/d"), ("/c", "/d")}


def test_curation_moves_and_proposals_follow(spark):
    loc = [(1, "/o1", "A", False, ["v", "v"]), (2, "/o2", "B", False, ["w", "v"]), (3, "/n", None, True, ["n"]), (4, "/o3", None, True, []), (5, "/m", None, False, []), (6, "/o4", "C", False, []), (7, "/k", "K", False, []), (8, "/o5", "K", False, ["z"])]
    locations = spark.createDataFrame([("p", *r) for r in loc], "platform string, location long, path string, annotation string, ignored boolean, examples array<string>")
    moves = spark.createDataFrame([("p", "/o1", "/n", 1), ("p", "/o2", "/n", 2), ("p", "/o3", "/m", 3), ("p", "/o4", "/n", 4), ("p", "/o5", "/k", 5), ("p", "/gone", "/n", 6), ("p", "/k", "/nowhere", 7)], "platform string, path string, new_path string, ord int")
    observed = spark.createDataFrame([("p", 6)], "platform string, location long")
    after, conflicts, moved = renormalize.moved_curation(locations, moves, observed)
    got = {r.path: (r.annotation, r.ignored, list(r.examples)) for r in after.collect()}
    assert got == {"/n": ("A", False, ["n", "v", "v", "w"]), "/m": (None, True, []), "/o4": ("C", False, []), "/k": ("K", False, ["z"])}
    assert [tuple(r) for r in conflicts.collect()] == [("p", "/n", "A", "B")]
    assert {(r.location, r.new_location) for r in moved.collect()} == {(1, 3), (2, 3), (4, 5), (8, 7)}
    row = "array<struct<subject: string, role: int, location: bigint>>"
    made = spark.createDataFrame([(1, "p", 1, [2, 9, 1, 3], [("s", 1, 4), ("s", 1, 9)], None), (2, "p", None, None, None, [("t", 2, 8)]), (3, "q", 1, [1], None, None)], f"proposal_id long, platform string, location long, also array<bigint>, metadata {row}, base_metadata {row}")
    out = {r.proposal_id: r for r in renormalize.remapped_proposals(made, moved).collect()}
    assert (out[1].location, out[1].also, [x.location for x in out[1].metadata]) == (3, [3, 9], [5, 9])
    assert out[2].base_metadata[0].location == 7 and (out[3].location, out[3].also) == (1, [1])
    links = spark.createDataFrame([("p", 10, 1, "s", 1), ("p", 10, 1, "s", 2), ("p", 11, 1, "s", 9)], "platform string, representation long, role int, subject string, location long")
    assert {(r.representation, r.location) for r in renormalize.remapped_links(links, moved).collect()} == {(10, 3), (11, 9)} and renormalize.remapped_links(links, moved).count() == 2


def test_named_like(spark):
    cases = [("Export", "export.zip", True), ("Export (2)", "export.zip", True), ("ab-12", "xx-00.zip", True), ("ab-1", "xx-00.zip", False), ("x", "a.zip", False), ("a", "x.zip", True), ("data", "data.tar", True), ("same", "same", True)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean").select(names.named_like(F.col("a"), F.col("b")).alias("got"), "want", "a", "b").collect()
    assert [(r.a, r.b, r.got) for r in rows] == [(r.a, r.b, r.want) for r in rows]
    assert [archives._same(a, b) for a, b, _ in cases] == [w for *_, w in cases]


# --- samples and lines --------------------------------------------------------------------------------------------


def test_merged_samples_equal_a_left_fold(spark):
    rng = random.Random(8)
    lists = {p: [rng.sample("abcdefg", rng.randint(0, 4)) for _ in range(rng.randint(1, 7))] for p in range(60)}
    rows = [(str(p), i, v) for p, own in lists.items() for i, v in enumerate(own)] + [("x", 0, ["a"]), ("x", 1, ["b"]), ("x", 2, ["c", "d"])]
    got = {r.path: list(r.samples) for r in review.merged_samples(spark.createDataFrame(rows, "path string, part int, samples array<string>")).collect()}
    assert got.pop("x") == ["a", "c"]
    for p, own in lists.items():
        have = own[0]
        for v in own[1:]:
            have = list(dict.fromkeys(have + v))[: max(len(have), len(v))]
        assert got[str(p)] == have


def test_json_lines_end_in_any_way():
    assert shred.read_json_lines('{"a": 1}\r{"a": 2}\r\n\n{"a": 3}') == [{"a": 1}, {"a": 2}, {"a": 3}]
    assert shred.read_json('{"a": 1}\r{"a": 2}') == [{"a": 1}, {"a": 2}]


# --- suggestions replayed -----------------------------------------------------------------------------------------


def plain_replay(made, targets):
    """All events of the world in one order, with plain tables; returns statuses and states."""
    states, where = {t: json.loads(s) for t, _, s in targets}, {t: p for t, p, _ in targets}
    props = {p["proposal_id"]: dict(p, values=json.loads(p["values"]), status=None, by=None) for p in made}
    for p in props.values():
        k = p["kind"]
        p["target"] = f"location:{p['location']}" if k in proposals.LOCATION_KINDS else f"annotation:{p['annotation']}" if k == "edit_annotation" else f"representation:r{p['proposal_id']}" if k == "new_representation" else f"representation:{p['representation']}"
    events = sorted([(p["created_at"], 1, i) for i, p in props.items()] + [(p["decided_at"], 2, i) for i, p in props.items() if p["action"]])

    def now(p):
        s = states.get(p["target"])
        return {"exists": s is not None} if p["kind"] == "delete_representation" else {} if p["kind"] == "new_representation" or s is None else s

    def possible(p):
        k, v = p["kind"], p["values"]
        if k in proposals.LOCATION_KINDS and p["target"] not in states:
            return False
        if k in ("new_annotation", "edit_annotation") and not (v.get("name") or "").strip():
            return False
        if k == "new_annotation" and any(where.get(f"location:{x}") != p["platform"] for x in v.get("also", [])):
            return False
        return not (k in ("edit_annotation", "edit_representation", "delete_representation") and states.get(p["target"]) is None)

    def do(p):
        k, v, t = p["kind"], p["values"], p["target"]
        fields = {"name": v.get("name", ""), "description": v.get("description", ""), "note": v.get("note", ""), "pii": v.get("pii", False)}
        if k == "link":
            states[t] = {"annotation": p["annotation"], "ignored": False}
        elif k in ("ignore", "unassign"):
            states[t] = {"annotation": None, "ignored": k == "ignore"}
        elif k == "new_annotation":
            states[f"annotation:a{p['proposal_id']}"] = fields
            for x in v.get("also", []):
                if f"location:{x}" != t and states[f"location:{x}"] == {"annotation": None, "ignored": False}:
                    states[f"location:{x}"] = {"annotation": f"a{p['proposal_id']}", "ignored": False}
            states[t] = {"annotation": f"a{p['proposal_id']}", "ignored": False}
        elif k == "edit_annotation":
            states[t] = fields
        elif k == "delete_representation":
            states[t] = None
        else:
            links = v["metadata"] if "metadata" in v else (states.get(t) or {}).get("metadata", [])
            states[t] = {a: b for a, b in v.items() if a != "metadata"} | {"metadata": links}

    def rivals(p):
        same = lambda q: (q["kind"] in proposals.LOCATION_KINDS and p["kind"] in proposals.LOCATION_KINDS) or (q["kind"] == p["kind"] != "new_representation")
        return [q for q in props.values() if q is not p and q["status"] == "open" and q["target"] == p["target"] and same(q)]

    for at, turn, i in events:
        p = props[i]
        if turn == 1:
            p["base"] = dict(now(p))
            if not possible(p):
                p["status"] = "invalid"
            elif p["staff"]:
                do(p)
                p["status"] = "applied"
            else:
                for q in rivals(p):
                    if q["proposed_by"] == p["proposed_by"]:
                        q["status"] = "withdrawn"
                p["status"] = "open"
        elif p["status"] == "open":
            if p["action"] != "accept":
                p["status"] = {"reject": "rejected", "withdraw": "withdrawn"}[p["action"]]
            elif (now(p) == p["base"] or p["stale_ok"]) and possible(p):
                do(p)
                for q in rivals(p):
                    q["status"], q["by"], q["when"] = "superseded", i, at
                p["status"], p["when"] = "accepted", at
    return {i: (p["status"], p["base"], p["by"], p["status"] == "open" and now(p) != p["base"]) for i, p in props.items()}, states


def test_replay_equals_plain_replay(spark):
    made, targets = workflows.event_proposals(spark, SF), workflows.event_targets(spark, SF)
    found, states = proposals.replayed(made, targets)
    want, after = plain_replay([r.asDict() for r in made.collect()], [tuple(r) for r in targets.select("target", "platform", "state").collect()])
    got = {r.proposal_id: (r.status, json.loads(r.base), r.superseded_by, r.stale) for r in found.collect()}
    assert got == want and {"accepted", "superseded", "open", "withdrawn", "rejected", "applied", "invalid"} <= {g[0] for g in got.values()}
    assert any(g[3] for g in got.values())
    assert {r.target: r.state and json.loads(r.state) for r in states.collect()} == after


def one(**k):
    base = {"proposal_id": 1, "kind": "link", "platform": "p", "location": "1", "annotation": None, "representation": None, "annotation_platform": "p", "values": "{}", "proposed_by": 1, "staff": False, "created_at": 1, "action": None, "decided_at": None, "stale_ok": False}
    return {**base, **k}


PROPOSALS = "proposal_id long, kind string, platform string, location string, annotation string, representation string, annotation_platform string, values string, proposed_by long, staff boolean, created_at long, action string, decided_at long, stale_ok boolean"
FREE = '{"annotation": null, "ignored": false}'


def replay(spark, rows, targets):
    keys = [c.split()[0] for c in PROPOSALS.split(", ")]
    made = spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], PROPOSALS)
    found, states = proposals.replayed(made, spark.createDataFrame(targets, "target string, platform string, state string"))
    return {r.proposal_id: r for r in found.collect()}, {r.target: r.state and json.loads(r.state) for r in states.collect()}


def test_cases_of_acceptance(spark):
    targets = [("location:1", "p", FREE), ("location:2", "p", FREE), ("location:3", "q", FREE)]
    rows = [
        one(proposal_id=1, annotation="A", created_at=1, action="accept", decided_at=10),
        one(proposal_id=2, kind="ignore", created_at=2, proposed_by=2),
        one(proposal_id=3, kind="unassign", created_at=11, proposed_by=3, action="accept", decided_at=20),
        one(proposal_id=4, kind="ignore", created_at=12, proposed_by=4, action="accept", decided_at=21),
        one(proposal_id=5, annotation="B", annotation_platform="q", created_at=13),
        one(proposal_id=6, kind="new_annotation", values='{"name": "N", "also": ["2"]}', created_at=30, proposed_by=5, action="accept", decided_at=31),
        one(proposal_id=7, kind="edit_annotation", location=None, annotation="a6", values='{"name": "M", "pii": true}', created_at=32, staff=True),
        one(proposal_id=8, kind="new_annotation", values='{"name": "N", "also": ["3"]}', created_at=33),
        one(proposal_id=9, kind="ignore", location="2", created_at=34, proposed_by=6),
        one(proposal_id=10, annotation="A", location="2", created_at=35, proposed_by=6, action="withdraw", decided_at=36),
    ]
    got, states = replay(spark, rows, targets)
    assert {i: r.status for i, r in got.items()} == {1: "accepted", 2: "superseded", 3: "accepted", 4: "superseded", 5: "invalid", 6: "accepted", 7: "applied", 8: "invalid", 9: "withdrawn", 10: "withdrawn"}
    assert (got[2].superseded_by, got[2].decided_at, got[1].decided_at) == (1, 10, 10) and json.loads(got[3].base) == {"annotation": "A", "ignored": False}
    assert states["location:1"]["annotation"] == states["location:2"]["annotation"] == "a6" and states["annotation:a6"] == {"name": "M", "description": "", "note": "", "pii": True} and states["location:3"] == json.loads(FREE)


def test_stale_acceptance_and_representations(spark):
    targets = [("location:1", "p", FREE), ("representation:5", "p", '{"metadata": [{"subject": "a", "role": 1, "location": 2}], "name": "R"}')]
    edit = lambda i, v, at, **k: one(proposal_id=i, kind="edit_representation", location=None, representation="5", values=json.dumps(v), created_at=at, proposed_by=i, **k)
    rows = [
        one(proposal_id=1, kind="ignore", created_at=1, action="accept", decided_at=5),
        one(proposal_id=2, kind="link", annotation="A", created_at=2, staff=True),
        edit(3, {"name": "S"}, 1, action="accept", decided_at=2),
        edit(4, {"name": "T"}, 3, action="accept", decided_at=9, stale_ok=True),
        one(proposal_id=5, kind="delete_representation", location=None, representation="5", created_at=4, proposed_by=9, action="accept", decided_at=8),
        one(proposal_id=6, kind="new_representation", values='{"name": "New", "metadata": []}', created_at=6, action="accept", decided_at=7),
    ]
    got, states = replay(spark, rows, targets)
    assert {i: r.status for i, r in got.items()} == {1: "open", 2: "applied", 3: "accepted", 4: "open", 5: "accepted", 6: "accepted"}
    assert got[1].stale and got[4].stale and json.loads(got[4].base)["metadata"][0]["location"] == 2
    assert states["representation:5"] is None and states["representation:r6"] == {"name": "New", "metadata": []}


def test_changes_in_words(spark):
    rows = [(1, "link", "A", "{}", '{"annotation": null, "ignored": true}'), (2, "new_annotation", None, '{"name": "N", "note": "x"}', '{"annotation": "B", "ignored": false}'), (3, "edit_annotation", "A", '{"name": "M", "pii": true}', '{"name": "N", "pii": false, "note": ""}'), (4, "delete_representation", None, '{"representation": "R"}', "{}")]
    frame = spark.createDataFrame(rows, "proposal_id long, kind string, annotation string, values string, base string")
    assert {tuple(r) for r in proposals.changes(frame).collect()} == {(1, "annotation", "not a data point", "A"), (2, "annotation", "B", "new: N"), (2, "note", "", "x"), (3, "name", "N", "M"), (3, "pii", "no", "yes"), (4, "representation", "R", "none")}
    keys = frame.select("proposal_id", proposals.group_key(F.col("kind"), F.lit(None), F.col("annotation"), F.lit("7")).alias("k")).collect()
    assert {r.proposal_id: r.k for r in keys} == {1: "location:7", 2: "location:7", 3: "annotation:A", 4: "location:7"}


def test_states_tell_what_may_be_done(spark):
    rows = [("1", "done", "passed", True), ("2", "done", "unconfirmed", False), ("3", "failed", "awaiting", False), ("4", "done", "awaiting", False), ("5", "parsing", "approved", True)]
    uploads = spark.createDataFrame(rows, "upload_id string, status string, plausibility string, registered boolean").withColumns({"platform": F.lit("p"), "has_document": F.col("status") == "done"})
    got = {r.upload_id: (r.counts, r.finished, r.can_inspect, r.can_approve) for r in review.states(uploads).collect()}
    assert got == {"1": (True, True, False, False), "2": (False, True, True, False), "3": (False, True, False, True), "4": (False, True, True, True), "5": (True, False, False, False)}


def test_what_cannot_become_a_pattern_is_not_looked_into(spark, monkeypatch):
    """An object with one open key, or two without words: what lies below them isn't gathered; of three it is."""
    sizes = []
    real = normalize.staged
    monkeypatch.setattr(normalize, "staged", lambda df, name: (out := real(df, name), sizes.append(out.count()) if name == "schema-open-keys" else None)[0])
    paths = ["", "/one", *(f"/one/{k}{x}" for k in ("left", "right", "mid") for x in ("", "/a"))]
    for n, third in (([0, 0, 0], False), ([0, 3, 0], True)):
        rows = [("d", p, p.rpartition("/")[2] or None, "data") for p in paths if third or "/mid" not in p]
        got = {(r.path, r.new_path) for r in normalize.renames(spark.createDataFrame(rows, "doc_id string, path string, name string, kind string")).collect()}
        assert sizes == n and bool(got) == third
        sizes.clear()


def test_a_path_of_many_keys_gathers_masks_not_keys(spark):
    rows = [("d", f"/k/{name}", "/k", name, "data", ["string"] if i % 3 else ["null"], "text", [("text", 2), ("date", 1)][: i % 3], None, 1, 0, 2, i) for i, name in enumerate([f"ab{j}" for j in range(30)] + [f"abc{j}" for j in range(30)] + ["q"])]
    nodes = spark.createDataFrame(rows, "doc_id string, path string, parent_path string, name string, kind string, type array<string>, shape string, shapes array<struct<shape: string, n: bigint>>, format string, n_present long, n_null long, n_count long, position int")
    map_ = nodes.select("doc_id", "path", F.lit("/k/{*}").alias("new_path"))
    out = renormalize.rewritten(nodes, map_)
    r = out.first()
    texts, dates = sum(2 for x in rows if x[7]), sum(len(x[7]) == 2 for x in rows)
    assert (r.name, r.keys, r.n_present, r.n_null, r.n_count, r.position, sorted(r.type)) == (names_mask(spark, "ab0"), 61, 61, 0, 122, 0, ["null", "string"])
    assert {x.shape: x.n for x in r.shapes} == {"text": texts, "date": dates} and out.count() == 1
    assert "_masks" not in out._jdf.queryExecution().toString()


def names_mask(spark, key):
    return spark.range(1).select(names.masked_key(F.lit("{*}"), F.lit(key))).first()[0]


def test_decisions_carry_nothing_but_their_suggestion(spark):
    """What a suggestion says is moved and read once, not again with its decision."""
    made = workflows.event_proposals(spark, SF)
    of = proposals.target_of(*(F.col(c) for c in ("kind", "proposal_id", "location", "annotation", "representation")))
    found = proposals.events(made.withColumn("target", of), workflows.event_targets(spark, SF))
    said = found.groupBy("turn").agg(F.count("*").alias("n"), F.count("values").alias("said"), F.count("kind").alias("kinds"), F.count("target").alias("targets"))
    got = {r.turn: (r.n, r.said, r.kinds, r.targets) for r in said.collect()}
    n, decided = made.count(), made.where("action is not null").count()
    assert got[1] == (n, n, n, n) and got[2] == (decided, 0, 0, decided) and got[0][0] == got[0][1]


def test_a_pair_meets_only_what_of_a_schema_it_may_need(spark):
    """The same suggestions from relevant rows as from whole schemas, and most of a large schema is left out."""
    rng = random.Random(9)
    rows, news = [], []
    node = lambda p, x, n=None: (p, x["kind"], p.rpartition("/")[2] if n is None else n, x["type"], x["shape"], None, x["position"])
    for of in range(6):
        known = tree(rng, list("ABCDEF"))
        moved = {"/Q": ["object"], "/Q/deep": ["object"], "/Q/deep/a": ["string"], "/Q/deep/b": ["integer"]}
        known |= {p: {"kind": "data", "type": t, "shape": None, "position": 9} for p, t in moved.items()}
        known |= {f"/other/{i}": {"kind": "data", "type": ["string"], "shape": "text", "position": i} for i in range(200)}
        known["/other"] = {"kind": "data", "type": ["array"], "shape": None, "position": 10}
        rows += [(str(of), *node(p, x)) for p, x in known.items()]
        for pair in range(4):
            new = tree(rng, list("CDEFGH"))
            new |= {p.replace("/Q", "/R"): {"kind": "data", "type": t, "shape": None, "position": 9} for p, t in moved.items()}
            news += [(f"{of}-{pair}", str(of), *node(p, x)) for p, x in new.items()]
    columns = NODE.removeprefix("pair string, ")
    known, new = spark.createDataFrame(rows, f"of string, {columns}"), spark.createDataFrame(news, f"pair string, of string, {columns}")
    whole = known.join(new.select("pair", "of").distinct(), "of").drop("of")
    some = compare.relevant(compare.placed(known, ["of"]), new)
    got, want = ({tuple(r) for r in compare.suggestions(k, new.drop("of")).collect()} for k in (some, whole))
    assert got == want and any(r[3] == "moved" for r in got) and any(r[3] == "renamed" for r in got)
    assert not some.where("path like '/other/%'").count() and some.select("pair", "path").distinct().count() < whole.count() / 2
