"""Conversation repair against a search over all edits, and the query against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pathloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, signature string"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(symbols: str) -> tuple[int, str]:
    """Dijkstra-like sweep over (position, roles so far shortened to what matters), by plain strings of edits."""
    best: dict[str, tuple[int, str]] = {"": (0, "")}  # by the role initials so far

    def merged(found):
        out: dict[str, tuple[int, str]] = {}
        for roles, value in found:
            key = roles if len(roles) < 6 else roles[:2] + roles[-4:] if len(roles) % 2 == 0 else roles[:3] + roles[-4:]
            out[key] = min(out.get(key, (10**9, "")), value)
        return out

    def with_inserts(now):
        found, layer = list(now.items()), list(now.items())
        for _ in range(2):
            layer = [(r + c, (cost + 2, audit + "I")) for r, (cost, audit) in layer for c in "ua"]
            found += layer
        return merged(x for x in found if GOOD.fullmatch(x[0]) or GOOD.fullmatch(x[0] + "a") or GOOD.fullmatch(x[0] + "ua"))

    for symbol in symbols:
        found = []
        for roles, (cost, audit) in with_inserts(best).items():
            found.append((roles, (cost + 3, audit + "D")))
            if symbol != "=":
                late = int(symbol.isupper())
                found.append((roles + symbol.lower(), (cost + late, audit + "K")))
                found += [(roles + c, (cost + 2 + late, audit + "R")) for c in "ua"]
        best = merged(x for x in found if GOOD.fullmatch(x[0]) or GOOD.fullmatch(x[0] + "a") or GOOD.fullmatch(x[0] + "ua"))
    return min(v for r, v in with_inserts(best).items() if GOOD.fullmatch(r))


@pytest.mark.parametrize("seed", range(4))
def test_solved_equals_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        symbols = "".join(rng.choice("suaxSUAX==uuaa") for _ in range(rng.randint(0, 9)))
        assert repair.whole(symbols) == cheapest(symbols), symbols


def plain(rows):
    """Every column of the query for rows (conv_id, turn, role, text), one conversation at a time."""
    convs = defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        convs[conv]
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "=" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = repair.whole(symbols)
        lines, last, at = [], "", 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else own[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        assert GOOD.fullmatch("".join(x[0] for x in lines))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed: int):
    """Unique turns a conversation, so that their order is settled, but for repeated rows."""
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample(range(12), rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(["Hello.", "Why?", "cut off", "", " \t\n", None, "x! ", "été ", "same.", "a\x00b."])))
    for turn in range(700):  # one conversation over many partitions, with turns that come again far apart
        rows.append((500, turn * 2, ("user", "assistant")[turn % 2] if turn % 5 else "tool", f"text {turn % 90}." if turn % 3 else "same."))
    rows += [(501, None, "user", "Hi."), (502, None, "user", "Hi."), (502, None, "user", "Hi."), (503, 1, "system", "Only."), (504, 1, "user", "z" * 3_000_000 + "."), (504, 2, "assistant", "y" * 3_000_000)]
    return rows


@pytest.mark.parametrize(("segment", "partitions"), [(128, 4), (5, 16)])
def test_query_equals_plain_version(spark, tmp_path, monkeypatch, segment, partitions):
    rows = conversations(segment)
    monkeypatch.setattr(repair, "SEGMENT", segment)
    spark.createDataFrame([(*r, "p", "s") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = repair.op11_repair(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == len({r[0] for r in rows})
    want = plain(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_general_interface_and_empty_table(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "And?"), (1, 3, "assistant", "Yes."), (2, 1, "assistant", "Alone.")]
    fixed = repair.repaired(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert {r.conv_id: (r.illegal, r.cost, r.audit) for r in fixed.audits.collect()} == {1: (1, 2, "KIKK"), 2: (0, 2, "IK")}
    turns = {r.conv_id: list(zip(r.roles, r.texts)) for r in fixed.turns.collect()}
    assert turns == {1: [("user", "Hi."), ("assistant", ""), ("user", "And?"), ("assistant", "Yes.")], 2: [("user", ""), ("assistant", "Alone.")]}
    none = repair.repaired(spark.createDataFrame([], SCHEMA))
    assert none.audits.count() == 0 and repair.digests(none.turns).count() == 0
