"""Conversation repair against a plain version over whole strings, in one and in many segments."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import repair

SPACE = " \t\n\x0b\x0c\r"
T = "conv_id long, turn long, role string, text string"


def best(rows):
    """(cost, audit) of the cheapest edits: rows (initial, must go, truncated); shortest paths over whole audits."""
    follow = {"N": "su", "S": "u", "U": "a", "A": "u"}
    at = {"N": (0, "")}

    def inserts(at):
        todo = list(at)
        while todo:
            x = todo.pop()
            for y in follow[x]:
                new = (at[x][0] + 2, at[x][1] + "I")
                if y != "s" and new < at.get(y.upper(), (1 << 60, "")):
                    at[y.upper()] = new
                    todo.append(y.upper())
        return at

    for initial, lost, cut in rows:
        new = {}
        for x, (c, s) in inserts(dict(at)).items():
            moves = [(x, 3, "D")]
            if not lost:
                moves += [(y.upper(), cut, "K") for y in follow[x] if y == initial] + [(y.upper(), 2 + cut, "R") for y in follow[x] if y != "s"]
            for y, more, e in moves:
                new[y] = min(new.get(y, (1 << 60, "")), (c + more, s + e))
        at = new
    at = inserts(at)
    return min(at[x] for x in "NA" if x in at)


def plain(turns, hurt=True):
    """{conv: the contract's columns} by walking over each conversation once."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit = best(kinds)
        text, left, kept = [], iter(rows), ""
        for e in audit:
            r = next(left) if e != "I" else None
            if e == "D":
                continue
            to = r[1][:1] if e == "K" else "a" if kept.endswith("u") else "u"
            kept += to
            text.append(f"{r[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[to]}:{r[2] if r else ''}")
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def some(rng, n):
    texts = ["Fine.", "Well?", "no end", "  ", "", None, "Is it\tso! ", "ünd", "ok.", "y" * 70 + "a.", "y" * 70 + "b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"]
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [1000, 4])
def test_equals_plain_version(spark, segment):
    rng = random.Random(segment)
    turns = [t for t in some(rng, 160) if not (t[3] or "").startswith("y")] + [(9, 5, "user", "Hi.")] * 50 + [(8, None, "x", "a")] * 2
    turns += [(7, i, "user" if i % 2 else "assistant", "word " * 30000 + f"{i}.") for i in range(4)]
    df = spark.createDataFrame([t + (1,) for t in turns], T + ", n int").withColumnRenamed("n", "hash")
    for hurt, most in ((False, 1 << 20), (True, 0)):
        own = repair.damaged(df) if hurt else df
        got = {r.conv_id: tuple(r)[1:] for r in repair.summary(repair.edits(own, segment=segment, broadcast_bytes=most)).collect()}
        assert got == plain(turns, hurt)
    assert repair.summary(repair.edits(df.limit(0))).count() == 0


def test_charts_equal_shortest_paths():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("suaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 12))]
        total, column, back = repair.parse(rows)
        cost, end, audit = repair.close(column)
        done = repair.edits_of(back, end)
        assert (total + cost, "".join("I" * len(b) + e for b, e, _ in done) + audit) == best(rows)


def test_repaired_turns_alternate(spark):
    rng = random.Random(6)
    df = spark.createDataFrame(some(rng, 300), T)
    by = defaultdict(list)
    for r in repair.repaired(df, segment=20).orderBy("at", "place").collect():
        by[r.conv_id].append(r.role[:1])
    for roles in by.values():
        s = "".join(roles).removeprefix("s")
        assert s == "ua" * (len(s) // 2)


def test_query_covers_every_conversation(spark):
    d = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(turns)
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_repair(spark, d).collect()}
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c) if want.get(c) and want[c][6] else empty for c in {t[0] for t in turns}}
