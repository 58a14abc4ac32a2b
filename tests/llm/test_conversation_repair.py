"""op11: the two-sided search against all edits, the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kernelspark.llm import conversation_repair as C
from kernelspark.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def all_edits(rows, inserts):
    """Every edit sequence of (initial, must go, truncated) rows with few inserts: (cost, audit)."""
    best = None
    for edits in itertools.product("KuaD", repeat=len(rows)):
        if any(gone and e != "D" for (_, gone, _), e in zip(rows, edits)):
            continue
        base = "".join(r[0] if e == "K" else e if e != "D" else "" for r, e in zip(rows, edits))
        cost = sum({"K": 0, "D": 2}.get(e, 1) + (5 if r[2] and e != "D" else 0) for r, e in zip(rows, edits))
        letters = "".join(e if e in "KD" else "R" for e in edits)
        for n in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for added in itertools.product("ua", repeat=n):
                    audit, roles, k = "", "", 0
                    for i in range(len(rows) + 1):
                        while k < n and places[k] == i:
                            audit, roles, k = audit + "I", roles + added[k], k + 1
                        if i < len(rows):
                            audit += letters[i]
                            roles += "" if edits[i] == "D" else rows[i][0] if edits[i] == "K" else edits[i]
                    if re.fullmatch("(s?(ua)+)?", roles):
                        best = min(best or (cost + 5 * n, audit), (cost + 5 * n, audit))
    return best


def code(rows):
    return "".join("d" if gone else i.upper() if cut else i for i, gone, cut in rows)


def test_all_short_sequences():
    r = random.Random(1)
    for n in range(5):
        for _ in range(60):
            rows = [(r.choice("suao"), r.random() < .2, r.random() < .25) for _ in range(n)]
            assert C.cheapest(code(rows)) == all_edits(rows, 2), rows


def plain(rows, start=0, ends=(0, 3)):
    """Row by row: the least (cost, audit) of every state."""
    now = {start: (0, "")}

    def inserted(now):
        for _ in range(2):
            for s, (c, a) in list(now.items()):
                for t in {0: [2], 1: [2], 2: [3], 3: [2]}[s]:
                    now[t] = min(now.get(t, (c + 5, a + "I")), (c + 5, a + "I"))
        return now

    for x in rows:
        ahead = {}
        for s, (c, a) in inserted(now).items():
            ways = [(s, 2, "D")]
            if x != "d":
                stay = 5 if x.isupper() else 0
                for i, t in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[s]:
                    ways += [(t, stay, "K")] * (i == x.lower()) + [(t, stay + 1, "R")] * (i != "s")
            for t, w, e in ways:
                ahead[t] = min(ahead.get(t, (c + w, a + e)), (c + w, a + e))
        now = ahead
    now = inserted(now)
    return min((now[e] for e in ends if e in now), default=None)


def test_long_sequences_and_blocks():
    r = random.Random(2)
    for _ in range(400):
        rows = "".join(r.choices("suaodSUAO", weights=(1, 8, 8, 1, 3, 1, 2, 2, 1), k=r.randrange(0, 60)))
        assert C.cheapest(rows) == plain(rows)
        product, at = C.Product(), 0
        while at <= len(rows):
            k = r.randrange(0, 20)
            product.add(C.block_table(rows[at:at + k]))
            at += max(k, 1) if k else 1
            if not k and at <= len(rows):
                product.add(C.block_table(rows[at - 1:at]))
        assert product.result() == plain(rows)
    for s in range(4):
        for t in range(4):
            for rows in ("", "ua", "ddU", "suua"):
                assert C.cheapest(rows, s, frozenset((t,))) == plain(rows, s, (t,))


def expected(conversations):
    """The contract in plain Python: conv_id -> row."""
    def known(x):
        return " " if x is None else str(x)

    out = {}
    by_id = {}
    for c, t, role, text in conversations:
        by_id.setdefault(c, []).append((t, known(role), known(text)))
    for c, rows in by_id.items():
        after = []
        for t, role, text in rows:
            k = zlib.crc32(f"{known(c)}:{known(t)}".encode()) % 20
            role = "user" if k == 4 else role
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            after += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, counts, codes = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for t, role, text in after:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "d" if fault in ("blank", "duplicate") else i.upper() if fault else i
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        turns = {t for t, *_ in after if t is not None}
        cost, audit = plain(codes)
        lines, rest, last = [], iter(after), ""
        for e in audit:
            row = next(rest) if e != "I" else None
            if e == "D":
                continue
            if e == "K":
                lines.append(f"{row[1]}:{row[2]}")
            else:
                lines.append(("assistant:" if last == "u" else "user:") + (row[2] if row else ""))
            last = lines[-1][0]
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(r.randrange(1, longest)):
            turn = r.choice((t, t, t, t + 3, None))
            rows.append((None if c == 7 else c, turn, r.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None)),
                         r.choice(("Yes.", "no", "", " \n", "Well! ", f"Line {t}?", f"part {t}", None, "é" * 50 + "."))))
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_edge_rows(spark, block):
    """Nulls, ties, repeated rows, blanks, conversations over many tasks and blocks, clashing columns."""
    rows = made(3, 60, 9) + [(1000, t, "user" if t % 2 else "assistant", f"turn {t % 90}.") for t in range(700)]
    rows += [(1001, 5, "user", "Same.")] * 40 + [(1002, 1, "user", "word " * 60_000 + "."), (1002, 2, "assistant", "Ok.")]
    rows = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies int, audit string").repartition(7)
    out = C.repair_report(C.damaged(df), block)
    assert out.columns == COLUMNS
    want = expected([r[:4] for r in rows])
    got = {r.conv_id: tuple(r) for r in out.collect()}
    assert got == want and len(want) > 60
    lines = {}
    for r in C.repaired_rows(C.damaged(df)).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, w in want.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.repair_report(C.damaged(df)).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = C.repair_report(C.damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], df.schema))).collect()
    assert [tuple(r) for r in one] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r.conv_id: tuple(r) for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == expected([tuple(r) for r in rows])
