"""Repair of conversations with the cheapest edits.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Rows are
kept, given the other role, deleted or inserted at fixed costs; the edit
lattice has a node for each row border and state of that pattern. Dijkstra's
search runs from both ends; when the two heaps have passed the best meeting,
all crossings of that cost are compared and the least audit (the initials of
the edits) is taken.

Long conversations are cut into blocks of rows. A block is a 4 x 4 table of
cheapest (cost, audit) between states, and tables multiply. What decides the
edits travels without the texts; the texts travel once, beside the audit.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelspark.session import ship_package

from .common import drop_shared, shared_table

#: Costs of the edits; a truncated row that stays adds STAY.
REROLE, DELETE, INSERT, STAY = 1, 2, 5, 5
#: States of the pattern: start, after s, after u, after a; where an initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = frozenset((0, 3))
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a conversation that are searched as one lattice.
BLOCK = 512
SPACES = " \t\n\x0b\x0c\r"


# --- one block -----------------------------------------------------------

def _edges(token: str | None, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(rows further, state, cost, initials) of the edits at a node; ``token``
    is what stands behind it: a free row's initial (upper case: truncated),
    a stretch of d for rows that must go, or None at the end."""
    for to in NEXT[state].values():
        if to != 1:
            yield 0, to, INSERT, "I"
    if token is None:
        return
    if token[0] == "d":
        yield 1, state, DELETE * len(token), "D" * len(token)
        return
    yield 1, state, DELETE, "D"
    stay = STAY if token.isupper() else 0
    for initial, to in NEXT[state].items():
        if initial == token.lower():
            yield 1, to, stay, "K"
        if initial in NAMES:
            yield 1, to, stay + REROLE, "R"


@lru_cache(1 << 16)
def cheapest(rows: str, start: int = 0, ends: frozenset = ACCEPT) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows`` (one character a row,
    as for ``_edges``) that lead from ``start`` to one of ``ends``; of equal
    costs the least audit. None if there are none."""
    tokens = [*re.findall("d+|[^d]", rows), None]
    n = len(tokens) - 1
    back: dict[tuple[int, int], list] = {}
    for i, token in enumerate(tokens):
        for state in range(4):
            for ahead, to, cost, label in _edges(token, state):
                back.setdefault((i + ahead, to), []).append(((i, state), cost, label))

    def onward(node):
        return [((node[0] + ahead, to), cost, label) for ahead, to, cost, label in _edges(tokens[node[0]], node[1])]

    # Free edges (K) lead one row on, so of equal costs the node nearer to its
    # side's end comes first: labels are final when a node is settled.
    best = [{(0, start): (0, "")}, {(n, e): (0, "") for e in ends}]
    heaps = [[(0, 0, start)], [(0, 0, e) for e in sorted(ends)]]
    done: list[dict] = [{}, {}]
    least = 0 if (0, start) in best[1] else float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= least:
        side = int(heaps[1][0] < heaps[0][0])
        cost, place, state = heapq.heappop(heaps[side])
        node = (n - place, state) if side else (place, state)
        if node in done[side]:
            continue
        audit = best[side][node][1]
        done[side][node] = cost, audit
        for to, more, label in back.get(node, ()) if side else onward(node):
            new = cost + more, label + audit if side else audit + label
            if to not in done[side] and (to not in best[side] or new < best[side][to]):
                if to not in best[side] or new[0] < best[side][to][0]:
                    heapq.heappush(heaps[side], (new[0], n - to[0] if side else to[0], to[1]))
                best[side][to] = new
            if to in best[1 - side]:
                least = min(least, new[0] + best[1 - side][to][0])
    if least == float("inf"):
        return None
    front = {(0, start): (0, "")} | done[0]
    rear = {(n, e): (0, "") for e in ends} | done[1]
    met = [a + rear[v][1] for v, (c, a) in front.items() if v in rear and c + rear[v][0] == least]
    met += [a + label + rear[w][1] for v, (c, a) in front.items() for w, more, label in onward(v)
            if w in rear and c + more + rear[w][0] == least]
    return int(least), min(met)


#: A table of cheapest edits: 16 (cost, audit) or None, by state before and state after.
Table = list


def block_table(rows: str) -> Table:
    return [cheapest(rows, s, frozenset((t,))) for s in range(4) for t in range(4)]


def multiply(a: Table, b: Table) -> Table:
    out = []
    for s in range(4):
        for t in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := a[4 * s + m]) and (y := b[4 * m + t])]
            out.append(min(ways, default=None))
    return out


class Product:
    """Product of tables in order; equal-sized neighbours first, so that
    audits are copied log2(blocks) times."""

    def __init__(self):
        self._stack: list[tuple[int, Table]] = []

    def add(self, table: Table) -> None:
        size = 1
        while self._stack and self._stack[-1][0] <= size:
            k, before = self._stack.pop()
            table, size = multiply(before, table), size + k
        self._stack.append((size, table))

    def result(self) -> tuple[int, str]:
        out = None
        for _, table in reversed(self._stack):
            out = table if out is None else multiply(table, out)
        return min(out[t] for t in ACCEPT if out[t])


# --- what is counted besides ----------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
#: A piece of a conversation: its counts, first and last initial, first and last turn.
ENDS = ("first", "last", "low", "high")


def join_counts(a: dict, b: dict) -> dict:
    """The counts of two pieces that follow each other."""
    out = {c: a[c] + b[c] for c in COUNTS}
    if a["last"] is not None and b["first"] is not None:
        out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    if a["high"] is not None and a["high"] == b["low"]:
        out["turns"] -= 1
    for first, last in (("first", "last"), ("low", "high")):
        out[first] = b[first] if a[first] is None else a[first]
        out[last] = a[last] if b[last] is None else b[last]
    return out


NOTHING = dict.fromkeys(COUNTS, 0) | dict.fromkeys(ENDS)


def _row_counts(r: dict) -> dict:
    """Counts of ``m`` equal rows."""
    m, fresh = r["m"], r["fresh"] and not r["blank"]
    return {"blank": m if r["blank"] else 0, "duplicate": 0 if r["blank"] else m - int(fresh),
            "truncated": int(fresh and r["cut"]), "illegal": m - 1, "turns": int(r["turn"] is not None),
            "first": r["initial"], "last": r["initial"], "low": r["turn"], "high": r["turn"]}


def _row_code(r: dict) -> str:
    if r["blank"] or not r["fresh"]:
        return "d" * r["m"]
    return (r["initial"].upper() if r["cut"] else r["initial"]) + "d" * (r["m"] - 1)


def _totals(counts: dict, cost: int, audit: str) -> dict:
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]
    return {"gaps": gaps, **{c: counts[c] for c in COUNTS[:4]}, "cost": cost, "audit": audit}


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            yield from b.slice(k, 1000).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


PLAN = ("gaps", *COUNTS[:4], "cost", "audit")
_PLAN_FIELDS = [T.StructField(c, T.StringType() if c == "audit" else T.LongType()) for c in PLAN]
_PIECE_FIELDS = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("first", T.StringType()),
                 T.StructField("last", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
                 T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def repair_plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost and audit. ``rows`` as for ``repair_report``.

    Equal rows are counted before they travel; a row is told from its
    repetitions by the SHA-256 of its text. Rows are range-partitioned in
    order, so a conversation of any size spreads over tasks: each gives the
    tables of its blocks, and these meet by conversation (16 audits a block).
    """
    ship_package(rows.sparkSession)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    gone = F.col("copies") == 0
    narrow = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit(b"")).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("d"), "copies",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    counted = shared_table(narrow.groupBy("conv_id", "turn", "role", "d").agg(
        F.sum("copies").cast("long").alias("m"), F.first("initial").alias("initial"), F.first("blank").alias("blank"),
        F.first("cut").alias("cut")), "turns")
    firsts = counted.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("d").alias("_d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("_f"))
    marked = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("d") == F.col("_d"))) \
        .withColumn("fresh", F.col("turn").eqNullSafe(F.col("_f.turn"))).drop("_c", "_r", "_d", "_f")
    conv = rows.schema["conv_id"]
    key = [T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("d", T.BinaryType())]
    schema = T.StructType([conv, T.StructField("whole", T.BooleanType()), *key, *_PIECE_FIELDS,
                           T.StructField("plan", T.StructType(_PLAN_FIELDS))])
    out_schema = _arrow(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            conversations = groupby(_dicts(batches), key=lambda r: r["conv_id"])
            held, at_edge = None, True      # the first one may have begun, the last one may go on in another task
            for conv_id, group in conversations:
                if held:
                    yield from emit(*held, at_edge)
                    at_edge = False
                blocks, codes, size, counts, start = [], [], 0, NOTHING, None
                for r in group:
                    if size >= block:
                        yield piece(conv_id, start, counts, "".join(codes))
                        blocks, codes, size, counts, start = [True], [], 0, NOTHING, None
                    start = start or {c: r[c] for c in ("turn", "role", "d")}
                    if r["m"]:
                        codes.append(_row_code(r))
                        size += 1
                        counts = join_counts(counts, _row_counts(r))
                held = conv_id, start, counts, "".join(codes), bool(blocks)
            if held:
                yield from emit(*held, True)

        def piece(conv_id, start, counts, code) -> dict:
            table = block_table(code)
            return {"conv_id": conv_id, "whole": False, **start, **counts, "costs": [x and x[0] for x in table],
                    "audits": [x and x[1] for x in table]}

        def emit(conv_id, start, counts, code, more, at_edge) -> Iterator[dict]:
            if more or at_edge:
                yield piece(conv_id, start, counts, code)
            else:
                yield {"conv_id": conv_id, "whole": True, **start, "plan": _totals(counts, *cheapest(code))}

        return _batches(each(), out_schema, 200)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "d")]
    cut = shared_table(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, schema), "pieces")
    drop_shared(counted)
    plan_schema = T.StructType([conv, *_PLAN_FIELDS])
    plan_arrow = _arrow(plan_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for conv_id, group in groupby(_dicts(batches), key=lambda r: r["conv_id"]):
                counts, product = NOTHING, Product()
                for p in group:
                    counts = join_counts(counts, p)
                    product.add([None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])])
                yield {"conv_id": conv_id, **_totals(counts, *product.result())}
        return _batches(each(), plan_arrow, 200)

    rest = cut.where("not whole").drop("whole", "plan").repartition("conv_id").sortWithinPartitions(*order)
    return cut.where("whole").select("conv_id", "plan.*").unionByName(rest.mapInArrow(meet, plan_schema))


def _edited(rows: Iterator[dict]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) along a conversation's audit, which comes first; a
    deleted row comes with nulls."""
    audit = iter(next(rows)["audit"])
    state = 0
    letter = next(audit, None)
    for r in rows:
        for _ in range(r["copies"]):
            while letter == "I":
                role = "a" if state == 2 else "u"
                state = NEXT[state][role]
                yield "I", NAMES[role], ""
                letter = next(audit, None)
            if letter == "D":
                yield "D", None, None
            else:
                role = r["role"][:1] if letter == "K" else "a" if state == 2 else "u"
                state = NEXT[state][role]
                yield letter, r["role"] if letter == "K" else NAMES[role], r["text"]
            letter = next(audit, None)
    while letter == "I":
        role = "a" if state == 2 else "u"
        state = NEXT[state][role]
        yield "I", NAMES[role], ""
        letter = next(audit, None)


def _beside(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows behind their conversation's plan, each conversation in one
    sorted run."""
    d = F.sha2(F.col("text").cast("binary"), 256)
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", d.alias("d"), "copies", "text")
    both = plans.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        *[F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "d")])


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I),
    role, text. Input as for ``repair_report``."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[dict]:
            for conv_id, group in groupby(_dicts(batches), key=lambda r: r["conv_id"]):
                place = 0
                for edit, role, text in _edited(group):
                    if edit != "D":
                        yield {"conv_id": conv_id, "place": place, "edit": edit, "role": role, "text": text}
                        place += 1
        return _batches(run(), arrow)

    return _beside(rows, repair_plans(rows)).mapInArrow(each, schema)


def repair_report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, edits and digest of every conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the
    repaired ``role:text`` lines, newline-joined).

    ``rows``: conv_id, turn, role, text and copies (how often the row stands
    there; 0: not at all, but its conversation is listed); other columns are
    left aside. Rows are ordered by turn, nulls first, then role and SHA-256
    of the text. Null roles and texts must be given as strings (``damaged``
    does so), null conversation ids are one conversation, null turns count in
    no gap. A role whose initial is none of s, u, a can only be changed or
    deleted. Equal rows are duplicates of their first one. An empty table
    gives an empty result. Texts are held a batch of rows at a time, however
    long. The digest
    streams over a conversation's rows in order, in one task: SHA-256 has no
    other way; the edits are found by blocks in all tasks.
    """
    schema = T.StructType([rows.schema["conv_id"], *_PLAN_FIELDS, T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[dict]:
            for _, group in groupby(_dicts(batches), key=lambda r: r["conv_id"]):
                plan = next(group)
                digest, between = hashlib.sha256(), ""
                for edit, role, text in _edited(iter_with(plan, group)):
                    if edit != "D":
                        digest.update(f"{between}{role}:{text}".encode("utf-8", "replace"))
                        between = "\n"
                yield {**plan, "repaired_sha256": digest.hexdigest()}

        def iter_with(first, others):
            yield first
            yield from others

        return _batches(({c: r[c] for c in arrow.names} for r in run()), arrow, 200)

    return _beside(rows, repair_plans(rows, block)).mapInArrow(each, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by crc32(conv_id:turn) % 20:
    0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3
    repeats it, 4 makes it a user's. Nulls read as one space."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(known("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"))
