"""Balanced label propagation over 24 shards, in DataFrame operations only.

Documents with equal texts are linked. A document starts in a hash-random
shard. In each round every group of copies tallies its members per shard and
prefers a shard with room for all the others, else the one that holds most of
them (equal ones by a hash of the round); its other members ask to move there.
What flows from one shard to another is accepted as far as the same number
flows back, and beyond that as far as the target has room, so full shards
swap. Rounds go on until one moves hardly anything. Groups that fill a good
part of a shard settle first, the others start over in what those leave.
Unlinked documents are ballast: they stay where the hash put them and only
fill up what the linked ones leave. At the end each shard keeps its first rows
up to its exact quota (linked rows first) and hands the rest to the open slots
of the others, so that the row counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shared, md5_uniform, running_total, shared_table, text_or_empty

SHARDS = 24
#: A round that moves fewer than one in so many linked rows is the last one.
LEAST_MOVED = 1000
#: Groups of more than 1 / BIG of a shard settle first.
BIG = 8


def _pick(index, cuts: list[int], values: list[int]):
    """values[k] for the first k with index < cuts[k]; one branch per shard."""
    out = None
    for c, v in zip(cuts, values):
        out = F.when(index < c, F.lit(v)) if out is None else out.when(index < c, F.lit(v))
    return F.lit(None).cast("int") if out is None else out


def accepted_shares(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of each flow (from, to) that may move: what flows back, and of
    the surplus as much as the target has room for."""
    surplus = {(i, j): max(0, n - flows.get((j, i), 0)) for (i, j), n in flows.items()}
    wanted = [sum(n for (_, j), n in surplus.items() if j == k) for k in range(len(room))]
    return {(i, j): (n - surplus[i, j] + surplus[i, j] * (min(1.0, room[j] / wanted[j]) if wanted[j] else 0.0)) / n
            for (i, j), n in flows.items()}


def propagate(linked: DataFrame, quota: list[int], tag: str) -> DataFrame:
    """Rounds of label propagation on rows with ``block`` and ``shard``."""
    spark, shards, columns = linked.sparkSession, len(quota), linked.columns
    n, r = linked.count(), 0
    while n:
        # one row per block and shard where it has members: no pairs, and a hot group is a few rows a task
        tally = shared_table(linked.groupBy("block", "shard").agg(F.count(F.lit(1)).alias("m")), "shard-tally")
        load = {x["shard"]: x["n"] for x in tally.groupBy("shard").agg(F.sum("m").alias("n")).collect()}
        room = [max(0, quota[j] - load.get(j, 0)) for j in range(shards)]
        open_ = F.element_at(F.array(*[F.lit(x).cast("long") for x in room]), F.col("shard") + 1)
        whole = tally.withColumn("members", F.sum("m").over(Window.partitionBy("block")))
        tie = F.md5(F.concat_ws("|", "block", F.col("shard").cast("string"), F.lit(f"{tag}{r}")))
        best = whole.groupBy("block").agg(F.max(F.struct((open_ >= F.col("members") - F.col("m")).alias("fits"), "m", tie.alias("tie"),
                                                         F.col("shard").alias("to")))["to"].alias("to"))
        asks = shared_table(tally.join(best, "block").filter("shard != to").select("block", "shard", "to", "m"), "shard-asks")
        flows = {(x["shard"], x["to"]): x["n"] for x in asks.groupBy("shard", "to").agg(F.sum("m").alias("n")).collect()}
        share = F.lit(0.0)
        shares = accepted_shares(flows, room)
        for j in range(shards):
            row = F.element_at(F.array(*[F.lit(shares.get((i, j), 0.0)) for i in range(shards)]), F.col("shard") + 1)
            share = F.when(F.col("to") == j, row).otherwise(share)
        _, lot = md5_uniform(F.col("block"), F.col("shard"), F.lit(f"{tag}{r}"))
        moves = asks.filter(lot < share).select("block", "shard", "to", "m")
        moved = moves.agg(F.sum("m")).first()[0] or 0
        if moved:
            step = linked.join(moves.drop("m"), ["block", "shard"], "left").withColumn("shard", F.coalesce("to", "shard")).select(*columns)
            after = shared_table(step, "shard-linked")
            drop_shared(linked)
            linked = after
        drop_shared(tally)
        drop_shared(asks)
        if moved == 0 or moved * LEAST_MOVED < n:
            break
        r += 1
    return linked


def shard_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS,
                    seed: str = "shard") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard,
    slot, grown_shard (null under this law).

    Size: UTF-8 bytes of the text plus 8. Null texts count as empty; all
    empty texts are one group. A group with more members than a shard has
    rows is cut into the fewest blocks that fit; every smaller one moves as
    a whole. Rows that repeat an id are linked and placed like any others;
    rows that tie in the order are equal in all that decides. Texts are
    hashed whole, very long ones too, and only hashes travel. Columns of the
    input other than id and text are left aside. An empty table gives an
    empty result.
    """
    _, u = md5_uniform(F.lit(seed), F.col(doc_id))
    t = text_or_empty(text).cast("binary")
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"),
                       F.crc32(t).cast("long").alias("text_crc32"), F.sha2(t, 256).alias("g"), u.alias("u"))
    base = shared_table(base, "shard-rows")
    n = base.count()
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    most = max(2, n // shards)
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1") \
        .withColumn("blocks", F.ceil(F.col("members") / F.lit(most)))
    start = F.floor(F.col("u") * F.lit(shards)).cast("int")
    # a block is cut by the hash's fraction inside its first shard, so that each block starts spread over all shards
    frac = F.col("u") * F.lit(shards) - F.floor(F.col("u") * F.lit(shards))
    rows = base.join(groups, "g", "left").select(
        "doc_id", "size", "text_crc32", "u", start.alias("shard"),
        F.when(F.col("blocks").isNotNull(), F.md5(F.concat_ws("|", "g", F.floor(frac * F.col("blocks")).cast("string")))).alias("block"),
        F.coalesce(F.col("members") * F.lit(BIG) > F.lit(most), F.lit(False)).alias("big"))
    rows = shared_table(rows, "shard-state")
    drop_shared(base)
    big = propagate(shared_table(rows.filter("big"), "shard-linked"), quota, "b")
    held = {x["shard"]: x["n"] for x in big.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = [max(0, quota[j] - held.get(j, 0)) for j in range(shards)]
    cuts = [sum(left[:j + 1]) for j in range(shards)]
    again = _pick(F.col("u") * F.lit(float(cuts[-1])), cuts, list(range(shards)))
    small = rows.filter("block IS NOT NULL AND NOT big").withColumn("shard", F.coalesce(again, F.col("shard")))
    linked = big.unionByName(propagate(shared_table(small, "shard-linked"), left, "s"))
    # who stays where a shard is too full: large groups first, then small ones, then unlinked rows
    kind = F.when(F.col("block").isNull(), 2).when(F.col("big"), 0).otherwise(1)
    placed = linked.unionByName(rows.filter("block IS NULL")).withColumn("kind", kind)
    counts = {(x["shard"], x["kind"]): x["n"] for x in placed.groupBy("shard", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = running_total(placed, ["shard", "kind"], "u", ["doc_id", "text_crc32"], F.lit(1), "at", n)
    firsts = F.lit(0).cast("long")
    over, room_cut, room_at, room_first, excess, room_sum = F.lit(0).cast("long"), [], [], [], 0, 0
    for j in range(shards):
        before = [counts.get((j, 0), 0), counts.get((j, 0), 0) + counts.get((j, 1), 0)]
        have = before[1] + counts.get((j, 2), 0)
        for k in (1, 2):
            firsts = F.when((F.col("shard") == j) & (F.col("kind") == k), F.lit(before[k - 1])).otherwise(firsts)
        if have > quota[j]:
            over = F.when(F.col("shard") == j, F.lit(excess - quota[j])).otherwise(over)
            excess += have - quota[j]
        elif have < quota[j]:
            room_first.append(have - room_sum)
            room_sum += quota[j] - have
            room_cut.append(room_sum)
            room_at.append(j)
    limit = F.lit(0).cast("long")
    for j in range(shards):
        limit = F.when(F.col("shard") == j, F.lit(quota[j])).otherwise(limit)
    return (ranked.withColumn("rank", F.col("at") + firsts).withColumn("stays", F.col("rank") < limit)
            .withColumn("k", F.col("rank") + over)      # place among all rows that must leave
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.when(F.col("stays"), F.col("shard")).otherwise(_pick(F.col("k"), room_cut, room_at))
                    .cast("int").alias("shard"),
                    F.when(F.col("stays"), F.col("rank"))
                    .otherwise(F.col("k") + _pick(F.col("k"), room_cut, room_first)).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
