"""Orders, seeded permutations, samples and splits.

Random choices are made reproducible (and reproducible in SQL) by ordering
rows on ``md5('<seed>:<id>')``, with the ids as tie-break. Global positions
are never computed by a single-partition window:

* ``global_rank`` range-partitions on the order, writes the sorted ranges
  once, counts rows per range and adds each range's offset - the DataFrame
  form of ``zipWithIndex``.
* ``random_permutation`` needs no split keys: the md5 key is uniform, its
  leading digits number the range.
* ``train_test_split`` finds the exact k-th key by radix selection on the
  hex digits of the md5 key: each level is one grouped count with at most
  4096 groups, and only the last, small bucket is ranked.
* per-group samples of a small size m use ``row_number() <= m``; Catalyst
  plans a partial ``WindowGroupLimit`` before the shuffle, so a hot group
  ships at most m rows per map task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Rows of the last radix bucket ranked directly (bounded work for one task).
RADIX_LEAF = 200_000
# Bins of one pass of the k-th smallest value.
HISTOGRAM_BINS = 4096
# Hex digits per radix level: at most 16**3 = 4096 groups reach the driver.
RADIX_DIGITS = 3


def perm_key(seed: int | str, id_cols: Sequence[str]) -> Column:
    """md5 of '<seed>:<id1>:<id2>...' as lowercase hex (same in DuckDB)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def global_rank(df: DataFrame, order_cols: Sequence[str], out: str = "row_id",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (unique; nulls
    come first).

    One range exchange (Spark samples the split keys; a hot leading value is
    split by the following columns) and a local sort, written once to the
    shared folder with each row's range and its number inside the range.
    Because it is written, the ranges are the same for every later read, and
    the local sort cannot be optimised away. Per-range counts (one row per
    range, broadcast) give the offsets.
    """
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
                .select("*", F.spark_partition_id().alias("_ks_p"), inside.alias("_ks_m")))
    path = f"{checkpoint_dir(spark)}/rank-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    back = spark.read.schema(ranged.schema).parquet(path)
    counts = back.groupBy("_ks_p").agg(F.count(F.lit(1)).alias("_ks_n"))
    w = Window.orderBy("_ks_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ks_p", F.coalesce(F.sum("_ks_n").over(w), F.lit(0)).alias("_ks_off"))
    return (back.join(F.broadcast(offsets), "_ks_p")
                .withColumn(out, (F.col("_ks_off") + F.col("_ks_m")).cast("long"))
                .drop("_ks_p", "_ks_m", "_ks_off"))


def uniform_rank(df: DataFrame, key: str, id_cols: Sequence[str], by: str | None = None,
                 out: str = "perm_pos") -> DataFrame:
    """0-based position in the order of a hash ``key`` (hex), over all rows or
    within each ``by`` group.

    A hash key is uniform, so its leading digits are the range number: no
    sample, no split keys. One pass counts the ranges, one ranks inside
    them; a hot group is spread over all ranges.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.lit(ranges))
    placed = df.withColumn("_ks_b", at.cast("int"))
    group = [F.col(by).alias("_ks_by")] if by else [F.lit(0).alias("_ks_by")]
    counts = placed.select(*group, "_ks_b").groupBy("_ks_by", "_ks_b").agg(F.count(F.lit(1)).alias("_ks_n"))
    before = Window.partitionBy("_ks_by").orderBy("_ks_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_ks_by"), F.col("_ks_b").alias("_ks_o"),
                            F.coalesce(F.sum("_ks_n").over(before), F.lit(0)).alias("_ks_off"))
    inside = Window.partitionBy(*([by] if by else []), "_ks_b").orderBy(key, *id_cols)
    local = placed.withColumn("_ks_rn", F.row_number().over(inside))
    same = F.col("_ks_b") == F.col("_ks_o")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_ks_by"))
    else:
        offsets = F.broadcast(offsets)          # one row per range
    return (local.join(offsets, same)
                 .withColumn(out, (F.col("_ks_off") + F.col("_ks_rn") - F.lit(1)).cast("long"))
                 .drop("_ks_b", "_ks_o", "_ks_by", "_ks_rn", "_ks_off"))


def random_permutation(df: DataFrame, seed: int, id_cols: Sequence[str],
                       by: str | None = None, out: str = "perm_pos") -> DataFrame:
    """Seeded permutation (F3): ``out`` = 0-based position in md5 order,
    over all rows or within each ``by`` group."""
    keyed = df.withColumn("_ks_key", perm_key(seed, id_cols))
    return uniform_rank(keyed, "_ks_key", id_cols, by, out).drop("_ks_key")


def sample_n(df: DataFrame, seed: int, id_cols: Sequence[str], by: str,
             m: Column | int, m_max: int, out: str = "sample_pos") -> DataFrame:
    """First m rows of the seeded permutation of each ``by`` group.

    ``m`` may be a per-row column (e.g. min(2*rank, n) of the row's cluster);
    ``m_max`` is a literal upper bound of all m so Catalyst can plan a partial
    top-m per map task before the shuffle.
    """
    w = Window.partitionBy(by).orderBy("_ks_key", *id_cols)
    keyed = df.withColumn("_ks_key", perm_key(seed, id_cols))
    ranked = keyed.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= F.lit(m_max))
    m_col = m if isinstance(m, Column) else F.lit(m)
    return ranked.filter(F.col(out) <= m_col).withColumn(out, F.col(out) - 1).drop("_ks_key")


def _id_tuple_leq(id_cols: Sequence[str], values: Sequence) -> Column:
    """(ids) <= (values) lexicographically."""
    cond = F.lit(True)
    for c, v in reversed(list(zip(id_cols, values))):
        cond = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & cond)
    return cond


def kth_key(df: DataFrame, seed: int, id_cols: Sequence[str], k: int | None = None,
            fraction: float | None = None):
    """The k-th smallest (key, ids) in md5 order (1-based), by radix
    selection over the key's hex digits; with ``fraction``, k is
    floor(fraction * rows), the rows counted by the first level. Returns None
    for k <= 0 and for k beyond the rows."""
    keyed = df.select(perm_key(seed, id_cols).alias("_ks_key"), *id_cols)
    prefix, need = "", k
    while True:
        scope = keyed.filter(F.col("_ks_key").startswith(prefix)) if prefix else keyed
        pos = len(prefix) + 1
        counts = sorted((r["g"], r["n"]) for r in scope.groupBy(
            F.substring("_ks_key", pos, RADIX_DIGITS).alias("g")).agg(
            F.count(F.lit(1)).alias("n")).collect())
        if need is None:
            need = int(sum(n for _, n in counts) * fraction)
        if need <= 0 or need > sum(n for _, n in counts):
            return None
        for g, n in counts:
            if need <= n:
                prefix += g
                bucket_n = n
                break
            need -= n
        if bucket_n <= RADIX_LEAF or len(prefix) >= 32:
            break
    # equal keys are counted, not ranked one by one: the last bucket is small, or its rows repeat few ids
    leaf = keyed.filter(F.col("_ks_key").startswith(prefix)).groupBy("_ks_key", *id_cols).agg(F.count(F.lit(1)).alias("_ks_n"))
    w = Window.orderBy("_ks_key", *id_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = leaf.withColumn("_ks_upto", F.sum("_ks_n").over(w)).filter(F.col("_ks_upto") >= need).orderBy("_ks_upto").first()
    return row["_ks_key"], [row[c] for c in id_cols]


def in_first(df: DataFrame, seed: int, id_cols: Sequence[str], k: int | None = None,
             fraction: float | None = None) -> Column:
    """Condition: the row is among the first k (or floor(fraction * rows)) of
    the seeded permutation. One histogram pass over the ids and a small leaf."""
    last = kth_key(df.select(*id_cols), seed, id_cols, k, fraction)
    if last is None:
        return F.lit(bool((fraction is not None and fraction >= 1) or (k is not None and k > 0)))
    key = perm_key(seed, id_cols)
    return (key < F.lit(last[0])) | ((key == F.lit(last[0])) & _id_tuple_leq(id_cols, last[1]))


def train_test_split(df: DataFrame, fraction: float, seed: int,
                     id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Exact split (F5, F7): the first floor(N * fraction) rows of the seeded
    permutation are train, the rest test (the complement)."""
    train = in_first(df, seed, id_cols, fraction=fraction)
    return df.filter(train), df.filter(~train)


def kth_smallest(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k-th smallest value of a numeric column (F2), 1-based, as one row
    (null for k outside the rows); see ``kth_values``."""
    return df.sparkSession.createDataFrame([(kth_values(df, col, [k])[0],)], "value double")


def kth_values(df: DataFrame, col: str, ks: Sequence[int]) -> list[float | None]:
    """The k-th smallest values of a numeric column for several k, 1-based;
    None for k outside the rows; nulls and NaN are not counted.

    Selection by histogram: each pass counts the values of the open intervals
    in ``HISTOGRAM_BINS`` bins each (a monotone function of the value) and
    goes on with the bin that holds the k-th, until that bin has one value.
    All k share the passes. Only the bins reach the driver, and no task sorts
    or holds rows.
    """
    v = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, least, most = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = {}                  # interval -> {k: place inside it}
    for k in ks:
        if 1 <= k <= n:
            open_.setdefault((least, most), {})[k] = k
    while open_:
        for (lo, hi), places in list(open_.items()):
            if lo == hi:
                found.update(dict.fromkeys(places, lo))
                del open_[lo, hi]
        if not open_:
            break
        # halves, so that the width of the interval cannot overflow
        intervals = list(open_)
        bins = [F.when(F.col("v").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("i"), F.floor(
            (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * F.lit(HISTOGRAM_BINS)).alias("b"))) for i, (lo, hi) in enumerate(intervals)]
        counts = v.select(F.coalesce(*bins).alias("at"), "v").filter("at IS NOT NULL").groupBy("at.i", "at.b").agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        after: dict = {}
        for i, interval in enumerate(intervals):
            for k, left in open_[interval].items():
                for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["b"]):
                    if left <= r["m"]:
                        after.setdefault((r["lo"], r["hi"]), {})[k] = left
                        break
                    left -= r["m"]
        open_ = after
    return [None if k not in found else float(found[k]) for k in ks]


# Fixed values of the keyed permutation: rounds, the prime its rounds count in.
FEISTEL_ROUNDS, FEISTEL_PRIME = 6, (1 << 31) - 1
#: Steps that may lead back into 0..n-1; each misses with a chance below 1 / sqrt(n).
FEISTEL_WALK = 12


def feistel_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers per round below the prime, the first and last not zero."""
    import hashlib
    out = []
    for r in range(FEISTEL_ROUNDS):
        a, b, c = (int(hashlib.md5(f"{seed}:{r}:{x}".encode()).hexdigest()[:12], 16) for x in "abc")
        out.append((a % (FEISTEL_PRIME - 1) + 1, b % FEISTEL_PRIME, c % (FEISTEL_PRIME - 1) + 1))
    return out


def feistel_sides(n: int) -> tuple[int, int]:
    """Sides (a, b) of the least rectangle of about a square that holds n places."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(position: Column, n: int, seed: int) -> Column:
    """A keyed permutation of 0..n-1 as an expression on the position: no
    sort, no exchange, and each row's new place follows from its old one.

    A place is two digits in a rectangle of at least n places; a round adds a
    hash of one digit to the other and swaps them. Places at or beyond n are
    permuted again until they fall below n (cycle walking), at most
    ``FEISTEL_WALK`` times, else it raises (chance below n^-5). Null stays
    null; positions outside 0..n-1 raise."""
    if not 0 < n < 1 << 62:
        raise ValueError(f"{n} positions")
    a, b = feistel_sides(n)
    keys = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip("pqr", k)], F.lit(i % 2 == 0).alias("even"))
                     for i, k in enumerate(feistel_keys(seed))])
    prime = F.lit(FEISTEL_PRIME).cast("long")

    def mixed(x: Column, k: Column) -> Column:
        y = (x * k["p"] + k["q"]) % prime
        z = (y.bitwiseXOR(F.shiftright(y, 15)) * k["r"]) % prime
        return z.bitwiseXOR(F.shiftright(z, 13))

    def swap(at: Column, k: Column) -> Column:
        side = F.when(k["even"], F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(at["r"].alias("l"), ((at["l"] + mixed(at["r"], k)) % side).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        # an even number of rounds brings both digits back to their sides
        return F.aggregate(keys, start, swap, lambda at: at["l"] + at["r"] * F.lit(a))

    steps = min(a * b - n + 1, FEISTEL_WALK)
    inside = F.when((position < 0) | (position >= n), F.raise_error(F.lit(f"position outside 0..{n - 1}"))).otherwise(position.cast("long"))
    walked = F.aggregate(F.array_repeat(F.lit(0), steps - 1), once(inside), lambda x, _: F.when(x < n, x).otherwise(once(x))) \
        if steps > 1 else once(inside)
    return F.when(walked >= n, F.raise_error(F.lit("cycle walk too long: use another seed"))).otherwise(walked)


def feistel_permutation(df: DataFrame, n: int, seed: int, position: str = "row_id", out: str = "perm_pos") -> DataFrame:
    """F3 without a sort: ``out`` is the row's place in a permutation of
    0..n-1; ``out < m`` is a sample of m rows (F4)."""
    return df.withColumn(out, feistel(F.col(position), n, seed))
