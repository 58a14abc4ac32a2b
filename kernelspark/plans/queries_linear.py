"""Registered queries on reflectors, rank decisions, tiles, Krylov spaces,
matrix-free fits, oversampled starts and sort-free permutations, with their
DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.table_functions import register_gram, register_r
from ..operators import aggregates as A
from ..operators import cluster as CL
from ..operators import joins as J
from ..operators import lanczos as LZ
from ..operators import linalg as L
from ..operators import nystrom as NY
from ..operators import reflectors as H
from ..operators import rows as RW
from ..operators import sampling as S
from ..operators import svm as SVM
from ..operators import tiles as TL
from ..session import checkpoint_dir, remove_folder
from ..sources import tables as TB
from ..sources import text as TX
from ..sources.datasource import register
from . import sqlgen as Q
from .common import C, EMB_DIM, GAMMA, LEARN_RATE, SEED, SPLIT, centroid_matrix, embeddings, rnd, spread
from .queries import ORACLE_SQL as _QUERIES_SQL
from .queries import (_iterations, D5, KEYS, KEYS_SQL, SQL_CENTROIDS, SQL_FIT5, SQL_GRAM_EMBEDDINGS, SQL_LABEL, SQL_ROWS, SQL_SIGNED_DOCS,
                      SQL_SVM_NEWTON, SQL_Z5, STEP)

EMB = Q.cte("emb", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")


# ============================================================ D5, D6 by reflectors

def _dependent_rows(spark: SparkSession, sf: str, more) -> DataFrame:
    """The scaled lineitem columns, the bias and ``more`` columns that depend on them."""
    rows = RW.add_bias(TB.lineitem_rows(spark, sf))
    x = F.col("features")
    return rows.withColumn("features", F.concat(x, F.array(*more(x))))


def q_reflector_products(spark: SparkSession, sf: str) -> DataFrame:
    """D5 + D6 on a singular matrix (a repeated column): every row's label
    after Q Q^T, and its projection on the columns, from the coordinates of
    the independent ones."""
    rows = _dependent_rows(spark, sf, lambda x: [x[0]])
    f = H.factor(rows.withColumnRenamed("label", "x"), keep=(*KEYS, "x"))
    c = H.qt(f, "x")
    back = H.q(f, c, "v").select(*KEYS, F.lit("back").alias("kind"), rnd("v", 8).alias("value"))
    fit = H.thin_rows(f, c.top[:D5], "v").select(*KEYS, F.lit("fitted").alias("kind"), rnd("v", 5).alias("value"))
    return back.unionByName(fit)


SQL_REFLECTOR_PRODUCTS = f"""
WITH {SQL_Z5}
SELECT {KEYS_SQL}, 'back' AS kind, label AS value FROM r UNION ALL SELECT {KEYS_SQL}, 'fitted', round({SQL_FIT5}, 5) + 0.0 FROM r, z"""


def q_reflector_norms(spark: SparkSession, sf: str) -> DataFrame:
    """D5 on the same matrix: the coordinates of the independent columns, and
    whether all coordinates have the length of x to 1e-12."""
    rows = _dependent_rows(spark, sf, lambda x: [x[0]]).withColumnRenamed("label", "x")
    f = H.factor(rows, keep=("x",))
    c = H.qt(f, "x")
    length = rows.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    kept = bool(abs(c.norm_sq() / length - 1) < 1e-12)
    c.drop()
    f.drop()
    return spark.createDataFrame([(j, float(c.top[j]), length, kept) for j in range(D5)], "j int, c double, x_sq double, norm_kept boolean") \
        .select("j", rnd("c", 4).alias("c"), rnd("x_sq", 3).alias("x_sq"), "norm_kept")


SQL_REFLECTOR_NORMS = f"WITH {SQL_Z5}\n" + " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS j, round(c_{j}, 4) + 0.0 AS c, round(xsq, 3) + 0.0 AS x_sq, true AS norm_kept FROM z" for j in range(D5))


# ============================================================ D2 with rank decision

RANK_TOL = 1e-6
D7 = 7


def q_pivoted_rank(spark: SparkSession, sf: str) -> DataFrame:
    """D2 + B7: column order, diagonal of R and numerical rank of seven
    lineitem columns, two of which depend on the others."""
    rows = _dependent_rows(spark, sf, lambda x: [x[0], x[2] + x[3]])
    p = H.pivoted_r(L.tsqr_r(rows, "features", D7), tol=RANK_TOL)
    return spark.createDataFrame([(t, p.order[t], float(p.r[t, t]), p.rank) for t in range(p.rank)],
                                 "step int, col int, value double, rank int").select("step", "col", rnd("value", 4).alias("value"), "rank")


def _sql_pivoted(d: int) -> str:
    """Greedy pivoting on the Gram cells: the longest remainder first (of
    nearly equal ones the first), then its share leaves all cells."""
    out = [Q.cte("r", f"SELECT *, 1.0::DOUBLE AS f_bias FROM ({SQL_ROWS})"),
           Q.cte("x", "SELECT [f_quantity, f_extendedprice, f_discount, f_tax, f_bias, f_quantity, f_discount + f_tax] AS x FROM r"),
           Q.cte("g0", "SELECT a.i, b.i AS j, sum(x[a.i + 1] * x[b.i + 1]) AS v FROM x, range(7) a(i), range(7) b(i) GROUP BY ALL"),
           Q.cte("scale", "SELECT max(v) AS m FROM g0 WHERE i = j")]
    for t in range(d):
        out += [Q.cte(f"p{t}", f"SELECT {t} AS step, i AS p, v FROM (SELECT i, v, max(v) OVER () AS most FROM g{t} WHERE i = j), scale "
                               f"WHERE v > {Q.lit(RANK_TOL ** 2)} * m ORDER BY v < (1 - 1e-8::DOUBLE) * most, i LIMIT 1"),
                Q.cte(f"g{t + 1}", f"SELECT g.i, g.j, CASE WHEN g.i = p OR g.j = p THEN 0.0 ELSE g.v - a.v * b.v / p{t}.v END AS v "
                                   f"FROM g{t} g, p{t}, g{t} a, g{t} b WHERE a.i = p AND a.j = g.i AND b.i = p AND b.j = g.j")]
    steps = " UNION ALL ".join(f"SELECT * FROM p{t}" for t in range(d))
    return ("WITH " + ",\n".join(out) + "\nSELECT CAST(step AS INTEGER) AS step, CAST(p AS INTEGER) AS col, round(sqrt(v), 4) + 0.0 AS value, "
            f"CAST(count(*) OVER () AS INTEGER) AS rank FROM ({steps})")


SQL_PIVOTED_RANK = _sql_pivoted(D7)


# ============================================================ D1, D2 beyond one block

TILE, RIDGE = 16, 1.0


def q_tiled_gram(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 x 64 Gram matrix in 16 x 16 tiles that meet through the shuffle."""
    tiles = TL.tiled_gram(embeddings(spark, sf), EMB_DIM, tile=TILE)
    return TL.cells(tiles, EMB_DIM, TILE).select("i", "j", rnd("value", 6).alias("value"))


def q_tiled_solve(spark: SparkSession, sf: str) -> DataFrame:
    """D2 + D5 beyond one block: ridge regression of class 0 on the 64
    dimensions by block Cholesky and triangular solves over tables of tiles."""
    rows = TB.embedding_rows(spark, sf)
    g = TL.add_ridge(TL.tiled_gram(rows, EMB_DIM, tile=TILE), RIDGE, EMB_DIM, TILE)
    z = TL.tiled_solve(TL.tiled_cholesky(g, EMB_DIM, TILE), TL.tiled_rmatvec(rows, "label", EMB_DIM, tile=TILE), EMB_DIM, TILE)
    return TL.segment_values(z, TILE).select("pos", rnd("value").alias("value"))


def _sql_solve(d: int) -> str:
    """Gauss-Jordan elimination on cells; column d is the right side."""
    out = [EMB, Q.cte("c", "SELECT vec_id, unnest(range(len(x))) AS j, unnest(x) AS x, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM emb"),
           Q.cte("s0", f"SELECT a.j AS i, b.j AS j, sum(a.x * b.x) + CASE WHEN a.j = b.j THEN {Q.lit(RIDGE)} ELSE 0.0 END AS v "
                       f"FROM c a JOIN c b USING (vec_id) GROUP BY a.j, b.j UNION ALL SELECT j, {d}, sum(x * y) FROM c GROUP BY j")]
    for k in range(d):
        out.append(Q.cte(f"s{k + 1}", f"SELECT s.i, s.j, CASE WHEN s.i = {k} THEN s.v ELSE s.v - l.v * coalesce(u.v, 0.0::DOUBLE) / p.v END AS v FROM s{k} s "
                                      f"JOIN s{k} l ON l.i = s.i AND l.j = {k} LEFT JOIN s{k} u ON u.i = {k} AND u.j = s.j, "
                                      f"(SELECT v FROM s{k} WHERE i = {k} AND j = {k}) p WHERE s.j > {k} OR s.i = s.j"))
    return ("WITH " + ",\n".join(out) + f"\nSELECT CAST(b.i AS INTEGER) AS pos, round(b.v / a.v, 6) + 0.0 AS value FROM s{d} b "
            f"JOIN s{d} a ON a.i = b.i AND a.j = a.i WHERE b.j = {d}")


SQL_TILED_SOLVE = _sql_solve(EMB_DIM)


# ============================================================ D7 for few of many columns

TOP = 3


def q_top_svd(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest singular values of the embeddings and their U,
    by block Lanczos."""
    svd = LZ.top_svd(embeddings(spark, sf), TOP, keep=("vec_id",), seed=SEED)
    return svd.U.select("vec_id", *[rnd(V.item("u", j), 5).alias(f"u_{j}") for j in range(TOP)],
                        *[F.lit(round(float(s), 4)).alias(f"s_{j}") for j, s in enumerate(svd.s)])


def _sql_top(k: int, squarings: int = 13) -> str:
    """Each vector from a repeatedly squared Gram matrix, then deflation."""
    out = [EMB, Q.cte("c", "SELECT vec_id, unnest(range(len(x))) AS j, unnest(x) AS x FROM emb"),
           Q.cte("g0", "SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (vec_id) GROUP BY a.j, b.j")]
    for t in range(k):
        src = f"g{t}"
        for m in range(squarings):
            here = f"q{t}_{m}"
            out += [Q.cte(here + "s", f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {src} a JOIN {src} b ON a.j = b.i GROUP BY a.i, b.j"),
                    Q.cte(here, f"SELECT i, j, v / (SELECT sum(v) FROM {here}s WHERE i = j) AS v FROM {here}s")]
            src = here
        out += [Q.cte(f"d{t}", f"SELECT i AS top, sqrt(v) AS root FROM {src} WHERE i = j ORDER BY v DESC, i LIMIT 1"),
                Q.cte(f"v{t}", f"SELECT i, v / root AS v FROM {src}, d{t} WHERE j = top"),
                Q.cte(f"l{t}", f"SELECT sum(g.v * a.v * b.v) AS l FROM g{t} g JOIN v{t} a ON a.i = g.i JOIN v{t} b ON b.i = g.j"),
                Q.cte(f"g{t + 1}", f"SELECT g.i, g.j, g.v - l * a.v * b.v AS v FROM g{t} g JOIN v{t} a ON a.i = g.i JOIN v{t} b ON b.i = g.j, l{t}"),
                Q.cte(f"u{t}", f"SELECT vec_id, sum(x * v) / sqrt(any_value(l)) AS u FROM c JOIN v{t} ON i = j, l{t} GROUP BY vec_id")]
    joins = "".join(f" JOIN u{t} USING (vec_id)" for t in range(1, k))
    return ("WITH " + ",\n".join(out) + "\nSELECT vec_id, " + ", ".join(f"round(u{t}.u, 5) + 0.0 AS u_{t}" for t in range(k)) + ", "
            + ", ".join(f"round(sqrt((SELECT l FROM l{t})), 4) AS s_{t}" for t in range(k)) + f" FROM u0{joins}")


SQL_TOP_SVD = _sql_top(TOP)


# ============================================================ G6 without a matrix

def q_svm_newton_cg(spark: SparkSession, sf: str) -> DataFrame:
    """G3 + G6: the optimum of ``svm_newton`` by truncated Newton steps with
    conjugate gradients; no matrix in any task or on the driver."""
    rows = TB.lineitem_rows(spark, sf)
    train, test = S.train_test_split(rows, SPLIT, SEED, KEYS)
    m = SVM.fit_newton_cg(train, C=C, tol=1e-8, num_partitions=spread(spark))
    return SVM.evaluate(test, m.weights).select(
        *[F.lit(round(w, 3) + 0.0).alias(f"w_{j}") for j, w in enumerate(m.weights)],
        F.lit(m.converged).alias("converged"), "correct", "wrong", "accuracy")


# ============================================================ H1 by oversampling

K_START, ROUNDS = 4, 3


def q_kmeans_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """H1: four starting centers of the embeddings by three rounds of
    oversampling and the weighted reduction, as cells; j = -1 has the cost."""
    e = embeddings(spark, sf)
    centers = CL.kmeans_parallel(e, K_START, SEED, rounds=ROUNDS, id_cols=("vec_id",))
    cost = CL.assign_clusters(e, centers).agg(F.sum("sq_dist").alias("value")).select(
        F.lit(-1).alias("cluster"), F.lit(-1).alias("j"), rnd("value", 4).alias("value"))
    cells = [(c, j, float(v)) for c, row in enumerate(centers) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "cluster int, j int, value double").select("cluster", "j", rnd("value").alias("value")).unionByName(cost)


def _sql_kmeans_parallel() -> str:
    dist = "list_sum(list_transform(list_zip(p.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"

    def unit(key: str) -> str:
        return f"('0x' || substr(md5(concat_ws(':', '{key}', vec_id)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"

    out = [EMB, Q.cte("k0", f"SELECT 0 AS round, vec_id, x FROM emb ORDER BY md5(concat_ws(':', '{SEED}', vec_id)), vec_id LIMIT 1")]
    for r in range(1, ROUNDS + 1):
        out += [Q.cte(f"d{r}", f"SELECT p.vec_id, any_value(p.x) AS x, min({dist}) AS d FROM emb p, k{r - 1} c GROUP BY p.vec_id"),
                Q.cte(f"k{r}", f"SELECT * FROM k{r - 1} UNION ALL SELECT {r}, vec_id, x FROM d{r} WHERE {unit(f'{SEED}:{r}')} < {2.0 * K_START} * d / (SELECT sum(d) FROM d{r})")]
    out += [Q.cte("cand", f"SELECT row_number() OVER (ORDER BY round, vec_id) - 1 AS n, x FROM k{ROUNDS}"),
            Q.cte("near", f"SELECT n FROM (SELECT n, row_number() OVER (PARTITION BY p.vec_id ORDER BY {dist}, n) AS k FROM emb p, cand c) WHERE k = 1"),
            Q.cte("w0", "SELECT cand.n, x, coalesce(w, 0)::DOUBLE AS w, NULL::DOUBLE AS d FROM cand LEFT JOIN (SELECT n, count(*) AS w FROM near GROUP BY n) USING (n)")]
    for t in range(K_START):
        out += [Q.cte(f"c{t}", f"SELECT {t} AS cluster, n, x FROM w{t} ORDER BY w * coalesce(d, 1.0::DOUBLE) DESC, n LIMIT 1"),
                Q.cte(f"w{t + 1}", f"SELECT p.n, p.x, w, least(d, {dist}) AS d FROM w{t} p, c{t} c")]
    starts = " UNION ALL ".join(f"SELECT cluster, x FROM c{t}" for t in range(K_START))
    out += [Q.cte("start", starts),
            Q.cte("cost", f"SELECT sum(d) AS v FROM (SELECT min({dist}) AS d FROM emb p, start c GROUP BY p.vec_id)")]
    return ("WITH " + ",\n".join(out) + "\nSELECT CAST(cluster AS INTEGER) AS cluster, CAST(j AS INTEGER) AS j, round(v, 6) + 0.0 AS value FROM "
            "(SELECT cluster, unnest(range(len(x))) AS j, unnest(x) AS v FROM start) UNION ALL SELECT -1, -1, round(v, 4) + 0.0 FROM cost")


SQL_KMEANS_PARALLEL = _sql_kmeans_parallel()


# ============================================================ F3, F4 without a sort

def q_feistel_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """F3 + F4: every embedding's place in a keyed permutation of the row
    numbers, an expression on the number alone; places below a tenth are the sample."""
    e = embeddings(spark, sf).select("vec_id")
    n = e.count()
    return S.feistel_permutation(e, n, SEED, "vec_id").withColumn("sampled", F.col("perm_pos") < F.lit(n // 10))


def _sql_feistel() -> str:
    src = "SELECT vec_id, vec_id AS x, n, a, CAST(ceil(n::DOUBLE / a) AS BIGINT) AS b FROM embeddings, size"
    for walk in range(S.FEISTEL_WALK):
        src = f"SELECT vec_id, x, n, a, b, x % a AS l, x // a AS r FROM ({src})"
        for i, (p, q, c) in enumerate(S.feistel_keys(SEED)):
            y = f"((r * {p} + {q}) % {S.FEISTEL_PRIME})"
            src = f"SELECT vec_id, x, n, a, b, l, r, (xor({y}, {y} >> 15) * {c}) % {S.FEISTEL_PRIME} AS z FROM ({src})"
            src = f"SELECT vec_id, x, n, a, b, r AS l, (l + xor(z, z >> 13)) % {'a' if i % 2 == 0 else 'b'} AS r FROM ({src})"
        again = "true" if walk == 0 else "x >= n"
        src = f"SELECT vec_id, CASE WHEN {again} THEN l + r * a ELSE x END AS x, n, a, b FROM ({src})"
    return ("WITH size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM embeddings)\n"
            f"SELECT vec_id, x AS perm_pos, x < n // 10 AS sampled FROM ({src})")


SQL_FEISTEL_PERMUTATION = _sql_feistel()


# ============================================================ A8

def q_matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The class centroids, a matrix on the driver, as rows again; per
    class its number, width, first entry and sum."""
    rows = TX.rows_from_matrix(spark, centroid_matrix(spark, sf).tolist(), None)
    return rows.select("row_id", F.size("features").alias("width"), rnd(V.item("features", 0)).alias("x_0"),
                       rnd(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


SQL_MATRIX_ROWS = f"""
WITH {SQL_CENTROIDS.strip()}
SELECT CAST(cluster AS BIGINT) AS row_id, CAST(len(c) AS INTEGER) AS width, round(c[1], 6) + 0.0 AS x_0, round(list_sum(c), 6) + 0.0 AS total FROM cen"""


# ============================================================ K2, K4 from SQL

def q_sql_gram(spark: SparkSession, sf: str) -> DataFrame:
    """K2 + K4 + D1 called from SQL: the Gram cells of every class, groups
    spread over four salts and added by SUM."""
    register_gram(spark, "gram_cells", "label int, salt long")
    embeddings(spark, sf).selectExpr("label", "vec_id % 4 AS salt", "features").createOrReplaceTempView("ks_gram_rows")
    return spark.sql("""
        SELECT label, i, j, round(sum(value), 6) + 0.0D AS value
        FROM gram_cells(TABLE(SELECT * FROM ks_gram_rows) PARTITION BY (label, salt)) GROUP BY label, i, j""")


SQL_SQL_GRAM = """
WITH c AS (SELECT label, vec_id, unnest(range(len(embedding))) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT a.label, CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * b.x), 6) + 0.0 AS value
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY a.label, a.j, b.j"""

R_DIMS = 5


def q_sql_r(spark: SparkSession, sf: str) -> DataFrame:
    """K2 + D2 called from SQL: R of the first five dimensions of every
    class, first per class and salt, then of those R factors."""
    register_r(spark, "r_parts", "label int, salt long")
    register_r(spark, "r_rows", "label int")
    embeddings(spark, sf).selectExpr("label", "vec_id % 3 AS salt", f"slice(features, 1, {R_DIMS}) AS x").createOrReplaceTempView("ks_r_rows")
    return spark.sql("""
        SELECT label, i, CAST(j AS INT) AS j, round(value, 6) + 0.0D AS value FROM (
          SELECT label, i, posexplode(row) AS (j, value) FROM r_rows(TABLE(
            SELECT label, row FROM r_parts(TABLE(SELECT * FROM ks_r_rows) PARTITION BY (label, salt))) PARTITION BY label)) WHERE j >= i""")


SQL_SQL_R = "WITH " + ",\n".join([
    Q.cte("r", "SELECT label, " + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS x_{j}" for j in range(R_DIMS)) + " FROM embeddings"),
    Q.cte("g", "SELECT label, " + ", ".join(f"sum(x_{i} * x_{j}) AS g_{i}_{j}" for i in range(R_DIMS) for j in range(i, R_DIMS)) + " FROM r GROUP BY label"),
    *Q.cholesky("ch", "g", R_DIMS)]) + "\n" + " UNION ALL ".join(
        f"SELECT label, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(r_{i}_{j}, 6) + 0.0 AS value FROM ch" for i in range(R_DIMS) for j in range(i, R_DIMS))


# ============================================================ G5 restarted

def q_svm_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Three dual-ascent steps on the documents' quality, then the same
    run started again in its folder for five."""
    folder = f"{checkpoint_dir(spark)}/resumed-{uuid.uuid4().hex}"
    for steps in (3, 5):
        m = SVM.fit_svm(TB.document_rows(spark, sf), C=C, learn_rate=LEARN_RATE, max_iter=steps, tol=0.0, checkpoint_every=2, resume_dir=folder)
    remove_folder(spark, folder)
    return _iterations(m)


# ============================================================ A1-A4, A9 as data sources

def q_source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A4: lineitem as text lines in the shared folder, read back by the
    ``dense_lines`` source in byte ranges."""
    register(spark)
    folder = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    numbers = [*KEYS, "l_quantity", "l_extendedprice"]
    li = TB.table(spark, sf, "lineitem")
    li.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in numbers], TB.charge_label().cast("string")).alias("value")).write.text(folder)
    rows = spark.read.format("dense_lines").option("columns", len(numbers) + 1).option("label", "last").option("range_bytes", 1 << 20).load(folder)
    return rows.select(*[V.item("features", j).cast("long").alias(k) for j, k in enumerate(KEYS)],
                       *[V.item("features", j).alias(f"x_{j}") for j in (4, 5)], "label")


SQL_SOURCE_LINES = f"""
SELECT {', '.join(f'CAST({k} AS BIGINT) AS {k}' for k in KEYS)}, l_quantity AS x_4, l_extendedprice AS x_5, label
FROM (SELECT *, {SQL_LABEL} AS label FROM lineitem)"""


def q_source_history(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + A10: the history of five dual-ascent steps, written in two phases
    by the ``fit_history`` source and read back."""
    register(spark)
    m = SVM.fit_svm(TB.document_rows(spark, sf), C=C, learn_rate=LEARN_RATE, max_iter=5, tol=0.0)
    folder = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    m.history.write.format("fit_history").mode("append").save(folder)
    return spark.read.format("fit_history").load(folder).select("iteration", rnd("error", 4).alias("error"))


SQL_SOURCE_HISTORY = f"SELECT iteration, error FROM ({_QUERIES_SQL['svm_fit_documents']})"


# ============================================================ C6, H5 beyond a broadcast

def q_nystrom_joined(spark: SparkSession, sf: str) -> DataFrame:
    """C6 + H5: the rows of ``nystrom_features``, with factors that stay in
    Spark and meet salted clusters."""
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "row_id")
    assigned = CL.assign_clusters(e, centroid_matrix(spark, sf)).drop("sq_dist")
    ranks = A.rank_offsets(A.cluster_sizes(assigned).withColumn("rank", F.lit(2)), "cluster", "rank", "col_offset")
    feats = NY.nystrom_features_joined(assigned, ranks, GAMMA, SEED, factor=1)
    return feats.select(F.col("row_id").alias("vec_id"), "cluster", F.size("u").alias("rank"),
                        rnd(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("phi_sq"))


# ============================================================ C3, C5 between two large sides

LINK_T = 0.28


def q_kernel_links(spark: SparkSession, sf: str) -> DataFrame:
    """C3 + C5: for every embedding the number of others with a kernel value
    of at least 0.28 and the first of them (-1: none), by metric partitioning; small
    blocks, so that cells are split."""
    e = embeddings(spark, sf)
    links = J.kernel_links(e, e, "vec_id", "vec_id", GAMMA, LINK_T, pivots=16, block_rows=20, same_rows=True)
    return links.select(F.col("i").alias("vec_id"), "n_links", F.coalesce("first_link", F.lit(-1)).alias("first_link"))


SQL_KERNEL_LINKS = f"""
WITH {EMB},
hit AS (SELECT a.vec_id, b.vec_id AS other FROM emb a JOIN emb b ON a.vec_id <> b.vec_id
        AND exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) >= {LINK_T!r}::DOUBLE)
SELECT emb.vec_id, count(other) AS n_links, coalesce(min(other), -1) AS first_link FROM emb LEFT JOIN hit ON hit.vec_id = emb.vec_id GROUP BY emb.vec_id"""


# ============================================================ G2-G6 on a wide design, B8, E7 on a fit's state

D65, WIDE_STEPS = EMB_DIM + 1, 5


def q_svm_wide_steps(spark: SparkSession, sf: str) -> DataFrame:
    """G2-G6 on all 64 dimensions and the bias: w after each of five
    dual-ascent steps; j = -1 has the step's error."""
    m = SVM.fit_svm(TB.embedding_rows(spark, sf).drop("class_label"), C=C, learn_rate=LEARN_RATE, max_iter=WIDE_STEPS, tol=0.0)
    cells = [(t, j, x) for t, w in enumerate(m.weights_path, 1) for j, x in enumerate(w)] + [(t, -1, e) for t, e in m.history_rows]
    return spark.createDataFrame(cells, "iteration int, j int, value double").select("iteration", "j", rnd("value", 4).alias("value"))


def _sql_wide_steps(d: int) -> str:
    """M inverted by Gauss-Jordan elimination on cells, then the steps row by row."""
    out = [Q.cte("a", "SELECT vec_id, y * v AS v, j FROM (SELECT vec_id, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, unnest(range(len(embedding) + 1)) AS j, "
                      "unnest(list_append(CAST(embedding AS DOUBLE[]), 1.0::DOUBLE)) AS v FROM embeddings)"),
           Q.cte("s0", f"SELECT a.j AS i, b.j, sum(a.v * b.v) + CASE WHEN a.j = b.j THEN {Q.lit(1 / (2 * C))} ELSE 0.0 END AS v FROM a JOIN a b USING (vec_id) "
                       f"GROUP BY a.j, b.j UNION ALL SELECT i, i + {d}, 1.0::DOUBLE FROM range({d}) r(i)")]
    for k in range(d):
        # column d + i of the right half fills up row by row: absent cells are zeros
        out.append(Q.cte(f"s{k + 1}", f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM s{k} WHERE j > {k} OR i = j UNION ALL "
                                      f"SELECT l.i, u.j, -l.v * u.v / p.v FROM s{k} l, s{k} u, (SELECT v FROM s{k} WHERE i = {k} AND j = {k}) p "
                                      f"WHERE l.j = {k} AND l.i <> {k} AND u.i = {k} AND u.j > {k}) GROUP BY i, j"))
    out += [Q.cte("inv", f"SELECT b.i, b.j - {d} AS j, b.v / p.v AS v FROM s{d} b JOIN s{d} p ON p.i = b.i AND p.j = b.i WHERE b.j >= {d}"),
            Q.cte("b0", "SELECT DISTINCT vec_id, 1.0::DOUBLE AS beta FROM a")]
    for t in range(1, WIDE_STEPS + 1):
        out += [Q.cte(f"u{t}", f"SELECT j, sum(v * (1.0::DOUBLE + beta)) AS u FROM a JOIN b{t - 1} USING (vec_id) GROUP BY j"),
                Q.cte(f"w{t}", f"SELECT i AS j, sum(v * u) AS w FROM inv JOIN u{t} USING (j) GROUP BY i"),
                Q.cte(f"b{t}", f"SELECT vec_id, greatest(beta - {Q.lit(STEP * 2 * C)} * (1.0::DOUBLE + beta - m), 0.0::DOUBLE) AS beta, beta AS old FROM b{t - 1} "
                               f"JOIN (SELECT vec_id, sum(v * w) AS m FROM a JOIN w{t} USING (j) GROUP BY vec_id) USING (vec_id)")]
    rows = " UNION ALL ".join(f"SELECT {t} AS iteration, j, w AS value FROM w{t} UNION ALL SELECT {t}, -1, sum(abs(beta - old)) FROM b{t}" for t in range(1, WIDE_STEPS + 1))
    return "WITH " + ",\n".join(out) + f"\nSELECT CAST(iteration AS INTEGER) AS iteration, CAST(j AS INTEGER) AS j, round(value, 4) + 0.0 AS value FROM ({rows})"


SQL_SVM_WIDE_STEPS = _sql_wide_steps(D65)


def q_fit_support(spark: SparkSession, sf: str) -> DataFrame:
    """B8 + E7 on the state of a fit: the support vectors after five
    dual-ascent steps on the documents' quality, and the bias they give."""
    rows = TB.document_rows(spark, sf)
    m = SVM.fit_svm(rows, C=C, learn_rate=LEARN_RATE, max_iter=5, tol=0.0)
    held = rows.join(m.state.select("row_id", "alpha"), "row_id")
    bias = A.bias_from_support(held).first()
    return RW.support_vectors(held).select("row_id", rnd("alpha", 5).alias("alpha"), F.lit(round(bias["bias"], 4)).alias("bias"),
                                           F.lit(bias["n_support"]).cast("long").alias("n_support"))


SQL_FIT_SUPPORT = "WITH " + ",\n".join([Q.cte("rows_", SQL_SIGNED_DOCS), *Q.dual_ascent("rows_", 3, C, STEP, 5),
                                        Q.cte("sv", "SELECT id, alpha, a_2 AS y, a_0 / a_2 AS x_0, a_1 / a_2 AS x_1 FROM s5 WHERE alpha > 0.001"),
                                        Q.cte("k", "SELECT y AS yk, x_0 AS k_0, x_1 AS k_1 FROM sv ORDER BY id LIMIT 1"),
                                        Q.cte("b", "SELECT any_value(yk) - sum(alpha * y * (x_0 * k_0 + x_1 * k_1)) AS bias, count(*) AS n FROM sv, k")]) + """
SELECT id AS row_id, round(alpha, 5) + 0.0 AS alpha, round(bias, 4) AS bias, n AS n_support FROM sv, b"""


QUERIES = {
    "svm_wide_steps": q_svm_wide_steps,
    "fit_support": q_fit_support,
    "kernel_links": q_kernel_links,
    "nystrom_joined": q_nystrom_joined,
    "source_lines": q_source_lines,
    "source_history": q_source_history,
    "sql_gram": q_sql_gram,
    "sql_r": q_sql_r,
    "svm_resumed": q_svm_resumed,
    "reflector_products": q_reflector_products,
    "reflector_norms": q_reflector_norms,
    "pivoted_rank": q_pivoted_rank,
    "tiled_gram": q_tiled_gram,
    "tiled_solve": q_tiled_solve,
    "top_svd": q_top_svd,
    "svm_newton_cg": q_svm_newton_cg,
    "kmeans_parallel": q_kmeans_parallel,
    "feistel_permutation": q_feistel_permutation,
    "matrix_rows": q_matrix_rows,
}

ORACLE_SQL = {
    "svm_wide_steps": SQL_SVM_WIDE_STEPS,
    "fit_support": SQL_FIT_SUPPORT,
    "kernel_links": SQL_KERNEL_LINKS,
    "nystrom_joined": _QUERIES_SQL["nystrom_features"],
    "source_lines": SQL_SOURCE_LINES,
    "source_history": SQL_SOURCE_HISTORY,
    "sql_gram": SQL_SQL_GRAM,
    "sql_r": SQL_SQL_R,
    "svm_resumed": _QUERIES_SQL["svm_fit_documents"],
    "reflector_products": SQL_REFLECTOR_PRODUCTS,
    "reflector_norms": SQL_REFLECTOR_NORMS,
    "pivoted_rank": SQL_PIVOTED_RANK,
    "tiled_gram": SQL_GRAM_EMBEDDINGS,
    "tiled_solve": SQL_TILED_SOLVE,
    "top_svd": SQL_TOP_SVD,
    "svm_newton_cg": SQL_SVM_NEWTON,
    "kmeans_parallel": SQL_KMEANS_PARALLEL,
    "feistel_permutation": SQL_FEISTEL_PERMUTATION,
    "matrix_rows": SQL_MATRIX_ROWS,
}
