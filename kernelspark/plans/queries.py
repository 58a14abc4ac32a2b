"""Registered driver queries and their DuckDB twins.

Every query reads the whole tables of a scale-factor folder (or sets that
Spark derives from them) and returns a DataFrame; ``ORACLE_SQL`` holds the
equivalent SQL over the same tables where one exists. Column names and
rounding agree on both sides.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import linalg as L
from ..operators import rows as RW
from ..operators import sampling as S
from ..operators import svm as SVM
from ..sources import tables as TB
from ..sources import text as TX
from . import sqlgen as Q
from .common import (C, EMB_DIM, ETA, FIXED_W, GAMMA, LEARN_RATE, SEED, SPLIT,
                     TARGET_RANK, TARGET_RANK_CLASSES, centroid_matrix, class_centroids, embeddings, rnd, spread)

KEYS = list(TB.LINEITEM_KEYS)
KEYS_SQL = ", ".join(KEYS)


def _sql_feats() -> str:
    c, s = TB.LINEITEM_CENTER, TB.LINEITEM_SCALE
    return ", ".join(f"(l_{n} - {c['l_' + n]!r}::DOUBLE) / {s['l_' + n]!r}::DOUBLE AS f_{n}"
                     for n in ("quantity", "extendedprice", "discount", "tax"))


SQL_LABEL = ("CASE WHEN l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) "
             f"> {TB.CHARGE_THRESHOLD!r}::DOUBLE THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END")
SQL_ROWS = f"SELECT {KEYS_SQL}, {_sql_feats()}, {SQL_LABEL} AS label FROM lineitem"
# one parameter for every generated twin: the four scaled columns and the bias
D5 = 5
FEAT_NAMES = ["f_quantity", "f_extendedprice", "f_discount", "f_tax"]


# ============================================================ A. sources

def q_parse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A1/A3: lineitem as space-separated text lines (four values, label
    last), parsed back by trim/split/cast with a width check."""
    li = TB.table(spark, sf, "lineitem")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in
                              ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
                       TB.charge_label().cast("string"))
    lines = li.select(*KEYS, line.alias("value"))
    v = TX.parse_dense(lines, 5, " ", strict=True, keep=KEYS)
    return v.select(*KEYS, F.col("features")[0].alias("quantity"),
                    F.col("features")[1].alias("price"), F.col("features")[2].alias("discount"),
                    F.col("features")[3].alias("tax"), F.element_at("features", -1).alias("label"))


SQL_PARSE_ROWS = f"""
SELECT {KEYS_SQL}, l_quantity AS quantity, l_extendedprice AS price,
       l_discount AS discount, l_tax AS tax, {SQL_LABEL} AS label
FROM lineitem"""


def q_row_positions(spark: SparkSession, sf: str) -> DataFrame:
    """0-based position of every lineitem row in key order, without a
    single-partition window."""
    li = TB.table(spark, sf, "lineitem").select(*KEYS)
    return TX.with_row_id(li, KEYS)


SQL_ROW_POSITIONS = f"""
SELECT {KEYS_SQL}, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_id FROM lineitem"""


def q_head_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 rows in key order (a top-n report)."""
    li = TB.table(spark, sf, "lineitem").select(*KEYS, "l_quantity")
    return TX.head_rows(li, 100, KEYS)


SQL_HEAD_ROWS = f"SELECT {KEYS_SQL}, l_quantity FROM lineitem ORDER BY {KEYS_SQL} LIMIT 100"


def q_count_check(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the count check on documents and labels; it passes for a table's
    own count and raises for the other's unless they agree."""
    docs, labels = (TB.table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    n_labels = labels.count()

    def passes(df, declared):
        try:
            return TX.check_count(df, declared), True
        except ValueError:
            return df.count(), False
    n_rows, equal = passes(docs, n_labels)
    _, own = passes(labels, n_labels)
    return spark.createDataFrame([(n_rows, n_labels, n_rows - n_labels, equal, own)],
                                 "n_rows long, n_labels long, difference long, counts_equal boolean, own_count boolean")


SQL_COUNT_CHECK = """
SELECT n_rows, n_labels, n_rows - n_labels AS difference, n_rows = n_labels AS counts_equal, true AS own_count FROM
 (SELECT count(*) AS n_rows FROM documents), (SELECT count(*) AS n_labels FROM labels)"""


def _lines(df: DataFrame, order: list[str], cols, sep: str) -> DataFrame:
    """Text lines ``(row_id, value)`` of whole tables, numbered in key order."""
    value = F.concat_ws(sep, *[c.cast("string") for c in cols])
    return TX.with_row_id(df.select(*order, value.alias("value")), order).select("row_id", "value")


def q_labeled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A1: space-separated lines with the label last, read as labelled rows."""
    li = TB.table(spark, sf, "lineitem")
    lines = _lines(li, KEYS, [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), TB.charge_label()], " ")
    rows = TX.labeled_rows(lines, 4)
    return rows.select("row_id", *[V.item("features", j).alias(f"x_{j}") for j in range(3)], "label")


SQL_POSITION = f"SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_id FROM lineitem"
SQL_LABELED_LINES = f"""
SELECT row_id, l_quantity AS x_0, l_extendedprice AS x_1, l_discount AS x_2, {SQL_LABEL} AS label FROM ({SQL_POSITION})"""


def q_label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A3 + C1: label lines (first token counts), zipped by position with
    hold-out lines read by A4 (comma, extra columns ignored, bias added)."""
    li = TB.table(spark, sf, "lineitem")
    texts = [F.concat_ws(sep, *[c.cast("string") for c in cols]).alias(name) for name, sep, cols in (
        ("h", ",", [F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber")]),
        ("l", " ", [TB.charge_label(), F.col("l_returnflag")]))]
    numbered = TX.with_row_id(li.select(*KEYS, *texts), KEYS)       # ranked and written once for both
    holdout = TX.dense_rows(numbered.select("row_id", F.col("h").alias("value")), 2, sep=",", strict=False, append_bias=True)
    labels = TX.first_labels(numbered.select("row_id", F.col("l").alias("value")))
    return J.positional_zip(holdout, labels).select(
        "row_id", F.size("features").alias("width"), *[V.item("features", j).alias(f"x_{j}") for j in range(3)], "label")


SQL_LABEL_LINES = f"""
SELECT row_id, CAST(3 AS INTEGER) AS width, l_quantity AS x_0, l_tax AS x_1, 1.0::DOUBLE AS x_2, {SQL_LABEL} AS label FROM ({SQL_POSITION})"""


# ============================================================ B. rows

def q_signed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + B1 + B2: a = y (x, 1) on the lineitem "charge" rows."""
    rows = RW.sign_rows(RW.add_bias(TB.lineitem_rows(spark, sf)))
    return rows.select(*KEYS, "label", *[rnd(V.item("features", j)).alias(f"a_{j}")
                                         for j in range(5)])


SQL_SIGNED_ROWS = f"""
WITH r AS ({SQL_ROWS})
SELECT {KEYS_SQL}, label,
       round(label * f_quantity, 6) + 0.0 AS a_0, round(label * f_extendedprice, 6) + 0.0 AS a_1,
       round(label * f_discount, 6) + 0.0 AS a_2, round(label * f_tax, 6) + 0.0 AS a_3,
       round(label * 1.0::DOUBLE, 6) + 0.0 AS a_4
FROM r"""


def q_elementwise(spark: SparkSession, sf: str) -> DataFrame:
    """B4-B7 on the embedding vectors: exp, power 3 of non-zeros, clip at
    zero, zeroing of entries under 0.05, summarised per vector."""
    e = embeddings(spark, sf)
    return e.select(
        "vec_id",
        rnd(V.norm_l1(V.elementwise_exp("features"))).alias("exp_sum"),
        rnd(F.aggregate(V.elementwise_power("features", 3.0), F.lit(0.0),
                        lambda a, x: a + x), 8).alias("pow3_sum"),
        rnd(F.aggregate(V.clip_negative("features"), F.lit(0.0), lambda a, x: a + x)).alias("clip_sum"),
        F.size(F.filter(V.zero_small("features", 0.05), lambda x: x == F.lit(0.0)))
        .alias("n_zeroed"))


SQL_ELEMENTWISE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id,
  round(list_sum(list_transform(x, lambda v: abs(exp(v)))), 6) + 0.0 AS exp_sum,
  round(list_sum(list_transform(x, lambda v: CASE WHEN v <> 0 THEN pow(v, 3.0::DOUBLE) ELSE v END)), 8) + 0.0 AS pow3_sum,
  round(list_sum(list_transform(x, lambda v: greatest(v, 0.0::DOUBLE))), 6) + 0.0 AS clip_sum,
  CAST(len(list_filter(list_transform(x, lambda v: CASE WHEN abs(v) < 0.05 THEN 0.0::DOUBLE ELSE v END), lambda v: v = 0.0)) AS INTEGER) AS n_zeroed
FROM e"""


def q_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """B12 + B13 + E3 + E4 (G8): margins of a fixed model on every lineitem
    row, prediction (ties negative) and the confusion counts."""
    return SVM.evaluate(TB.lineitem_rows(spark, sf), FIXED_W)


def _sql_margin() -> str:
    w = FIXED_W
    return (f"(((f_quantity * {w[0]!r}::DOUBLE + f_extendedprice * {w[1]!r}::DOUBLE) + "
            f"(f_discount * {w[2]!r}::DOUBLE + f_tax * {w[3]!r}::DOUBLE)) + {w[4]!r}::DOUBLE)")


SQL_SCORING = f"""
WITH r AS ({SQL_ROWS}), p AS (
  SELECT label, CASE WHEN {_sql_margin()} > 0 THEN 1.0 ELSE -1.0 END AS pred FROM r)
SELECT CAST(count_if((pred > 0 AND label = 1.0) OR (pred < 0 AND label = -1.0)) AS BIGINT) AS correct,
       CAST(count_if(NOT ((pred > 0 AND label = 1.0) OR (pred < 0 AND label = -1.0))) AS BIGINT) AS wrong,
       CAST(count_if(pred > 0 AND label = 1.0) AS BIGINT) AS correct_pos,
       CAST(count_if(pred < 0 AND label = -1.0) AS BIGINT) AS correct_neg,
       CAST(count_if(pred > 0 AND label <> 1.0) AS BIGINT) AS wrong_pos,
       CAST(count_if(pred < 0 AND label <> -1.0) AS BIGINT) AS wrong_neg,
       100.0::DOUBLE * count_if((pred > 0 AND label = 1.0) OR (pred < 0 AND label = -1.0)) / count(*) AS accuracy
FROM p"""


def q_support_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a dual value above 0.001, for a given dual vector
    alpha_i = max(0, 1 - y_i * 8 x_i0) on the embeddings (class 0 = +1)."""
    rows = TB.embedding_rows(spark, sf)
    alpha = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("label") * F.lit(8.0) * V.item("features", 0))
    sv = RW.support_vectors(rows.withColumn("alpha", alpha))
    return sv.select("row_id", rnd("alpha").alias("alpha"))


_SQL_ALPHA = ("greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN label = 0 THEN 1.0::DOUBLE "
              "ELSE -1.0::DOUBLE END) * 8.0::DOUBLE * CAST(embedding[1] AS DOUBLE))")
SQL_SUPPORT_VECTORS = f"""
SELECT vec_id AS row_id, round(alpha, 6) + 0.0 AS alpha FROM
 (SELECT vec_id, {_SQL_ALPHA} AS alpha FROM embeddings) WHERE alpha > 0.001"""


def q_bias_from_support(spark: SparkSession, sf: str) -> DataFrame:
    """b = y_k - sum alpha_i y_i x_i . x_k over the support vectors of
    the dual vector of ``support_vectors``; k = smallest id."""
    rows = TB.embedding_rows(spark, sf)
    alpha = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("label") * F.lit(8.0) * V.item("features", 0))
    b = A.bias_from_support(rows.withColumn("alpha", alpha))
    return b.select(rnd("bias", 5).alias("bias"), "n_support")


SQL_BIAS_FROM_SUPPORT = f"""
WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
                  CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
                  {_SQL_ALPHA} AS alpha FROM embeddings),
 sv AS (SELECT * FROM r WHERE alpha > 0.001),
 k AS (SELECT x AS xk, y AS yk FROM sv ORDER BY vec_id LIMIT 1)
SELECT round(min(yk) - sum(alpha * y * list_dot_product(x, xk)), 5) + 0.0 AS bias,
       count(*) AS n_support
FROM sv, k"""


def q_gather_ids(spark: SparkSession, sf: str) -> DataFrame:
    """B9 + B10: the members at positions 0..4 (by id) of every class,
    resolved to global ids through (class, position) index composition."""
    e = TB.table(spark, sf, "embeddings").select(F.col("label").alias("cluster"),
                                                 F.col("vec_id").alias("row_id"))
    index = (e.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
              .select("cluster", F.explode(F.sequence(
                  F.lit(0).cast("long"), (F.least(F.col("n"), F.lit(5)) - 1).cast("long")))
                  .alias("pos")))
    return RW.gather_ids(e, index).select("cluster", "pos", "row_id")


SQL_GATHER_IDS = """
SELECT cluster, pos, row_id FROM
 (SELECT label AS cluster, vec_id AS row_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings)
WHERE pos < 5"""


def q_gather_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings gathered by a list of ids in list order; the list is
    the labelled documents' ids, best quality first."""
    labels = TB.table(spark, sf, "labels").select("doc_id", "quality")
    ids = TX.with_row_id(labels.select((-F.col("quality")).alias("q"), "doc_id"), ["q", "doc_id"], "pos").select(
        "pos", F.col("doc_id").alias("row_id"))
    rows = embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), V.item("features", 0).alias("x_0"))
    return RW.gather(rows, ids).select("pos", "row_id", rnd("x_0").alias("x_0"))


SQL_GATHER_ROWS = """
SELECT pos, vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS x_0
FROM (SELECT doc_id, row_number() OVER (ORDER BY -quality, doc_id) - 1 AS pos FROM labels) JOIN embeddings ON doc_id = vec_id"""


def q_kth_smallest(spark: SparkSession, sf: str) -> DataFrame:
    """the k-th smallest extended price for k at 1, half and all rows."""
    li = TB.table(spark, sf, "lineitem").select("l_extendedprice")
    n = li.count()
    ks = [1, (n + 1) // 2, n]
    return spark.createDataFrame(list(zip(ks, S.kth_values(li, "l_extendedprice", ks))), "k long, value double").distinct()


SQL_KTH_SMALLEST = """
WITH r AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)
SELECT DISTINCT k, value FROM r WHERE k = 1 OR k = (n + 1) // 2 OR k = n"""


def q_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """C1 + A7: the labels by id and the same table by (quality, id), each
    numbered by its own order and aligned by position."""
    labels = TB.table(spark, sf, "labels")
    left = TX.with_row_id(labels.select("doc_id", "toxic"), ["doc_id"])
    right = TX.with_row_id(labels.select(F.col("doc_id").alias("label_doc_id"), "quality"), ["quality", "label_doc_id"])
    return J.positional_zip(left, right).select("row_id", "doc_id", "label_doc_id", "quality", "toxic")


SQL_POSITIONAL_ZIP = """
WITH d AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labels),
     l AS (SELECT doc_id AS label_doc_id, quality, row_number() OVER (ORDER BY quality, doc_id) - 1 AS row_id FROM labels)
SELECT d.row_id, doc_id, label_doc_id, quality, toxic FROM d JOIN l ON d.row_id = l.row_id"""


def q_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on documents: labelled rows of log1p(characters), log1p(words)
    over the whole texts, label +1 for quality 1."""
    rows = TB.document_rows(spark, sf)
    return rows.select("row_id", "label", rnd(V.item("features", 0)).alias("f_chars"),
                       rnd(V.item("features", 1)).alias("f_words"))


SQL_DOC_ROWS = """
SELECT d.doc_id AS row_id, CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS label,
       ln(1 + CAST(d.n_chars AS DOUBLE)) AS f_chars,
       ln(1 + CAST(len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda t: t <> '')) AS DOUBLE)) AS f_words
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

SQL_DOCUMENT_ROWS = f"""
SELECT row_id, label, round(f_chars, 6) + 0.0 AS f_chars, round(f_words, 6) + 0.0 AS f_words
FROM ({SQL_DOC_ROWS})"""


def q_scale_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each document row times its own weight (1 + toxic) from the
    labels table, matched by id after an equal-count check."""
    rows = TB.document_rows(spark, sf)
    weights = TB.table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), (F.lit(1.0) + F.col("toxic")).alias("weight"))
    scaled = RW.scale_rows(rows, weights)
    return scaled.select("row_id", rnd(V.item("features", 0)).alias("f_chars"),
                         rnd(V.item("features", 1)).alias("f_words"))


SQL_SCALE_ROWS = f"""
SELECT r.row_id, round(f_chars * (1.0::DOUBLE + l.toxic), 6) + 0.0 AS f_chars,
       round(f_words * (1.0::DOUBLE + l.toxic), 6) + 0.0 AS f_words
FROM ({SQL_DOC_ROWS}) r JOIN labels l ON r.row_id = l.doc_id"""


# ============================================================ C/H. centers

SQL_CENTROIDS = """
cx AS (SELECT label, j, avg(x) AS x FROM
        (SELECT label, unnest(range(len(embedding))) AS j,
                unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, j),
cen AS (SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster,
               list(x ORDER BY j) AS c FROM cx GROUP BY label),
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def _dist_rows(spark, sf) -> DataFrame:
    cen = centroid_matrix(spark, sf)
    return J.center_distances(embeddings(spark, sf), cen)


def q_point_center_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Squared distance of every embedding to every class centroid."""
    d = _dist_rows(spark, sf)
    return d.select("vec_id", F.posexplode("dists").alias("cluster", "sq_dist")).select(
        "vec_id", "cluster", rnd("sq_dist").alias("sq_dist"))


SQL_POINT_CENTER_DISTANCE = f"""
WITH {SQL_CENTROIDS}
SELECT vec_id, cluster, round(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS sq_dist
FROM emb, cen"""


def q_assign_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """H2 = C2 + E5: nearest class centroid (ties to the lower index)."""
    d = A.argmin_cluster(_dist_rows(spark, sf))
    return d.select("vec_id", F.col("cluster").cast("int").alias("cluster"),
                    rnd(F.array_min("dists")).alias("sq_dist"))


SQL_ASSIGN = f"""
d AS (SELECT vec_id, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS sq_dist
      FROM emb, cen),
a AS (SELECT vec_id, cluster, sq_dist FROM
       (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq_dist, cluster) AS rn FROM d)
      WHERE rn = 1)"""

SQL_ASSIGN_CLUSTERS = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN}
SELECT vec_id, cluster, round(sq_dist, 6) + 0.0 AS sq_dist FROM a"""


def q_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per cluster of the nearest-centroid assignment."""
    d = A.argmin_cluster(_dist_rows(spark, sf))
    return A.cluster_sizes(d.withColumn("cluster", F.col("cluster").cast("int")))


SQL_CLUSTER_SIZES = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN}
SELECT cluster, count(*) AS n FROM a GROUP BY cluster"""


def q_lloyd_step(spark: SparkSession, sf: str) -> DataFrame:
    """H1 (own Lloyd step): assign to the class centroids, then the mean of
    each cluster, as (cluster, j, value) cells."""
    from ..operators import cluster as CL
    cen = centroid_matrix(spark, sf)
    new = CL.lloyd_step(embeddings(spark, sf), cen)
    return new.select("cluster", F.posexplode("center").alias("j", "value")).select(
        "cluster", "j", rnd("value").alias("value"))


SQL_LLOYD_STEP = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN},
cells AS (SELECT a.cluster, unnest(range(len(emb.x))) AS j, unnest(emb.x) AS x
          FROM a JOIN emb USING (vec_id))
SELECT cluster, CAST(j AS INTEGER) AS j, round(avg(x), 6) + 0.0 AS value FROM cells GROUP BY cluster, j"""


def q_lloyd_two_steps(spark: SparkSession, sf: str) -> DataFrame:
    """H1 (own Lloyd iterations): two steps from the class centroids; the
    centers after the second step as (cluster, j, value) cells."""
    from ..operators import cluster as CL
    cen = CL.lloyd(embeddings(spark, sf), centroid_matrix(spark, sf), 2)
    cells = [(c, j, float(cen[c, j])) for c in range(cen.shape[0]) for j in range(cen.shape[1])]
    return spark.createDataFrame(cells, "cluster int, j int, value double").select(
        "cluster", "j", rnd("value").alias("value"))


SQL_LLOYD_TWO_STEPS = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN},
c1 AS (SELECT cluster, list(x ORDER BY j) AS c FROM
        (SELECT a.cluster, j, avg(x) AS x FROM
          (SELECT a.cluster, unnest(range(len(emb.x))) AS j, unnest(emb.x) AS x FROM a JOIN emb USING (vec_id)) a
         GROUP BY a.cluster, j) GROUP BY cluster),
d2 AS (SELECT vec_id, c1.cluster, list_sum(list_transform(list_zip(emb.x, c1.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS sq_dist
       FROM emb, c1),
a2 AS (SELECT vec_id, cluster FROM
        (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq_dist, cluster) AS rn FROM d2) WHERE rn = 1),
cells2 AS (SELECT a2.cluster, unnest(range(len(emb.x))) AS j, unnest(emb.x) AS x FROM a2 JOIN emb USING (vec_id))
SELECT cluster, CAST(j AS INTEGER) AS j, round(avg(x), 6) + 0.0 AS value FROM cells2 GROUP BY cluster, j"""


def q_rbf_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """RBF kernel (gamma 1) of every embedding with every class centroid."""
    cen = class_centroids(spark, sf)
    k = J.pairwise(embeddings(spark, sf), cen, "vec_id", "cluster", gamma=GAMMA)
    return k.select(F.col("i").alias("vec_id"), F.col("j").alias("cluster"),
                    rnd("value").alias("value"))


SQL_RBF_KERNEL = f"""
WITH {SQL_CENTROIDS}
SELECT vec_id, cluster, round(exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) + 0.0 AS value
FROM emb, cen"""


def q_pairwise_sq_distance(spark: SparkSession, sf: str) -> DataFrame:
    """C4: squared distances between all pairs of class centroids (K x K)."""
    cen = class_centroids(spark, sf)
    k = J.pairwise(cen, cen, "cluster", "cluster")
    return k.select(F.col("i").alias("ci"), F.col("j").alias("cj"), rnd("value").alias("value"))


SQL_PAIRWISE_SQ_DISTANCE = f"""
WITH {SQL_CENTROIDS}
SELECT a.cluster AS ci, b.cluster AS cj,
       round(list_sum(list_transform(list_zip(a.c, b.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS value
FROM cen a, cen b"""


def q_link_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """H3 + F2: K x K centroid kernel, all entries sorted, the threshold at
    position ceil((K^2 - K) * eta)."""
    from ..operators import cluster as CL
    cen = centroid_matrix(spark, sf)
    thr, mm = CL.link_threshold(cen, GAMMA, ETA, spark)
    return spark.createDataFrame([(int(mm), float(thr))], "mm int, threshold double").select(
        "mm", rnd("threshold").alias("threshold"))


SQL_KERNEL_KK = f"""
kk AS (SELECT a.cluster AS i, b.cluster AS j,
              exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(a.c, b.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS value
       FROM cen a, cen b),
kn AS (SELECT count(DISTINCT i) AS k FROM kk),
mm AS (SELECT CAST(ceil((k * k - k) * {ETA!r}::DOUBLE) AS INTEGER) AS mm FROM kn),
thr AS (SELECT mm, CASE WHEN mm = 0 THEN 0.0::DOUBLE ELSE
          (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM kk)
           WHERE rn = mm) END AS threshold FROM mm)"""

SQL_LINK_THRESHOLD = f"""
WITH {SQL_CENTROIDS}, {SQL_KERNEL_KK}
SELECT mm, round(threshold, 6) + 0.0 AS threshold FROM thr"""


def q_cluster_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Linked center pairs i < j whose kernel reaches the threshold."""
    from ..operators import cluster as CL
    cen = centroid_matrix(spark, sf)
    thr, _ = CL.link_threshold(cen, GAMMA, ETA, spark)
    kk = CL.center_kernel(spark, cen, GAMMA)
    return J.cluster_pairs(kk, thr).select("i", "j", rnd("value").alias("value"))


SQL_CLUSTER_PAIRS = f"""
WITH {SQL_CENTROIDS}, {SQL_KERNEL_KK}
SELECT i, j, round(value, 6) + 0.0 AS value FROM kk, thr WHERE i < j AND value >= threshold"""


def q_rank_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """H4 + F1: ranks per cluster ceil(target * n_c / N), surplus taken from
    the last cluster, capped by n_c; column offsets by running sum."""
    from ..operators import cluster as CL
    d = A.argmin_cluster(_dist_rows(spark, sf)).withColumn("cluster", F.col("cluster").cast("int"))
    return CL.rank_allocation(A.cluster_sizes(d), TARGET_RANK_CLASSES)


SQL_RANK_ALLOCATION = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN},
sz AS (SELECT cluster, count(*) AS n FROM a GROUP BY cluster),
r0 AS (SELECT cluster, n, CAST(ceil({TARGET_RANK_CLASSES} * n / (sum(n) OVER ())::DOUBLE) AS INTEGER) AS r,
              max(cluster) OVER () AS last FROM sz),
r1 AS (SELECT cluster, n, CASE WHEN cluster = last THEN r - (sum(r) OVER () - {TARGET_RANK_CLASSES}) ELSE r END AS r FROM r0),
r2 AS (SELECT cluster, n, CAST(least(r, n) AS INTEGER) AS rank FROM r1)
SELECT cluster, n, rank,
       CAST(coalesce(sum(rank) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col_offset
FROM r2"""


def q_block_features(spark: SparkSession, sf: str) -> DataFrame:
    """H7: each whole embedding placed at column offset d * cluster (nearest
    class centroid) of a row of width d * K, zeros elsewhere."""
    from ..operators import nystrom as NY
    cen = centroid_matrix(spark, sf)
    k, d = cen.shape
    a = _assign_to_centroids(spark, sf, cen)
    placed = NY.block_features(a.withColumn("off", F.col("cluster") * F.lit(d)), "features", "off", k * d, out="block")
    return placed.select("vec_id", "cluster", F.size("block").alias("width"),
                         F.array_position(F.transform("block", lambda x: x != F.lit(0.0)),
                                          F.lit(True)).cast("int").alias("first_nonzero"),
                         rnd(F.aggregate("block", F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
                         rnd(F.aggregate(F.transform("block", lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x), 4).alias("moment"))


def _assign_to_centroids(spark, sf, cen):
    from ..operators import cluster as CL
    return CL.assign_clusters(embeddings(spark, sf), cen)


SQL_BLOCK_FEATURES = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN}, k AS (SELECT count(*) AS k FROM cen)
SELECT a.vec_id, a.cluster, CAST(len(x) * k AS INTEGER) AS width,
       CAST(CASE WHEN list_position(list_transform(x, lambda v: v <> 0), true) > 0
            THEN len(x) * a.cluster + list_position(list_transform(x, lambda v: v <> 0), true) ELSE 0 END AS INTEGER) AS first_nonzero,
       round(list_sum(x), 6) + 0.0 AS total,
       round(list_sum(list_transform(x, lambda v, i: v * (i - 1 + len(x) * a.cluster))), 4) + 0.0 AS moment
FROM a JOIN emb USING (vec_id), k"""


# ============================================================ F. sampling

def q_sample_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """F3 + F4: 5 landmarks per class, first of a seeded md5 permutation."""
    e = TB.table(spark, sf, "embeddings").select("vec_id", "label")
    s = S.sample_n(e, SEED, ["vec_id"], "label", 5, 5)
    return s.select("label", "vec_id", F.col("sample_pos").cast("long").alias("sample_pos"))


SQL_SAMPLE_LANDMARKS = f"""
SELECT label, vec_id, sample_pos FROM
 (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '{SEED}', vec_id)), vec_id) - 1 AS sample_pos
  FROM embeddings) WHERE sample_pos < 5"""


def q_random_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """F3 (whole table): seeded position of every lineitem row."""
    li = TB.table(spark, sf, "lineitem").select(*KEYS)
    return S.random_permutation(li, SEED, KEYS)


SQL_RANDOM_PERMUTATION = f"""
SELECT {KEYS_SQL}, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', {KEYS_SQL})), {KEYS_SQL}) - 1 AS perm_pos
FROM lineitem"""


def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    """F5 + F7: exact seeded 80/20 split of lineitem (train = first
    floor(0.8 N) of the permutation, test = the complement)."""
    li = TB.table(spark, sf, "lineitem").select(*KEYS)
    train = S.in_first(li, SEED, KEYS, fraction=SPLIT)
    return li.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


SQL_TRAIN_TEST_SPLIT = f"""
SELECT {KEYS_SQL}, CASE WHEN rn <= floor(n * {SPLIT!r}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM
 (SELECT {KEYS_SQL}, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', {KEYS_SQL})), {KEYS_SQL}) AS rn,
         count(*) OVER () AS n FROM lineitem)"""


# ============================================================ D. linear algebra

def q_gram_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Gram matrix of the scaled lineitem columns + bias, upper triangle."""
    rows = RW.add_bias(TB.lineitem_rows(spark, sf, keep_keys=False))
    return L.gram(rows, "features", 5).select("i", "j", rnd("value", 4).alias("value"))


def _sql_gram(cols: list[str], k: int = 4) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            parts.append(f"SELECT {i} AS i, {j} AS j, round(sum({a} * {cols[j]}), {k}) + 0.0 AS value FROM r")
    return " UNION ALL ".join(parts)


SQL_GRAM_LINEITEM = f"""
WITH r AS (SELECT *, 1.0::DOUBLE AS f_bias FROM ({SQL_ROWS}))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, value FROM ({_sql_gram(FEAT_NAMES + ['f_bias'])})"""


def q_gram_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """D1 (array form): 64 x 64 Gram matrix of the embeddings by numpy
    partials per partition, summed by cell."""
    e = embeddings(spark, sf)
    return L.gram(e, "features", EMB_DIM, method="arrow").select(
        "i", "j", rnd("value", 6).alias("value"))


SQL_GRAM_EMBEDDINGS = """
WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * b.x), 6) + 0.0 AS value
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY a.j, b.j"""


def _cells_df(spark, M, k=6, upper=True) -> DataFrame:
    d = M.shape[0]
    rows = [(i, j, float(M[i, j])) for i in range(d) for j in range(d) if (j >= i or not upper)]
    return spark.createDataFrame(rows, "i int, j int, value double").select(
        "i", "j", rnd("value", k).alias("value"))


def _li5(spark, sf, keep_keys: bool = False):
    return RW.add_bias(TB.lineitem_rows(spark, sf, keep_keys=keep_keys))


F5 = [*FEAT_NAMES, "f_bias"]
SQL_R5 = ",\n".join([Q.cte("r", f"SELECT *, 1.0::DOUBLE AS f_bias FROM ({SQL_ROWS})"), Q.gram("g", "r", F5), *Q.cholesky("ch", "g", D5)])


def q_tsqr_r(spark: SparkSession, sf: str) -> DataFrame:
    """R of the tall-skinny QR of all columns and the bias (per-partition
    running QR + reduction tree), canonical positive diagonal."""
    return _cells_df(spark, L.tsqr_r(_li5(spark, sf), "features", D5), 4)


SQL_TSQR_R = f"WITH {SQL_R5}\nSELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 4) + 0.0 AS value FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, r_{i}_{j} AS value FROM ch" for i in range(D5) for j in range(i, D5)) + ")"


def q_apply_qt(spark: SparkSession, sf: str) -> DataFrame:
    """Q^T x for x = the label column, Q = A R^-1 implicit; returns the
    coordinates and the squared norms of x and of the residual."""
    rows = _li5(spark, sf).withColumn("x", F.col("label"))
    R = L.tsqr_r(rows, "features", D5)
    qt = L.apply_qt(rows, R, "features", "x", keep=("x",))
    return qt.residual.agg(
        F.sum(F.col("residual") * F.col("residual")).alias("rsq"),
        F.sum(F.col("x") * F.col("x")).alias("xsq")).select(
        *[rnd(F.lit(float(c)), 4).alias(f"c_{j}") for j, c in enumerate(qt.c)],
        rnd("rsq", 3).alias("residual_sq"), rnd("xsq", 3).alias("x_sq"))


SQL_B5 = "SELECT " + ", ".join(f"sum({c} * label) AS b_{j}" for j, c in enumerate(F5)) + ", sum(label * label) AS xsq FROM r"
SQL_Z5 = ",\n".join([SQL_R5, Q.cte("b", SQL_B5), *Q.solve("z", "ch", "b", D5)])
SQL_FIT5 = Q.dot(F5, [f"z_{j}" for j in range(D5)])
SQL_APPLY_QT = f"""
WITH {SQL_Z5}
SELECT {', '.join(f'round(c_{j}, 4) + 0.0 AS c_{j}' for j in range(D5))},
       round((SELECT sum(pow(label - {SQL_FIT5}, 2)) FROM r, z), 3) + 0.0 AS residual_sq, round(xsq, 3) + 0.0 AS x_sq
FROM z"""


def q_apply_q(spark: SparkSession, sf: str) -> DataFrame:
    """Q c for c = Q^T label on every row (the projection of the label on
    the columns), per row; without the residual nothing else can cancel."""
    rows = _li5(spark, sf, keep_keys=True).withColumn("x", F.col("label"))
    R = L.tsqr_r(rows, "features", D5)
    c = L.apply_qt(rows, R, "features", "x", keep=("x",)).c
    q = L.apply_q(rows, R, c, "features", None, "qc", keep=tuple(KEYS))
    return q.select(*KEYS, rnd("qc", 5).alias("qc"))


SQL_APPLY_Q = f"WITH {SQL_Z5}\nSELECT {KEYS_SQL}, round({SQL_FIT5}, 5) + 0.0 AS qc FROM r, z"


def q_truncated_svd_values(spark: SparkSession, sf: str) -> DataFrame:
    """Singular values of all columns and the bias through the three
    symmetric functions that SQL knows from G and R: sum s^2 = trace G,
    sum s^4 = |G|_F^2, prod s = prod diag R (scaled by the row count)."""
    rows = _li5(spark, sf)
    sv = L.truncated_svd(rows, col="features", compute_u=False).s
    n = rows.count()
    out = (len(sv), float((sv ** 2).sum() / n), float((sv ** 4).sum() / n ** 2), float((sv / n ** 0.5).prod()), bool((sv[:-1] >= sv[1:]).all()))
    return spark.createDataFrame([out], "n_values int, sum_s2 double, sum_s4 double, prod_s double, descending boolean").select(
        "n_values", *[rnd(c).alias(c) for c in ("sum_s2", "sum_s4", "prod_s")], "descending")


SQL_TRUNCATED_SVD_VALUES = f"""
WITH {SQL_R5}, n AS (SELECT count(*)::DOUBLE AS n FROM r)
SELECT CAST({D5} AS INTEGER) AS n_values, round(({' + '.join(f'g_{i}_{i}' for i in range(D5))}) / n, 6) + 0.0 AS sum_s2,
       round(({' + '.join((f'g_{i}_{j} * g_{i}_{j}' if i == j else f'2.0::DOUBLE * g_{i}_{j} * g_{i}_{j}') for i in range(D5) for j in range(i, D5))}) / (n * n), 6) + 0.0 AS sum_s4,
       round({' * '.join(f'(r_{i}_{i} / sqrt(n))' for i in range(D5))}, 6) + 0.0 AS prod_s, true AS descending
FROM ch, n"""


def _off_rows(df: DataFrame, rebuilt) -> float:
    """Rows whose rebuilt vector differs from the original by over 1e-9."""
    d = F.aggregate(F.zip_with("features", rebuilt, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, v: F.greatest(m, v))
    return float(df.agg(F.count_if(~(d <= F.lit(1e-9)))).first()[0])


def _orthogonal(spark, G, n_off: float) -> DataFrame:
    return _cells_df(spark, G, 6).unionByName(spark.createDataFrame([(-1, -1, n_off)], "i int, j int, value double"))


def q_svd_u_gram(spark: SparkSession, sf: str) -> DataFrame:
    """D7 (U rows) on whole embeddings: the cells of U^T U, and at (-1, -1)
    the number of rows that U S V^T does not rebuild."""
    e = embeddings(spark, sf)
    svd = L.truncated_svd(e, col="features", keep=("vec_id", "features"))
    back = L.project_rows(svd.U, "u", (svd.V * svd.s).T, "back", ("vec_id", "features"))
    return _orthogonal(spark, L.gram_matrix(svd.U, "u", len(svd.s)), _off_rows(back, "back"))


SQL_ORTHOGONAL = """
WITH d AS (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM d a, d b WHERE b.i >= a.i UNION ALL SELECT -1, -1, 0.0::DOUBLE"""


def q_thin_q_gram(spark: SparkSession, sf: str) -> DataFrame:
    """D4 on whole embeddings: the cells of Q^T Q for the explicit thin
    Q = A R^-1, and at (-1, -1) the number of rows that Q R does not
    rebuild."""
    e = embeddings(spark, sf)
    Q_, R = L.thin_q(e, L.tsqr_r(e, "features", EMB_DIM), "features", "q", keep=("vec_id", "features"))
    back = L.project_rows(Q_, "q", R, "back", ("vec_id", "features"))
    return _orthogonal(spark, L.gram_matrix(Q_, "q", EMB_DIM), _off_rows(back, "back"))


def q_matrix_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Element-wise sum of all embedding vectors."""
    s = A.sum_arrays(embeddings(spark, sf), "features", EMB_DIM)
    return s.select("pos", rnd("value").alias("value"))


SQL_MATRIX_SUM = """
SELECT CAST(pos AS INTEGER) AS pos, round(sum(x), 6) + 0.0 AS value FROM
 (SELECT unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
GROUP BY pos"""


def q_norms(spark: SparkSession, sf: str) -> DataFrame:
    """D11 + B11: L2 and L1 norm of every embedding, and the L2 norm of its
    slice [8, 24)."""
    e = RW.slice_features(embeddings(spark, sf), 8, 24, out="part")
    return e.select("vec_id", rnd(V.norm_l2("features")).alias("l2"),
                    rnd(V.norm_l1("features")).alias("l1"), rnd(V.norm_l2("part")).alias("l2_slice"))


SQL_NORMS = """
SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))), 6) + 0.0 AS l2,
       round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))), 6) + 0.0 AS l1,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[])[9:24], lambda v: v * v))), 6) + 0.0 AS l2_slice
FROM embeddings"""


def q_rmatvec(spark: SparkSession, sf: str) -> DataFrame:
    """D10 + D11: A^T y on the scaled lineitem columns + bias; at j = -1 the
    L1 norm of y, at -2 the Frobenius norm of A, at -3 the sum of squares of
    A w for w = (1, .., 5)."""
    rows = RW.add_bias(TB.lineitem_rows(spark, sf, keep_keys=False))
    v = L.rmatvec(rows, "features", "label", 5)
    l1 = L.l1_norm(rows, "label").first()["l1"]
    fro = L.frobenius_norm(rows).first()["frobenius"]
    aw = L.matvec(rows, range(1, D5 + 1)).agg(F.sum(F.col("y") * F.col("y"))).first()[0]
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(v)] + [(-1, float(l1)), (-2, float(fro)), (-3, float(aw))],
                                 "j int, value double").select("j", rnd("value", 3).alias("value"))


SQL_RMATVEC = f"""
WITH r AS ({SQL_ROWS})
SELECT CAST(j AS INTEGER) AS j, round(value, 3) + 0.0 AS value FROM (
 SELECT 0 AS j, sum(f_quantity * label) AS value FROM r UNION ALL
 SELECT 1, sum(f_extendedprice * label) FROM r UNION ALL
 SELECT 2, sum(f_discount * label) FROM r UNION ALL
 SELECT 3, sum(f_tax * label) FROM r UNION ALL
 SELECT 4, sum(label) FROM r UNION ALL
 SELECT -1, sum(abs(label)) FROM r UNION ALL
 SELECT -2, sqrt(sum(f_quantity * f_quantity + f_extendedprice * f_extendedprice + f_discount * f_discount + f_tax * f_tax + 1.0::DOUBLE)) FROM r UNION ALL
 SELECT -3, sum(pow(f_quantity + 2 * f_extendedprice + 3 * f_discount + 4 * f_tax + 5, 2)) FROM r)"""


# ============================================================ G. SVM

# rows of the twins: signed columns a_0.. with the bias last, and an id
SQL_SIGNED5 = f"SELECT l_orderkey AS id, " + ", ".join(f"label * {c} AS a_{j}" for j, c in enumerate(FEAT_NAMES)) + f", label AS a_4 FROM ({SQL_ROWS})"
SQL_SIGNED_DOCS = f"SELECT row_id AS id, label * f_chars AS a_0, label * f_words AS a_1, label AS a_2 FROM ({SQL_DOC_ROWS})"
#: The step of the multiplier for C = 1 and learn rate 0.2, by hand: (floor(1 / 0.2) - 0.5) * 0.2.
STEP = 0.9


def _iterations(m) -> DataFrame:
    """(iteration, error, w_0..) of a fit."""
    out = [(it, err, *w) for (it, err), w in zip(m.history_rows, m.weights_path)]
    d = len(m.weights)
    return m.history.sparkSession.createDataFrame(out, "iteration int, error double, " + ", ".join(f"w_{j} double" for j in range(d))).select(
        "iteration", rnd("error", 4).alias("error"), *[rnd(f"w_{j}", 5).alias(f"w_{j}") for j in range(d)])


def _sql_iterations(rows: str, d: int, k: int) -> str:
    sel = " UNION ALL ".join(f"SELECT iteration, error, {', '.join(f'z_{j} AS w_{j}' for j in range(d))} FROM e{t}, v{t}" for t in range(1, k + 1))
    return ("WITH " + ",\n".join([Q.cte("rows_", rows), *Q.dual_ascent("rows_", d, C, STEP, k)])
            + f"\nSELECT CAST(iteration AS INTEGER) AS iteration, round(error, 4) + 0.0 AS error, "
            + ", ".join(f"round(w_{j}, 5) + 0.0 AS w_{j}" for j in range(d)) + f" FROM ({sel})")


def q_svm_fixed_iterations(spark: SparkSession, sf: str) -> DataFrame:
    """G1-G6 + E6: three dual-ascent iterations on lineitem (all scaled
    columns + bias, label charge): the L1 change of beta and w after each."""
    rows = TB.lineitem_rows(spark, sf, keep_keys=False)
    return _iterations(SVM.fit_svm(rows, C=C, learn_rate=LEARN_RATE, max_iter=3, tol=0.0, num_partitions=spread(spark)))


def q_svm_newton(spark: SparkSession, sf: str) -> DataFrame:
    """G6 (solver='newton'): optimum of the primal twin on the 4 scaled
    lineitem columns + bias; weights and hold-out confusion."""
    rows = TB.lineitem_rows(spark, sf)
    train, test = S.train_test_split(rows, SPLIT, SEED, KEYS)
    m = SVM.fit_svm(train, C=C, solver="newton", max_iter=50, tol=1e-9, num_partitions=spread(spark))
    return SVM.evaluate(test, m.weights).select(
        *[F.lit(round(w, 3) + 0.0).alias(f"w_{j}") for j, w in enumerate(m.weights)],
        F.lit(m.converged).alias("converged"), "correct", "wrong", "accuracy")


NEWTON_PASSES = 30
SQL_SVM_NEWTON = "WITH " + ",\n".join([
    Q.cte("p", f"SELECT *, rn <= floor(n * {SPLIT!r}::DOUBLE) AS train FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', {KEYS_SQL})), {KEYS_SQL}) AS rn, "
               f"count(*) OVER () AS n FROM ({SQL_ROWS}))"),
    Q.cte("rows_", "SELECT " + ", ".join(f"label * {c} AS a_{j}" for j, c in enumerate(FEAT_NAMES)) + ", label AS a_4 FROM p WHERE train"),
    *Q.newton("rows_", D5, C, NEWTON_PASSES),
    Q.cte("o", f"SELECT label * ({Q.dot(FEAT_NAMES, [f'w_{j}' for j in range(4)])} + w_4) > 0 OR (label < 0 AND {Q.dot(FEAT_NAMES, [f'w_{j}' for j in range(4)])} + w_4 = 0) AS ok "
               f"FROM p, n{NEWTON_PASSES} WHERE NOT train")]) + f"""
SELECT {', '.join(f'round(w_{j}, 3) + 0.0 AS w_{j}' for j in range(D5))}, true AS converged, CAST(count_if(ok) AS BIGINT) AS correct,
       CAST(count_if(NOT ok) AS BIGINT) AS wrong, 100.0::DOUBLE * count_if(ok) / count(*) AS accuracy
FROM o, n{NEWTON_PASSES} GROUP BY ALL"""


def q_svm_fit_documents(spark: SparkSession, sf: str) -> DataFrame:
    """G6 + A9 on documents' quality by log1p characters and words: the first
    five dual-ascent iterations."""
    return _iterations(SVM.fit_svm(TB.document_rows(spark, sf), C=C, learn_rate=LEARN_RATE, max_iter=5, tol=0.0))


def q_svm_converged(spark: SparkSession, sf: str) -> DataFrame:
    """G6 + A9/A10 + E6: dual ascent run until it converges; the history is
    complete, falls at the end below the tolerance, and w meets the Newton
    optimum of SQL."""
    m = SVM.fit_svm(TB.document_rows(spark, sf), C=C, learn_rate=LEARN_RATE, max_iter=500, tol=1e-6)
    its = [it for it, _ in m.history_rows]
    return spark.createDataFrame([(m.converged, its == list(range(1, m.iterations + 1)), m.history_rows[-1][1] < 1e-6, *map(float, m.weights))],
                                 "converged boolean, complete boolean, below_tolerance boolean, w_0 double, w_1 double, w_2 double").select(
        "converged", "complete", "below_tolerance", *[rnd(f"w_{j}", 3).alias(f"w_{j}") for j in range(3)])


SQL_SVM_CONVERGED = "WITH " + ",\n".join([Q.cte("rows_", SQL_SIGNED_DOCS), *Q.newton("rows_", 3, C, NEWTON_PASSES)]) + f"""
SELECT true AS converged, true AS complete, true AS below_tolerance, {', '.join(f'round(w_{j}, 3) + 0.0 AS w_{j}' for j in range(3))} FROM n{NEWTON_PASSES}"""


def q_svm_fit_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """G2-G6 on all 64 embedding dims + bias (class 0 = +1), the wide-design
    path: after one iteration w solves M w = u with u = 2 A^T e; M w is
    rebuilt from a Gram matrix of its own and compared with SQL's u."""
    rows = TB.embedding_rows(spark, sf).drop("class_label")
    m = SVM.fit_svm(rows, C=C, learn_rate=LEARN_RATE, max_iter=1, tol=0.0)
    G = L.gram_matrix(RW.sign_rows(RW.add_bias(rows)), "features", EMB_DIM + 1)
    u = (G + np.eye(EMB_DIM + 1) / (2.0 * C)) @ m.weights
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(u)], "j int, u double").select("j", rnd("u", 5).alias("u"))


SQL_SVM_FIT_EMBEDDINGS = """
WITH e AS (SELECT CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT y, unnest(range(len(x) + 1)) AS j, unnest(list_append(x, 1.0::DOUBLE)) AS v FROM e)
SELECT CAST(j AS INTEGER) AS j, round(sum(2.0::DOUBLE * y * v), 5) + 0.0 AS u FROM c GROUP BY j"""


def q_kkt_report(spark: SparkSession, sf: str) -> DataFrame:
    """G9 + G7: after five dual-ascent iterations on documents' quality the
    KKT gap, smallest beta and support count, and w = A^T alpha rebuilt from
    the dual values."""
    rows = TB.document_rows(spark, sf)
    m = SVM.fit_svm(rows, C=C, learn_rate=LEARN_RATE, max_iter=5, tol=0.0)
    w = SVM.weights_from_alpha(rows.join(m.state.select("row_id", "alpha"), "row_id"))
    return SVM.kkt_report(m.state, rows, m.weights, C).select(
        rnd("max_alpha_gap", 5).alias("max_alpha_gap"), rnd("min_beta", 5).alias("min_beta"), "n_support",
        *[rnd(F.lit(float(x)), 5).alias(f"w_{j}") for j, x in enumerate(w)])


SQL_KKT_REPORT = "WITH " + ",\n".join([Q.cte("rows_", SQL_SIGNED_DOCS), *Q.dual_ascent("rows_", 3, C, STEP, 5)]) + f"""
SELECT round(max(abs(alpha - {Q.lit(2 * C)} * greatest(1.0::DOUBLE - {Q.dot(['a_0', 'a_1', 'a_2'], ['z_0', 'z_1', 'z_2'])}, 0.0::DOUBLE))), 5) + 0.0 AS max_alpha_gap,
       round(min(beta), 5) + 0.0 AS min_beta, CAST(count_if(alpha > 0.001) AS BIGINT) AS n_support,
       {', '.join(f'round(sum(alpha * a_{j}), 5) + 0.0 AS w_{j}' for j in range(3))}
FROM s5, v5"""


def q_kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    """H1: k-means (k = 4, 10 Lloyd iterations from seeded rows) on the
    embeddings; cluster sizes and centers as cells (j = -1: the size)."""
    from ..operators import cluster as CL
    e = embeddings(spark, sf)
    centers = CL.kmeans_centers(e, K_MEANS, KMEANS_ITER, SEED, id_cols=("vec_id",))
    sizes = A.cluster_sizes(CL.assign_clusters(e, centers)).select("cluster", F.lit(-1).alias("j"), F.col("n").cast("double").alias("value"))
    cells = [(c, j, float(v)) for c, row in enumerate(centers) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "cluster int, j int, value double").select("cluster", "j", rnd("value").alias("value")).unionByName(sizes)


K_MEANS, KMEANS_ITER = 4, 10
SQL_KM = ",\n".join([Q.cte("emb", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"),
                     *Q.kmeans("emb", K_MEANS, SEED, KMEANS_ITER)])
SQL_KMEANS_FIT = f"""
WITH {SQL_KM}
SELECT cluster, CAST(j AS INTEGER) AS j, round(value, 6) + 0.0 AS value FROM (SELECT cluster, unnest(range(len(c))) AS j, unnest(c) AS value FROM km{KMEANS_ITER})
UNION ALL SELECT cluster, -1, count(*)::DOUBLE FROM ka{KMEANS_ITER} GROUP BY cluster"""


# ============================================================ H. MEKA

def q_nystrom_features(spark: SparkSession, sf: str) -> DataFrame:
    """H5 at rank 2 with two landmarks per cluster (nearest class centroid):
    the squared norm of every row's features is E W^-1 E^T."""
    from ..operators import nystrom as NY
    from ..operators import cluster as CL
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "row_id")
    assigned = CL.assign_clusters(e, centroid_matrix(spark, sf)).drop("sq_dist")
    ranks = A.rank_offsets(A.cluster_sizes(assigned).withColumn("rank", F.lit(2)), "cluster", "rank", "col_offset")
    feats = NY.nystrom_features(assigned, ranks, GAMMA, SEED, factor=1)
    return feats.select(F.col("row_id").alias("vec_id"), "cluster", F.size("u").alias("rank"),
                        rnd(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("phi_sq"))


def q_nystrom_rank1(spark: SparkSession, sf: str) -> DataFrame:
    """H5 with a closed form: clusters = nearest class centroid, rank 1 and
    m = 2 seeded landmarks per cluster; the squared feature of every row
    (sign-free) equals (e1 + e2)^2 / (2 (1 + w)) with e = K(x, L), w = K(L1, L2)."""
    from ..operators import nystrom as NY
    from ..operators import cluster as CL
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "row_id")
    assigned = CL.assign_clusters(e, centroid_matrix(spark, sf)).drop("sq_dist")
    ranks = A.rank_offsets(A.cluster_sizes(assigned).withColumn("rank", F.lit(1)),
                           "cluster", "rank", "col_offset")
    feats = NY.nystrom_features(assigned, ranks, GAMMA, SEED)
    return feats.select(F.col("row_id").alias("vec_id"), "cluster",
                        rnd(F.col("u")[0] * F.col("u")[0]).alias("phi_sq"))


SQL_NYSTROM_RANK1 = f"""
WITH {SQL_CENTROIDS}, {SQL_ASSIGN},
lm AS (SELECT cluster, x, row_number() OVER (PARTITION BY cluster ORDER BY md5(concat_ws(':', '{SEED}', vec_id)), vec_id) AS rn
       FROM a JOIN emb USING (vec_id)),
l2 AS (SELECT l1.cluster, l1.x AS p, l2.x AS q FROM lm l1 JOIN lm l2 ON l1.cluster = l2.cluster AND l1.rn = 1 AND l2.rn = 2),
k AS (SELECT a.vec_id, a.cluster,
             exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(emb.x, l2.p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS e1,
             exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(emb.x, l2.q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS e2,
             exp(-{GAMMA!r}::DOUBLE * list_sum(list_transform(list_zip(l2.p, l2.q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS w
      FROM a JOIN emb USING (vec_id) JOIN l2 ON a.cluster = l2.cluster)
SELECT vec_id, cluster, round((e1 + e2) * (e1 + e2) / (2.0::DOUBLE * (1.0::DOUBLE + w)), 6) + 0.0 AS phi_sq FROM k"""


# two landmarks per cluster: E W^-1 E^T with W = [[1, w], [w, 1]]
SQL_NYSTROM_FEATURES = SQL_NYSTROM_RANK1[:SQL_NYSTROM_RANK1.rindex("SELECT vec_id, cluster")] + """
SELECT vec_id, cluster, CAST(2 AS INTEGER) AS rank, round((e1 * e1 - 2.0::DOUBLE * w * e1 * e2 + e2 * e2) / (1.0::DOUBLE - w * w), 6) + 0.0 AS phi_sq FROM k"""


def _meka(spark, sf):
    from ..plans import meka as MK
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "row_id")
    return e, MK.meka_features(e, n_clusters=K_MEANS, target_rank=TARGET_RANK, gamma=GAMMA, eta=ETA,
                               seed=SEED, link_power=0.5, kmeans_iter=KMEANS_ITER)


#: Bound on the mean kernel error of the pair sample at rank 20 and gamma 1 on the embeddings.
MEKA_ERROR = 0.1


def q_meka_features(spark: SparkSession, sf: str) -> DataFrame:
    """H4-H8 + H10: per cluster the size, rank and column offset of the MEKA
    map (link power +0.5); whether its rows are as wide as the target rank,
    the link matrix is symmetric with identity blocks on its diagonal and
    exactly the linked pairs' blocks besides, and the kernel error on a
    seeded pair sample stays within bound."""
    from ..operators import cluster as CL
    from ..plans import meka as MK
    e, mk = _meka(spark, sf)
    err = MK.approximation_error(mk, e, GAMMA, SEED, n_pairs=2000).first()["mean_abs_error"]
    ranks = {r["cluster"]: (r["col_offset"], r["rank"]) for r in mk.ranks.collect()}
    pairs = set(CL.linked_pairs(mk.centers, GAMMA, ETA))

    def block(i, j):
        (a, m), (b, n) = ranks[i], ranks[j]
        return mk.link[a:a + m, b:b + n]
    ok = bool(np.allclose(mk.link, mk.link.T)) and all(np.allclose(block(i, i), np.eye(ranks[i][1])) for i in ranks) and all(
        bool(np.abs(block(i, j)).max() > 0) == ((i, j) in pairs) for i in ranks for j in ranks if i < j)
    rows = mk.features.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size("features")).alias("width"),
                                              F.count_if(F.exists("features", F.isnan)).alias("n_nan"))
    return rows.join(mk.ranks, "cluster").select(
        "cluster", F.col("n_rows").alias("n"), "rank", "col_offset", "width", "n_nan",
        F.lit(ok).alias("link_ok"), F.lit(bool(err is not None and err <= MEKA_ERROR)).alias("error_ok"))


# clusters renumbered by size, then rank rule and offsets
SQL_MEKA_RANKS = f"""sz AS (SELECT CAST(row_number() OVER (ORDER BY count(*), cluster) - 1 AS INTEGER) AS cluster, count(*) AS n FROM ka{KMEANS_ITER} GROUP BY ka{KMEANS_ITER}.cluster),
r0 AS (SELECT cluster, n, CAST(ceil({TARGET_RANK} * n / (sum(n) OVER ())::DOUBLE) AS INTEGER) AS r, max(cluster) OVER () AS last FROM sz),
r1 AS (SELECT cluster, n, CASE WHEN cluster = last THEN r - (sum(r) OVER () - {TARGET_RANK}) ELSE r END AS r FROM r0),
r2 AS (SELECT cluster, n, CAST(least(r, n) AS INTEGER) AS rank FROM r1)"""
SQL_MEKA_FEATURES = f"""
WITH {SQL_KM}, {SQL_MEKA_RANKS}
SELECT cluster, n, rank, CAST(coalesce(sum(rank) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col_offset,
       CAST((sum(rank) OVER ()) AS INTEGER) AS width, CAST(0 AS BIGINT) AS n_nan, true AS link_ok, true AS error_ok
FROM r2"""


def q_meka_svm(spark: SparkSession, sf: str) -> DataFrame:
    """H9 -> G6: MEKA data set of the embeddings (class 0 vs rest), seeded
    80/20 split, SVM on the train rows: sizes of both sides, class counts of
    the train side, width, and whether the hold-out confusion covers the test
    side and the trained model is at its optimum."""
    from ..plans import meka as MK
    rows = TB.embedding_rows(spark, sf)
    ds = MK.meka_dataset(rows, n_clusters=K_MEANS, target_rank=TARGET_RANK, gamma=GAMMA, eta=ETA,
                         split=SPLIT, seed=SEED, link_power=0.5, kmeans_iter=KMEANS_ITER)
    train = ds.train.cache()
    m = SVM.fit_svm(train, C=C, solver="newton", max_iter=50, tol=1e-9)
    gap = SVM.kkt_report(m.state, train, m.weights, C).first()["max_alpha_gap"]
    conf = SVM.evaluate(ds.test, m.weights).first()
    got = train.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0), F.max(F.size("features"))).first()
    train.unpersist()
    n_test = conf["correct"] + conf["wrong"]
    return spark.createDataFrame([(got[0], got[1], n_test, got[2], conf["correct_pos"] + conf["wrong_neg"] + conf["correct_neg"] + conf["wrong_pos"] == n_test,
                                   bool(m.converged and gap < 1e-6))],
                                 "n_train long, n_train_pos long, n_test long, width int, confusion_ok boolean, optimal boolean")


SQL_MEKA_SVM = f"""
WITH {SQL_KM}, {SQL_MEKA_RANKS},
p AS (SELECT label, rn <= floor(n * {SPLIT!r}::DOUBLE) AS train FROM
      (SELECT label, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', vec_id)), vec_id) AS rn, count(*) OVER () AS n FROM embeddings))
SELECT CAST(count_if(train) AS BIGINT) AS n_train, CAST(count_if(train AND label = 0) AS BIGINT) AS n_train_pos, CAST(count_if(NOT train) AS BIGINT) AS n_test,
       CAST((SELECT sum(rank) FROM r2) AS INTEGER) AS width, true AS confusion_ok, true AS optimal FROM p"""


QUERIES = {
    "parse_rows": q_parse_rows,
    "row_positions": q_row_positions,
    "head_rows": q_head_rows,
    "count_check": q_count_check,
    "labeled_lines": q_labeled_lines,
    "label_lines": q_label_lines,
    "gather_rows": q_gather_rows,
    "kth_smallest": q_kth_smallest,
    "svm_converged": q_svm_converged,
    "signed_rows": q_signed_rows,
    "document_rows": q_document_rows,
    "scale_rows": q_scale_rows,
    "block_features": q_block_features,
    "elementwise": q_elementwise,
    "scoring": q_scoring,
    "support_vectors": q_support_vectors,
    "bias_from_support": q_bias_from_support,
    "gather_ids": q_gather_ids,
    "positional_zip": q_positional_zip,
    "point_center_distance": q_point_center_distance,
    "assign_clusters": q_assign_clusters,
    "cluster_sizes": q_cluster_sizes,
    "lloyd_step": q_lloyd_step,
    "lloyd_two_steps": q_lloyd_two_steps,
    "rbf_kernel": q_rbf_kernel,
    "pairwise_sq_distance": q_pairwise_sq_distance,
    "link_threshold": q_link_threshold,
    "cluster_pairs": q_cluster_pairs,
    "rank_allocation": q_rank_allocation,
    "sample_landmarks": q_sample_landmarks,
    "random_permutation": q_random_permutation,
    "train_test_split": q_train_test_split,
    "gram_lineitem": q_gram_lineitem,
    "gram_embeddings": q_gram_embeddings,
    "tsqr_r": q_tsqr_r,
    "apply_qt": q_apply_qt,
    "apply_q": q_apply_q,
    "truncated_svd_values": q_truncated_svd_values,
    "svd_u_gram": q_svd_u_gram,
    "thin_q_gram": q_thin_q_gram,
    "matrix_sum": q_matrix_sum,
    "norms": q_norms,
    "rmatvec": q_rmatvec,
    "svm_fixed_iterations": q_svm_fixed_iterations,
    "svm_newton": q_svm_newton,
    "svm_fit_documents": q_svm_fit_documents,
    "svm_fit_embeddings": q_svm_fit_embeddings,
    "kkt_report": q_kkt_report,
    "kmeans_fit": q_kmeans_fit,
    "nystrom_features": q_nystrom_features,
    "nystrom_rank1": q_nystrom_rank1,
    "meka_features": q_meka_features,
    "meka_svm": q_meka_svm,
}

ORACLE_SQL = {
    "parse_rows": SQL_PARSE_ROWS,
    "row_positions": SQL_ROW_POSITIONS,
    "head_rows": SQL_HEAD_ROWS,
    "count_check": SQL_COUNT_CHECK,
    "labeled_lines": SQL_LABELED_LINES,
    "label_lines": SQL_LABEL_LINES,
    "gather_rows": SQL_GATHER_ROWS,
    "kth_smallest": SQL_KTH_SMALLEST,
    "svm_converged": SQL_SVM_CONVERGED,
    "svm_newton": SQL_SVM_NEWTON,
    "svm_fit_documents": _sql_iterations(SQL_SIGNED_DOCS, 3, 5),
    "svm_fit_embeddings": SQL_SVM_FIT_EMBEDDINGS,
    "kkt_report": SQL_KKT_REPORT,
    "kmeans_fit": SQL_KMEANS_FIT,
    "nystrom_features": SQL_NYSTROM_FEATURES,
    "meka_features": SQL_MEKA_FEATURES,
    "meka_svm": SQL_MEKA_SVM,
    "signed_rows": SQL_SIGNED_ROWS,
    "document_rows": SQL_DOCUMENT_ROWS,
    "scale_rows": SQL_SCALE_ROWS,
    "block_features": SQL_BLOCK_FEATURES,
    "elementwise": SQL_ELEMENTWISE,
    "scoring": SQL_SCORING,
    "support_vectors": SQL_SUPPORT_VECTORS,
    "bias_from_support": SQL_BIAS_FROM_SUPPORT,
    "gather_ids": SQL_GATHER_IDS,
    "positional_zip": SQL_POSITIONAL_ZIP,
    "point_center_distance": SQL_POINT_CENTER_DISTANCE,
    "assign_clusters": SQL_ASSIGN_CLUSTERS,
    "cluster_sizes": SQL_CLUSTER_SIZES,
    "lloyd_step": SQL_LLOYD_STEP,
    "lloyd_two_steps": SQL_LLOYD_TWO_STEPS,
    "rbf_kernel": SQL_RBF_KERNEL,
    "pairwise_sq_distance": SQL_PAIRWISE_SQ_DISTANCE,
    "link_threshold": SQL_LINK_THRESHOLD,
    "cluster_pairs": SQL_CLUSTER_PAIRS,
    "rank_allocation": SQL_RANK_ALLOCATION,
    "sample_landmarks": SQL_SAMPLE_LANDMARKS,
    "random_permutation": SQL_RANDOM_PERMUTATION,
    "train_test_split": SQL_TRAIN_TEST_SPLIT,
    "gram_lineitem": SQL_GRAM_LINEITEM,
    "gram_embeddings": SQL_GRAM_EMBEDDINGS,
    "tsqr_r": SQL_TSQR_R,
    "apply_qt": SQL_APPLY_QT,
    "apply_q": SQL_APPLY_Q,
    "truncated_svd_values": SQL_TRUNCATED_SVD_VALUES,
    "svd_u_gram": SQL_ORTHOGONAL,
    "thin_q_gram": SQL_ORTHOGONAL,
    "matrix_sum": SQL_MATRIX_SUM,
    "norms": SQL_NORMS,
    "rmatvec": SQL_RMATVEC,
    "svm_fixed_iterations": _sql_iterations(SQL_SIGNED5, D5, 3),
    "nystrom_rank1": SQL_NYSTROM_RANK1,
}
