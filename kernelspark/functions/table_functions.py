"""Table functions that can be called from SQL on groups of rows.

    register_gram(spark, "gram_cells", "label int")
    SELECT * FROM gram_cells(TABLE(SELECT label, x FROM t) PARTITION BY label)

The argument table has the key columns first and the vectors (array<double>)
last. Rows of a group stream through as Arrow batches beside one d x d block,
so groups of any size fit. A hot group is spread by another key column, a
salt: its cells are added by SUM, its R factors by calling ``r_rows`` again.
Arrow table functions take no schema from their argument, so it is computed
here, when a function is registered for given key columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def key_schema(keys: str | T.StructType) -> T.StructType:
    return keys if isinstance(keys, T.StructType) else T._parse_datatype_string(keys) if keys else T.StructType([])


def _handler(n_keys: int, take, give):
    """A handler class: ``take(state, X)`` adds a batch's rows, ``give(state)``
    yields the columns behind the keys."""
    class Handler:
        def __init__(self):
            self.state, self.keys = None, None

        def eval(self, batch: pa.RecordBatch):
            from kernelspark.operators.linalg import list_matrix
            if batch.num_rows:
                vectors = batch.column(n_keys)
                d = len(vectors[0]) if vectors[0].is_valid else 0
                self.keys = self.keys or batch.slice(0, 1).columns[:n_keys]
                self.state = take(self.state, list_matrix(vectors, d if self.state is None else self.state.shape[1], "the table"))
            return iter(())

        def terminate(self):
            if self.state is not None:
                columns = give(self.state)
                n = len(next(iter(columns.values())))
                keys = {f"k{i}": pa.concat_arrays([k] * n) for i, k in enumerate(self.keys)}
                yield pa.table({**keys, **columns})

    return Handler


def _register(spark: SparkSession, name: str, keys: str | T.StructType, out: list[tuple[str, T.DataType]], take, give) -> str:
    ship_package(spark)
    fields = key_schema(keys).fields
    schema = T.StructType([*fields, *[T.StructField(c, t) for c, t in out]])

    def named(state):
        return dict(zip([c for c, _ in out], give(state)))

    base = _handler(len(fields), take, named)
    names = schema.names

    class Handler(base):
        def terminate(self):
            for t in super().terminate():
                yield t.rename_columns(names)

    spark.udtf.register(name, F.arrow_udtf(Handler, returnType=schema))
    return name


def _add_gram(state, X):
    G = X.T @ X
    return G if state is None else state + G


def _gram_cells(G):
    i, j = np.triu_indices(len(G))
    return pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(G[i, j])


def _add_r(state, X):
    return np.linalg.qr(X if state is None else np.vstack([state, X]), mode="r")


def _r_rows(R):
    signs = np.where(np.diag(R) < 0, -1.0, 1.0)
    R = R * signs[:, None]
    return pa.array(range(len(R)), pa.int32()), pa.array(list(R), pa.list_(pa.float64()))


def register_gram(spark: SparkSession, name: str = "gram_cells", keys: str | T.StructType = "") -> str:
    """D1 per group, from SQL: the keys and the upper cells (i, j, value) of
    the group's Gram matrix. Null vectors and vectors of another width raise;
    a group without rows has no cells; null keys are one group."""
    return _register(spark, name, keys, [("i", T.IntegerType()), ("j", T.IntegerType()), ("value", T.DoubleType())], _add_gram, _gram_cells)


def register_r(spark: SparkSession, name: str = "r_rows", keys: str | T.StructType = "") -> str:
    """D2 per group, from SQL: the keys, the number and the rows of the
    group's R (canonical sign, at most d rows). Rows of R factors are rows of
    vectors again: the R of several R factors is the R of all their rows."""
    return _register(spark, name, keys, [("i", T.IntegerType()), ("row", T.ArrayType(T.DoubleType()))], _add_r, _r_rows)
