"""Column expressions over dense vectors stored as ``array<double>``.

Everything here returns a ``Column`` so Catalyst can fold, prune and push
around it. When the vector width ``d`` is known and small the expressions
are unrolled into plain arithmetic over ``col[j]`` - those stay inside
whole-stage codegen. Otherwise the higher-order functions ``zip_with`` /
``aggregate`` / ``transform`` are used (JVM side, interpreted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths up to this many entries are unrolled into codegen-friendly sums.
UNROLL_MAX = 128


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(x: float) -> Column:
    return F.lit(float(x))


def item(col, j: int) -> Column:
    """0-based element ``j`` of an array column."""
    return _c(col).getItem(j)


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def dbl(x: float) -> str:
    """A double literal in SQL text (plain ``0.1`` would be a DECIMAL)."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return f"double('{x}')"
    return f"({x!r}D)"


def _sum_sql(terms: Sequence[str]) -> str:
    terms = list(terms)
    if not terms:
        return "(0.0D)"
    while len(terms) > 1:
        nxt = [f"({terms[i]} + {terms[i + 1]})" for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def dot_const_sql(name: str, w: Sequence[float]) -> str:
    """SQL text of x . w for an array column ``name`` (unrolled)."""
    return _sum_sql([f"(get({q(name)}, {j}) * {dbl(v)})" for j, v in enumerate(w)])


def sqdist_const_sql(name: str, center: Sequence[float]) -> str:
    """SQL text of ||x - c||^2 for an array column ``name`` (unrolled)."""
    return _sum_sql([f"((get({q(name)}, {j}) - {dbl(v)}) * (get({q(name)}, {j}) - {dbl(v)}))"
                     for j, v in enumerate(center)])


def linear_sql(names: Sequence[str], w: Sequence[float]) -> str:
    """SQL text of sum_j names[j] * w[j] over separate columns."""
    return _sum_sql([f"({q(n)} * {dbl(v)})" for n, v in zip(names, w)])


def _sum(terms: Sequence[Column]) -> Column:
    # balanced tree: keeps the expression depth at log2(d)
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        nxt = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def of_width(col, d: int, value: Column) -> Column:
    """``value``, or an error where the vector is null or not of width d:
    one rule for the unrolled and the interpreted forms."""
    return F.when(F.coalesce(F.size(_c(col)), F.lit(-1)) == F.lit(d), value).otherwise(
        F.raise_error(F.lit(f"vector is not of width {d}")).cast("double"))


def dot_const(col, w: Sequence[float]) -> Column:
    """x . w for a column x and a literal vector w (the model); raises on
    rows of another width. Zero weights count: 0 * NaN is NaN."""
    w = [float(v) for v in w]
    if len(w) <= UNROLL_MAX:
        if isinstance(col, str):      # one JVM call for the whole expression
            value = F.expr(dot_const_sql(col, w))
        else:
            value = _sum([F.get(_c(col), j) * _lit(v) for j, v in enumerate(w)])
    else:
        lits = F.array(*[_lit(v) for v in w])
        value = F.aggregate(F.zip_with(_c(col), lits, lambda a, b: a * b), F.lit(0.0),
                            lambda acc, x: acc + x)
    return of_width(col, len(w), value)


def dot(a, b, d: int | None = None) -> Column:
    """a . b of two array columns (``d`` known -> unrolled)."""
    if d is not None and d <= UNROLL_MAX:
        return _sum([item(a, j) * item(b, j) for j in range(d)])
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def sqdist_const(col, center: Sequence[float], unroll: bool | None = None) -> Column:
    """||x - c||^2 against a literal center (``unroll`` None: by width);
    raises on rows of another width."""
    center = [float(v) for v in center]
    if unroll if unroll is not None else len(center) <= UNROLL_MAX:
        if isinstance(col, str):
            value = F.expr(sqdist_const_sql(col, center))
        else:
            value = _sum([(F.get(_c(col), j) - _lit(v)) * (F.get(_c(col), j) - _lit(v))
                          for j, v in enumerate(center)])
    else:
        lits = F.array(*[_lit(v) for v in center])
        value = F.aggregate(F.zip_with(_c(col), lits, lambda x, y: (x - y) * (x - y)),
                            F.lit(0.0), lambda acc, x: acc + x)
    return of_width(col, len(center), value)


def sqdist(a, b, d: int | None = None) -> Column:
    """||a - b||^2 of two array columns."""
    if d is not None and d <= UNROLL_MAX:
        return _sum([(item(a, j) - item(b, j)) * (item(a, j) - item(b, j))
                     for j in range(d)])
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def scale(col, s) -> Column:
    """Every entry times the scalar column/literal ``s``."""
    s = _c(s) if isinstance(s, (str, Column)) else _lit(s)
    return F.transform(_c(col), lambda x: x * s)


def with_bias(col) -> Column:
    """(x, 1): the bias entry appended last."""
    return F.concat(_c(col), F.array(F.lit(1.0)))


def elementwise_exp(col) -> Column:
    return F.transform(_c(col), lambda x: F.exp(x))


def elementwise_power(col, p: float) -> Column:
    """x^p on non-zero entries; exact zeros stay zero."""
    return F.transform(_c(col), lambda x: F.when(x != 0.0, F.pow(x, _lit(p))).otherwise(x))


def clip_negative(col) -> Column:
    """Projection on the non-negative orthant (scalar or array column)."""
    return F.transform(_c(col), lambda x: F.greatest(x, F.lit(0.0)))


def zero_small(col, tol: float = 1e-4) -> Column:
    """Entries with |x| < tol become 0."""
    return F.transform(_c(col), lambda x: F.when(F.abs(x) < _lit(tol), F.lit(0.0)).otherwise(x))


def norm_l2(col) -> Column:
    return F.sqrt(F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x * x))


def norm_l1(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + F.abs(x))


def slice0(col, start: int, stop: int) -> Column:
    """Entries [start, stop) (0-based, Python style)."""
    return F.slice(_c(col), start + 1, stop - start)


def argmin(col) -> Column:
    """0-based index of the smallest entry; ties go to the lowest index."""
    return F.array_min(F.transform(
        _c(col), lambda x, i: F.struct(x.alias("v"), i.alias("i")))).getField("i")


def linear_terms(cols: Sequence[Column], w: Sequence[float]) -> Column:
    """sum_j cols[j] * w[j] over separate columns."""
    return _sum([c * _lit(v) for c, v in zip(cols, w)])
