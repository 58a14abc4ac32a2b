"""DuckDB text for small dense linear algebra, generated for any width d.

Each helper returns the body of one or more ``name AS MATERIALIZED (...)``
entries of a WITH list; entries only read the ones named in their arguments.
"""

from __future__ import annotations

from collections.abc import Sequence


def lit(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


def gram(name: str, rows: str, cols: Sequence[str], ridge: float = 0.0, weight: str = "1.0::DOUBLE") -> str:
    """One row of sums g_i_j (i <= j) over ``rows``, ``ridge`` on the diagonal."""
    d = len(cols)
    cells = ", ".join(f"sum({weight} * {cols[i]} * {cols[j]})" + (f" + {lit(ridge)}" if ridge and i == j else "") + f" AS g_{i}_{j}"
                      for i in range(d) for j in range(i, d))
    return cte(name, f"SELECT {cells} FROM {rows}")


def cholesky(name: str, g: str, d: int) -> list[str]:
    """r_i_j of R with R^T R = G, a CTE per row of R; the last is ``name``."""
    out, src = [], g
    for i in range(d):
        def rest(j, i=i):
            return f"(g_{i}_{j}" + "".join(f" - r_{k}_{i} * r_{k}_{j}" for k in range(i)) + ")"
        here = f"{name}_{i}"
        out.append(cte(f"{here}a", f"SELECT *, sqrt({rest(i)}) AS r_{i}_{i} FROM {src}"))
        more = "".join(f", {rest(j)} / r_{i}_{i} AS r_{i}_{j}" for j in range(i + 1, d))
        src = name if i == d - 1 else here
        out.append(cte(src, f"SELECT *{more} FROM {here}a"))
    return out


def solve(name: str, r: str, b: str, d: int, forward: bool = True, back: bool = True) -> list[str]:
    """From R in ``r`` and b_0.. in ``b`` (one row each): c = R^-T b as
    c_0.., then z = R^-1 c as z_0..; columns of both inputs stay."""
    out, src = [cte(f"{name}_s", f"SELECT * FROM {r}, {b}")], f"{name}_s"
    if forward:
        for i in range(d):
            e = f"(b_{i}" + "".join(f" - r_{k}_{i} * c_{k}" for k in range(i)) + f") / r_{i}_{i}"
            here = name if i == d - 1 and not back else f"{name}_c{i}"
            out.append(cte(here, f"SELECT *, {e} AS c_{i} FROM {src}"))
            src = here
    if back:
        for i in reversed(range(d)):
            e = f"(c_{i}" + "".join(f" - r_{i}_{k} * z_{k}" for k in range(i + 1, d)) + f") / r_{i}_{i}"
            here = name if i == 0 else f"{name}_z{i}"
            out.append(cte(here, f"SELECT *, {e} AS z_{i} FROM {src}"))
            src = here
    return out


def dot(cols: Sequence[str], names: Sequence[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(cols, names)) + ")"


def dual_ascent(rows: str, d: int, c: float, step: float, iterations: int) -> list[str]:
    """The dual ascent on signed rows a_0..a_{d-1} (table ``rows``, with an
    id column ``id``): v{t} has w after iteration t as z_0.., s{t} the rows'
    beta and alpha, e{t} the L1 change of beta."""
    cols = [f"a_{j}" for j in range(d)]
    out = [gram("da_g", rows, cols, ridge=1.0 / (2.0 * c)), *cholesky("da_r", "da_g", d),
           cte("s0", f"SELECT *, 1.0::DOUBLE AS beta FROM {rows}")]
    keep = ", ".join(["id", *cols])
    for t in range(1, iterations + 1):
        u = ", ".join(f"sum({a} * (1.0::DOUBLE + beta)) AS b_{j}" for j, a in enumerate(cols))
        alpha = f"{lit(2.0 * c)} * ((1.0::DOUBLE + beta) - {dot(cols, [f'z_{j}' for j in range(d)])})"
        out += [cte(f"u{t}", f"SELECT {u} FROM s{t - 1}"), *solve(f"v{t}", "da_r", f"u{t}", d),
                cte(f"s{t}", f"SELECT {keep}, greatest(beta - {lit(step)} * alpha, 0.0::DOUBLE) AS beta, beta AS old, alpha "
                             f"FROM (SELECT {keep}, beta, {alpha} AS alpha FROM s{t - 1}, v{t})"),
                cte(f"e{t}", f"SELECT {t} AS iteration, sum(abs(beta - old)) AS error FROM s{t}")]
    return out


def newton(rows: str, d: int, c: float, passes: int) -> list[str]:
    """Full Newton steps on 1/2 |w|^2 + C sum max(0, 1 - a.w)^2 from w = 0;
    the last w is in n{passes} as w_0.."""
    cols, w = [f"a_{j}" for j in range(d)], [f"w_{j}" for j in range(d)]
    out = [cte("n0", "SELECT " + ", ".join(f"0.0::DOUBLE AS {x}" for x in w))]
    for t in range(1, passes + 1):
        margin = f"(1.0::DOUBLE - {dot(cols, w)})"
        active = f"(CASE WHEN {margin} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        # H w' = 2C sum over active rows of a, with H = I + 2C sum a a^T: the next w directly
        cells = ", ".join([f"{lit(2 * c)} * sum(on_ * {cols[i]} * {cols[j]})" + (" + 1.0::DOUBLE" if i == j else "") + f" AS g_{i}_{j}"
                           for i in range(d) for j in range(i, d)]
                          + [f"{lit(2 * c)} * sum(on_ * {cols[j]}) AS b_{j}" for j in range(d)])
        out.append(cte(f"m{t}", f"SELECT {cells} FROM (SELECT {', '.join(cols)}, {active} AS on_ FROM {rows}, n{t - 1})"))
        out += cholesky(f"mr{t}", f"m{t}", d)
        out += solve(f"mz{t}", f"mr{t}", "(SELECT 1 AS one_)", d)
        out.append(cte(f"n{t}", "SELECT " + ", ".join(f"z_{j} AS w_{j}" for j in range(d)) + f" FROM mz{t}"))
    return out


def kmeans(points: str, k: int, seed: int, iterations: int) -> list[str]:
    """Lloyd iterations on ``points`` (vec_id, x) from the first k vectors of
    the seeded md5 order; km{t} has (cluster, c) after t iterations."""
    out = [cte("km0", f"SELECT CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', vec_id)), vec_id) - 1 AS INTEGER) AS cluster, x AS c "
                      f"FROM {points} QUALIFY cluster < {k}")]
    for t in range(iterations + 1):
        out.append(cte(f"ka{t}", "SELECT vec_id, cluster FROM (SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY "
                                 "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster) AS rn "
                                 f"FROM {points}, km{t}) WHERE rn = 1"))
        if t < iterations:
            out.append(cte(f"km{t + 1}", "SELECT cluster, coalesce(m.c, km.c) AS c FROM "
                                         f"km{t} km LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS c FROM (SELECT cluster, j, avg(x) AS x FROM "
                                         f"(SELECT cluster, unnest(range(len(x))) AS j, unnest(x) AS x FROM ka{t} JOIN {points} USING (vec_id)) "
                                         "GROUP BY cluster, j) GROUP BY cluster) m USING (cluster)"))
    return out
