"""Polynomial and spline models: fits by triangular factors of the tasks' rows, evaluation as Columns or as a join by interval."""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PI, normal_lon

#: Tasks whose triangular factors one task puts together.
FANIN = 32
#: Rows that are factored at once.
TALL = 256
#: Knots of a spline that are written out in an expression, at most; knots to a block of the join beyond.
WRITTEN, BLOCK = 64, 64


def int_power(x: Column, n: int) -> Column:
    """x * x * ... with 0^0 = 1."""
    return reduce(lambda a, b: a * b, [x] * n, F.lit(1.0))


@dataclass(frozen=True)
class Polynomial:
    """Coefficients of x^i (1-D), or of x^i y^j: all with i, j up to the order (full) or with i + j up to it (triangular)."""

    dim: int
    order: int
    coefficients: tuple[float, ...]
    triangular: bool = False

    @staticmethod
    def exponents(dim: int, order: int, triangular: bool = False) -> list[tuple[int, int]]:
        if dim == 1:
            return [(i, 0) for i in range(order + 1)]
        return [(i, j) for i in range(order + 1) for j in range(order + 1 - (i if triangular else 0))]

    def evaluate(self, x, y=None):
        """Horner's scheme, for Columns and floats."""
        by_x: dict[int, list[float]] = {}
        for (i, _), c in zip(self.exponents(self.dim, self.order, self.triangular), self.coefficients, strict=True):
            by_x.setdefault(i, []).append(c)
        horner = lambda terms, v: reduce(lambda a, b: a * v + b, reversed(terms[:-1]), terms[-1])
        rows = [terms[0] if self.dim == 1 else horner(terms, y) for _, terms in sorted(by_x.items())]
        return horner(rows, x)


def _factors(table: np.ndarray, batches) -> np.ndarray:
    """The triangular factor of rows that come in batches, of which one and the factor so far are held. It is made of factors of TALL
    rows, which LAPACK does in one thread: on taller ones the threads of all tasks of a machine wait for each other."""
    for rows in batches:
        n, table = rows.shape[1], np.vstack([table, rows])
        tall = max(TALL, 2 * n)
        while len(table) > tall:
            k = len(table) // tall
            table = np.vstack([np.linalg.qr(table[: k * tall].reshape(k, tall, n), mode="r").reshape(-1, n), table[k * tall :]])
        table = np.linalg.qr(table, mode="r")
    return table


def triangle(df: DataFrame, columns: list[Column], design=None, width: int | None = None) -> np.ndarray:
    """The triangular factor R of the QR decomposition of a tall matrix whose columns these are: each task makes that of its rows, and
    factors of FANIN tasks are put together, level by level, until the driver gets the last few. Rows with a null are left out, and those
    with no number. ``design`` makes, in the task, the ``width`` columns of the matrix of these: as expressions, many powers of one
    column make methods that the JVM doesn't compile.

    R has the singular values of the matrix itself; sums of products would square their ratio."""
    n = width or len(columns)
    rows = df.select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)))

    def factor(r: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def of_rows(batches):
        tables = (np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) for b in batches if b.num_rows)
        known = (t[~np.isnan(t).any(axis=1)] for t in tables)
        yield factor(_factors(np.zeros((0, n)), (design(t) if design else t for t in known)))

    def of_factors(batches):
        each = (np.reshape(x, (-1, n)) for b in batches for x in b.column(0).to_pylist())
        yield factor(_factors(np.zeros((0, n)), (x for x in each if len(x))))

    found = rows.mapInArrow(of_rows, "r array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > FANIN:
        parts = -(-parts // FANIN)
        found = found.repartition(parts).mapInArrow(of_factors, "r array<double>")
    last = [np.reshape(r[0], (-1, n)) for r in found.collect()]  # FANIN of n x n numbers at most
    return _factors(np.zeros((0, n)), [x for x in last if len(x)])


def fit_polynomial(df: DataFrame, order: int, x: str, z: str, y: str | None = None, triangular: bool = False) -> Polynomial:
    """Least squares on the design matrix by a tree of triangular factors; singular values below the last digits of the largest
    count as 0. Rows with a null or no number are left out."""
    dim = 1 if y is None else 2
    powers = Polynomial.exponents(dim, order, triangular)
    n = len(powers)

    def design(t: np.ndarray) -> np.ndarray:
        power = lambda v, k: reduce(lambda a, b: a * b, [v] * k, np.ones(len(v)))
        return np.stack([*(power(t[:, 0], i) * (power(t[:, 2], j) if y else 1.0) for i, j in powers), t[:, 1]], 1)

    r = triangle(df, [F.col(c) for c in (x, z, *([y] if y else []))], design, n + 1)
    count = round(float(r[0, 0] ** 2)) if len(r) else 0  # the first term is 1: its sum of squares is the number of rows
    if count <= n:
        raise ValueError(f"{count} points are too few for {n} coefficients")
    return Polynomial(dim, order, tuple(svd_solve(r[:n, :n], r[:n, n])), triangular)


def svd_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution by singular values; those below n * eps * the largest count as 0."""
    u, w, vt = np.linalg.svd(a, full_matrices=False)
    keep = w > max(a.shape) * np.finfo(float).eps * w.max(initial=0.0)
    return vt.T[:, keep] @ ((u.T[keep] @ b) / w[keep])


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of the normal equations of a overdetermined system by a triangular factor."""
    low = np.linalg.cholesky(a.T @ a)
    return np.linalg.solve(low.T, np.linalg.solve(low, a.T @ b))


def test_polynomial(df: DataFrame, p: Polynomial, x: str, z: str, y: str | None = None) -> DataFrame:
    """One row: n, sse, r2, and r2_fitted, whose total is the spread of the fitted values."""
    fit = df.withColumn("_f", p.evaluate(F.col(x), F.col(y) if y else None))
    s = fit.agg(F.count("*").alias("n"), F.sum((F.col(z) - F.col("_f")) * (F.col(z) - F.col("_f"))).alias("sse"), (F.var_pop(z) * F.count("*")).alias("_t"), (F.var_pop("_f") * F.count("*")).alias("_tf"))
    return s.select("n", "sse", (1 - F.try_divide("sse", "_t")).alias("r2"), (1 - F.try_divide("sse", "_tf")).alias("r2_fitted"))


def chebyshev_nodes(df: DataFrame, index: str, n, low=-1.0, high=1.0) -> DataFrame:
    """df with node: the Chebyshev node of each index from 0, of n over an interval (numbers or Columns)."""
    n, low, high = (v if isinstance(v, Column) else F.lit(v) for v in (n, low, high))
    c = F.cos((2 * F.col(index) + 1) * F.lit(PI) / (2 * n))
    return df.withColumn("node", (low + high) / 2 + (high - low) / 2 * c)


def tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system by elimination along the diagonal; time and memory are linear in its size."""
    n = len(r)
    mid, up, r = mid.tolist(), up.tolist(), r.tolist()
    for i in range(1, n):
        f = float(low[i]) / mid[i - 1]
        mid[i] -= f * up[i - 1]
        r[i] -= f * r[i - 1]
    for i in range(n - 1, -1, -1):
        r[i] = (r[i] - (up[i] * r[i + 1] if i + 1 < n else 0.0)) / mid[i]
    return np.array(r)


@dataclass(frozen=True)
class Spline:
    """A cubic spline: y + d (b + d (c + d e)) from each knot on, d the distance from it. ``topology``: linear or longitude.
    With a ``trend`` (coefficients of 1, x, x^2, x^3) that is added to it."""

    x: tuple[float, ...]
    y: tuple[float, ...]
    b: tuple[float, ...]
    c: tuple[float, ...]
    e: tuple[float, ...]
    topology: str = "linear"
    trend: tuple[float, ...] = ()

    @classmethod
    def fit(cls, x, y, topology: str = "linear", trend: bool = False) -> Spline:
        """Knots in increasing order, two at least. Ends take the third derivative of the cubic through the four last
        knots. Values of longitude topology are unwrapped first.

        ``trend``: y is a function of a knot, whose results (whole numbers or fractions) are not rounded. The cubic through four knots
        far apart is taken off first, and the spline is that of what is left: the same one, as splines of this kind hold cubics, with the
        digits that differences of neighbours lose where values are large beside them."""
        if trend:
            x = list(map(float, x))
            if topology != "linear":
                raise ValueError("longitudes have no trend")
            if len(x) < 4:
                return cls.fit(x, [float(y(v)) for v in x])
            cubic = cubic_through(x, y)
            return replace(cls.fit(x, beside(cubic, x, y)), trend=cubic)
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(x)
        if n < 2 or (np.diff(x) <= 0).any():
            raise ValueError("a spline needs two knots in increasing order")
        if topology == "longitude":
            y = linear_longitudes(y)
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        if n == 2:
            return cls(tuple(x), tuple(y), (slope[0], slope[0]), (0.0, 0.0), (0.0, 0.0), topology)
        low, mid, up, r = (np.zeros(n) for _ in range(4))  # a row of the system: low, mid and up multiply c[i - 1 : i + 2]
        low[1:-1], mid[1:-1], up[1:-1], r[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], slope[1:] - slope[:-1]
        mid[0], up[0], low[-1], mid[-1] = -h[0], h[0], h[-1], -h[-1]
        if n > 3:
            third = lambda k: ((slope[k + 2] - slope[k + 1]) / (x[k + 3] - x[k + 1]) - (slope[k + 1] - slope[k]) / (x[k + 2] - x[k])) / (x[k + 3] - x[k])
            r[0], r[-1] = h[0] ** 2 * third(0), -(h[-1] ** 2) * third(n - 4)
        c = tridiagonal(low, mid, up, r)
        b = np.append(slope - h * (c[1:] + 2 * c[:-1]), slope[-1] + h[-1] * (c[-2] + 2 * c[-1]))
        e = np.append(np.diff(c) / h, (c[-1] - c[-2]) / h[-1])
        return cls(*(tuple(map(float, v)) for v in (x, y, b, 3 * c, e)), topology)

    def evaluate(self, v):
        """At a Column or float; the end intervals go on outside. For a Column a spline has WRITTEN knots at most (see values)."""
        if not isinstance(v, Column):
            i = int(np.clip(np.searchsorted(self.x, v, side="right") - 1, 0, len(self.x) - 1))
            d = v - self.x[i]
            return self._above(v, self.y[i] + d * (self.b[i] + d * (self.c[i] + d * self.e[i])))
        if len(self.x) > WRITTEN:
            raise ValueError(f"a spline of {len(self.x)} knots is evaluated by values()")
        return self._at({k: F.array(*(F.lit(float(a)) for a in getattr(self, k))) for k in "xybce"}, v)

    def _at(self, arrays: dict, v: Column) -> Column:
        """The value by arrays of knots and coefficients."""
        i = F.greatest(F.lit(1), F.size(F.filter(arrays["x"], lambda k: k <= v)))
        at = lambda k: F.element_at(arrays[k], i)
        d = v - at("x")
        out = at("y") + d * (at("b") + d * (at("c") + d * at("e")))
        return normal_lon(out) if self.topology == "longitude" else self._above(v, out)

    def _above(self, v, out):
        return reduce(lambda a, k: a * v + k, reversed(self.trend)) + out if self.trend else out

    def values(self, df: DataFrame, v: str, out: str = "value") -> DataFrame:
        """df with ``out``: the spline at column v (null where v is). Any number of knots: rows meet a block of BLOCK knots by an
        equi-join on the block's number, which is found by binary search among the blocks' first knots."""
        starts = np.array(self.x[::BLOCK])

        @F.pandas_udf("int")
        def block(values: pd.Series) -> pd.Series:
            return pd.Series(np.clip(np.searchsorted(starts, values.to_numpy(), side="right") - 1, 0, None))

        blocks = [(k // BLOCK, *(list(getattr(self, f)[k : k + BLOCK]) for f in "xybce")) for k in range(0, len(self.x), BLOCK)]
        table = df.sparkSession.createDataFrame(blocks, "_block int, " + ", ".join(f"_{f} array<double>" for f in "xybce"))
        at = F.when(F.col(v).isNotNull(), block(F.coalesce(F.col(v).cast("double"), F.lit(0.0))))
        found = df.drop(out).withColumn("_block", at).join(table, "_block", "left")
        value = F.when(F.col("_block").isNotNull(), self._at({f: F.col(f"_{f}") for f in "xybce"}, F.col(v).cast("double")))
        return found.withColumn(out, value).drop("_block", *(f"_{f}" for f in "xybce"))

    def table(self, spark) -> DataFrame:
        """The intervals as rows: x_lo, x_hi, y, b, c, e (without the trend)."""
        hi = [*self.x[1:], float("inf")]
        return spark.createDataFrame(list(zip(self.x, hi, self.y, self.b, self.c, self.e, strict=True)), "x_lo double, x_hi double, y double, b double, c double, e double")

    def save(self, spark, path: str) -> None:
        trend = F.array(*map(F.lit, self.trend)).cast("array<double>").alias("trend")
        self.table(spark).select("*", F.lit(self.topology).alias("topology"), trend).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Spline:
        rows = spark.read.parquet(path).orderBy("x_lo").collect()
        trend = tuple(rows[0]["trend"]) if "trend" in rows[0] else ()
        return cls(*(tuple(r[k] for r in rows) for k in ("x_lo", "y", "b", "c", "e")), rows[0]["topology"], trend)


def cubic_through(x, y) -> tuple[float, ...]:
    """Coefficients of 1, x, x^2, x^3 of the cubic through four knots, the first, the last and those at thirds, y(x) of each a whole number
    or fraction: divided differences of fractions, rounded at the end."""
    u = [x[round(k * (len(x) - 1) / 3)] for k in range(4)]
    out, u = [Fraction(y(v)) for v in u], list(map(Fraction, u))
    for k in range(1, 4):
        out = out[:k] + [(out[i] - out[i - 1]) / (u[i] - u[i - k]) for i in range(k, 4)]
    c = [out[3]]
    for k in (2, 1, 0):  # c (x - u[k]) + out[k]
        c = [a - u[k] * b for a, b in zip([Fraction(0), *c], [*c, Fraction(0)], strict=True)]
        c[0] += out[k]
    return tuple(map(float, c))


def beside(cubic: tuple[float, ...], x, y) -> np.ndarray:
    """What y(x) has besides a cubic at each knot, rounded once: in whole numbers, doubles being such over a power of two."""
    unit = max(v.as_integer_ratio()[1] for vs in (x, cubic) for v in vs)
    whole = lambda v: (r := v.as_integer_ratio())[0] * (unit // r[1])
    c = [whole(v) * unit**k for v, k in zip(cubic, (3, 2, 1, 0), strict=True)]

    def rest(v: float) -> float:
        (over, under), at = Fraction(y(v)).as_integer_ratio(), whole(v)
        return (over * unit**4 - (((c[3] * at + c[2]) * at + c[1]) * at + c[0]) * under) / (under * unit**4)

    return np.fromiter(map(rest, x), float, len(x))


def linear_longitudes(y: np.ndarray) -> np.ndarray:
    """Longitudes with whole turns added so that neighbours are within half a turn."""
    turns = np.round(np.diff(y) / 360.0)
    return y - 360.0 * np.append(0, np.cumsum(turns))
