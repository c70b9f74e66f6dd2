"""Scalar roots and time integration over whole tables.

Roots of many scalar equations are found together, every bracket in its own row, with column
expressions alone.  Linear second-order systems are stepped with sparse solves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.sparse import Matrix, _dot, _line, by_rows, may_be_sent, solve
from trellis.plans.lineage import cut, discard


def roots(rows: DataFrame, f: Callable[[Column], Column], low: str = "low", high: str = "high", rounds: int = 60) -> DataFrame:
    """``rows`` with ``root``: where f changes sign between the ends of each row's bracket.

    Interpolate, truncate, project: the secant's guess is pulled towards the middle and kept within
    the range that bisection would allow, so every round at least keeps up with bisection.  Null
    where the ends have the same sign.  ``f`` may read the row's other columns.  Rows are dealt first:
    a root costs far more than reading its row, and small files would leave them all to a few tasks.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = F.struct(F.col(low).cast("double").alias("a"), F.col(high).cast("double").alias("b"), f(F.col(low).cast("double")).cast("double").alias("fa"), f(F.col(high).cast("double")).cast("double").alias("fb"))

    def step(s: Column, k: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        guess = F.coalesce(F.try_divide(s["fb"] * s["a"] - s["fa"] * s["b"], s["fb"] - s["fa"]), middle)
        width = s["b"] - s["a"]
        pulled = F.when(F.abs(middle - guess) <= 0.2 * F.abs(width), middle).otherwise(guess + F.signum(middle - guess) * 0.2 * F.abs(width) * F.when(k % 3 == 0, 1.0).otherwise(0.05))
        at = F.when(k % 2 == 0, middle).otherwise(pulled)
        value = f(at).cast("double")
        left = F.signum(value) == F.signum(s["fa"])
        return F.struct(F.when(left, at).otherwise(s["a"]).alias("a"), F.when(left, s["b"]).otherwise(at).alias("b"),
                        F.when(left, value).otherwise(s["fa"]).alias("fa"), F.when(left, s["fb"]).otherwise(value).alias("fb"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.when(F.abs(s["fa"]) < F.abs(s["fb"]), s["a"]).otherwise(s["b"]))
    opposite = F.signum(f(F.col(low).cast("double"))) * F.signum(f(F.col(high).cast("double"))) <= 0
    return rows.withColumn("root", F.when(opposite, found))


def integrate(mass: Matrix, damping: Matrix, stiffness: Matrix, state: DataFrame, load: Callable[[float], DataFrame], step: float, steps: int) -> DataFrame:
    """``step, i, u, v, a`` of M a + C v + K u = f(t) by the two-stage composite rule.

    ``state`` is ``i, u, v, a`` at time zero, ``load(t)`` gives ``i, v``.  The first half step is by the
    trapezoidal rule, the second by three-point backward differences; both are sparse solves.
    """
    def pick(name: str, by: float = 1.0) -> DataFrame:
        return state.select("i", (F.col(name) * by).alias("v"))

    half = step / 2
    first = mass.scale(4 / half**2).add(damping.scale(2 / half)).add(stiffness)
    second = mass.scale(9 / step**2).add(damping.scale(3 / step)).add(stiffness)
    state = cut(state.select("i", "u", "v", "a"))
    out = state.select(F.lit(0).alias("step"), "i", "u", "v", "a")
    for n in range(1, steps + 1):
        t = (n - 1) * step
        u, v, a = pick("u"), pick("v"), pick("a")
        inertia = _line(u.limit(0), (4 / half**2, u), (4 / half, v), (1.0, a))
        drag = _line(u.limit(0), (2 / half, u), (1.0, v))
        right = _line(load(t + half), (1.0, mass.apply(inertia)), (1.0, damping.apply(drag)))
        um = solve(first, right)
        vm = _line(um.limit(0), (2 / half, um), (-2 / half, u), (-1.0, v))
        # u' is (u - 4 um + 3 u1) / step, and likewise for v'.
        back = _line(u.limit(0), (1 / step, u), (-4 / step, um))
        backv = _line(u.limit(0), (1 / step, v), (-4 / step, vm))
        right = _line(load(t + step), (-1.0, mass.apply(_line(backv, (3 / step, back)))), (-1.0, damping.apply(back)))
        u1 = solve(second, right)
        v1 = _line(back, (3 / step, u1))
        a1 = _line(backv, (3 / step, v1))
        every = state.select("i")
        state = cut(every.join(u1.withColumnRenamed("v", "u"), "i", "left").join(v1, "i", "left").join(a1.withColumnRenamed("v", "a"), "i", "left").na.fill(0.0))
        out = out.unionByName(state.select(F.lit(n).alias("step"), "i", "u", "v", "a"))
    return out


def _dogleg(jacobian: Matrix, r: DataFrame, radius: float) -> tuple[DataFrame, float]:
    """A step within the radius: the full one if it fits, else bent from the steepest descent; and its length."""
    whole = solve(jacobian, r).select("i", (-F.col("v")).alias("v"))
    size = _dot(whole, whole) ** 0.5
    if size <= radius:
        return whole, size
    g = cut(jacobian.transpose().apply(r))
    jg = jacobian.apply(g)
    slope = _dot(g, g)
    down = _line(g.limit(0), (-slope / _dot(jg, jg), g))
    reach = _dot(down, down) ** 0.5
    if reach >= radius:
        return _line(down.limit(0), (radius / reach, down)), radius
    leg = _line(whole, (-1.0, down))
    a, b, c = _dot(leg, leg), 2 * _dot(down, leg), reach * reach - radius * radius
    return _line(down, ((-b + (b * b - 4 * a * c) ** 0.5) / (2 * a), leg)), radius


def newton(residual: Callable[[DataFrame], DataFrame], jacobian: Callable[[DataFrame], Matrix], start: DataFrame, tolerance: float = 1e-10, max_rounds: int = 50, radius: float = 1.0) -> DataFrame:
    """``i, v`` where the residual (``i, v``, as the start) vanishes, by Newton steps within a trust region.

    The region grows when a step falls as the linear model said, and shrinks when not.
    """
    x = cut(start.select("i", "v"))
    r = cut(residual(x))
    size = _dot(r, r) ** 0.5
    for _ in range(max_rounds):
        if size <= tolerance:
            return x
        j = jacobian(x)
        step, length = _dogleg(j, r, radius)
        tried = _line(x, (1.0, step))
        new = cut(residual(tried))
        fell, model = size - _dot(new, new) ** 0.5, _line(r, (1.0, j.apply(step)))
        ratio = fell / max(size - _dot(model, model) ** 0.5, 1e-300)
        radius = radius / 4 if ratio < 0.25 else 2 * radius if ratio > 0.75 and length >= 0.99 * radius else radius
        if ratio > 1e-4:
            x, r, size = tried, new, size - fell
    raise ArithmeticError(f"no root within {max_rounds} steps")


def smallest_eigenvalue(a: Matrix, start: DataFrame, tolerance: float = 1e-10, max_rounds: int = 100) -> tuple[float, DataFrame]:
    """The eigenvalue of a symmetric matrix nearest zero, and its vector ``i, v``, by inverse iteration."""
    x = _line(start.limit(0), (1 / _dot(start, start) ** 0.5, start))
    value = float("inf")
    for _ in range(max_rounds):
        y = cut(solve(a, x))
        size = _dot(y, y) ** 0.5
        x = _line(y.limit(0), (1 / size, y))
        value, old = _dot(x, a.apply(x)), value
        if abs(value - old) <= tolerance * abs(value):
            return value, x
    raise ArithmeticError(f"no eigenvalue within {max_rounds} rounds")


def _block(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Array columns of one width each, side by side."""
    return np.hstack([batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in names])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _moments(state: DataFrame, left: list[str], right: list[str], values: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S'S and S'AS of the columns ``left`` and their products ``right``, and the squared residuals of x; summed by parts in Spark."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            s, t = _block(batch, left), _block(batch, right)
            r = t[:, :k] - s[:, :k] * values if values is not None else np.zeros((1, k))
            own = np.concatenate([(s.T @ s).ravel(), (s.T @ t).ravel(), (r * r).sum(axis=0)])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

    sums = state.mapInArrow(parts, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
    n = k * len(left)
    return sums[: n * n].reshape(n, n), sums[n * n : 2 * n * n].reshape(n, n), sums[2 * n * n :]


def _projected(g: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest values of the small problem h c = value g c, and their vectors; directions that others hold already are left out."""
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    size[np.diag(g) <= 1e-280] = np.inf
    weight, turn = np.linalg.eigh(g / np.outer(size, size))
    some = weight > 1e-13 * weight[-1]
    base = turn[:, some] / np.sqrt(weight[some]) / size[:, None]
    values, vectors = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
    return values[:k], base @ vectors[:, :k]


def smallest_eigenpairs(a: Matrix, m: int, tolerance: float = 1e-7, max_rounds: int = 300, guard: int = 3) -> tuple[DataFrame, DataFrame]:
    """``nth, value, residual`` of the ``m`` smallest eigenvalues of a symmetric matrix, ascending from 1, and their vectors ``i, nth, v``.

    A block of ``m + guard`` vectors, a row of the table for each index that has a cell, is improved in rounds: its residuals, scaled by the diagonal, and
    the last step join it, and the small problem projected on all three is solved (the locally optimal block method).  A round has one
    product with the matrix, for all vectors at once, and one sum of small matrices; a small block is sent to the cells for its product, a larger one never leaves the tasks.  It ends when the
    residuals |A x - value x| of all ``m`` unit vectors are below ``tolerance`` times the largest of the values or 1; values are then right to about its square.
    More values than indices, or no end within ``max_rounds``, are errors.
    """
    cells = by_rows(a.cells)
    every = cells.select("i").union(cells.select("j")).distinct()
    n = every.count()
    if m > n:
        raise ValueError(f"{m} eigenvalues of a matrix of {n} rows")
    k = min(m + guard, n)
    sent = may_be_sent(n, k)
    scale = cells.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    start = F.array(*((F.pmod(F.xxhash64("i", F.lit(c)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias("x") for c in range(k)))
    zero = F.array_repeat(F.lit(0.0), k)
    state = cut(every.join(scale, "i", "left").select("i", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0).alias("d"), start.alias("x")))

    def with_product(table: DataFrame, of: str) -> DataFrame:
        x = table.select(F.col("i").alias("j"), of)
        met = cells.join(F.broadcast(x) if sent else x, "j").groupBy("i").agg(*(F.sum(F.col("v") * F.get(of, F.lit(c))).alias(f"s{c}") for c in range(k)))
        made = cut(table.join(met, "i", "left").select(*table.columns, F.array(*(F.coalesce(f"s{c}", F.lit(0.0)) for c in range(k))).alias("a" + of)))
        discard(table)
        return made

    state = with_product(state, "x")
    values, c = _projected(*_moments(state, ["x"], ["ax"], None, k)[:2], k)
    whole = state.select("*", *(zero.alias(name) for name in ("w", "aw", "p", "ap")))
    c = np.vstack([c, np.zeros((2 * k, k))])
    shape = "i long, d double, x array<double>, ax array<double>, p array<double>, ap array<double>, w array<double>"
    for _ in range(max_rounds):

        def step(batches: Iterator[pa.RecordBatch], c: np.ndarray = c, values: np.ndarray = values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, t = _block(batch, ["x", "w", "p"]), _block(batch, ["ax", "aw", "ap"])
                d = batch.column(batch.schema.get_field_index("d")).to_numpy(zero_copy_only=False)
                x, ax, move, amove = s @ c, t @ c, s[:, k:] @ c[k:], t[:, k:] @ c[k:]
                columns = [batch.column(batch.schema.get_field_index("i")), pa.array(d), *map(_lists, (x, ax, move, amove, d[:, None] * (ax - x * values)))]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "d", "x", "ax", "p", "ap", "w"])

        moved = cut(whole.mapInArrow(step, shape))
        discard(state)
        state = whole = with_product(moved, "w")
        g, h, left = _moments(whole, ["x", "w", "p"], ["ax", "aw", "ap"], values, k)
        left = np.sqrt(np.maximum(left, 0))
        if (left[:m] <= tolerance * max(1.0, np.abs(values[:m]).max())).all():
            said = [(nth + 1, float(values[nth]), float(left[nth])) for nth in range(m)]
            vectors = state.select("i", F.posexplode(F.slice("x", 1, m)).alias("pos", "v")).select("i", (F.col("pos") + 1).alias("nth"), "v")
            discard(cells)
            return a.cells.sparkSession.createDataFrame(said, "nth int, value double, residual double"), vectors
        values, c = _projected(g, h, k)
    raise ArithmeticError(f"no {m} eigenvalues within {max_rounds} rounds")
