"""Statistics and factorizations of tall tables of vectors.

A table of n vectors of d numbers (``v ARRAY<DOUBLE>``) is n by d; d is small and fixed, n is not.
Tasks reduce their rows to d by d sums, a tree of sums follows, and only d by d results reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WIDTH = 2048  # of a d by d result


def _wide(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows ``v`` that are not null, and their common length; a row of another length, or with a null in it, is an error."""
    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v is not null")
    first = rows.first()
    if first is None:
        return rows, 0
    d = len(first.v)
    if d > MAX_WIDTH:
        raise ValueError(f"vectors of more than {MAX_WIDTH} numbers")
    return rows.select(checked("v", d).alias("v")), d


def checked(column: str, d: int) -> Column:
    """An array column, or an error where it has other than ``d`` numbers."""
    v = F.col(column).cast("array<double>")
    said = F.concat(F.lit(f"a vector is not of {d} numbers: "), F.coalesce(F.size(v).cast("string"), F.lit("null")))
    return F.when(v.isNull() | ((F.size(v) == d) & F.forall(v, lambda x: x.isNotNull())), v).otherwise(F.raise_error(said).cast("array<double>"))


def moments(vectors: DataFrame, column: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their mean, and the sum of the outer products of their distances from it.

    Each batch is centred on its own mean, and results are joined by the pairwise rule, so that a large
    mean costs no digits.  Rows of different lengths are an error.
    """
    rows, d = _wide(vectors, column)
    if not d:
        return 0, np.zeros(0), np.zeros((0, 0))

    def joined(parts: Iterator[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        n, mean, spread = 0.0, np.zeros(d), np.zeros((d, d))
        for m, other, more in parts:
            if m:
                apart, n = other - mean, n + m
                spread = spread + more + np.outer(apart, apart) * ((n - m) * m / n)
                mean = mean + apart * (m / n)
        return n, mean, spread

    def packed(n: float, mean: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], mean, spread.ravel()])], pa.list_(pa.float64()))], names=["m"])

    def parted(rows: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for row in rows:
            flat = row.values.to_numpy(zero_copy_only=False)
            yield flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if len(x):
                mean = x.mean(0)
                yield len(x), mean, (x - mean).T @ (x - mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(*joined(centred(batches)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(*joined(p for batch in batches for p in parted(batch.column(0))))

    parts = rows.mapInArrow(run, "m array<double>")
    n = rows.rdd.getNumPartitions()
    while n > 16:  # at most sixteen results meet in one task
        n = -(-n // 16)
        parts = parts.repartition(n).mapInArrow(again, "m array<double>")
    count, mean, spread = joined(p for chunk in parts.toArrow().column("m").chunks for p in parted(chunk))
    return int(count), mean, spread


def _cells(spark, matrix: np.ndarray, name: str = "v") -> DataFrame:
    i, j = np.indices(matrix.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), name: matrix.ravel()}))


def covariance(vectors: DataFrame, column: str = "v") -> DataFrame:
    """``i, j, v``: the unbiased covariance of the components; an error for fewer than two vectors."""
    n, _, spread = moments(vectors, column)
    if n < 2:
        raise ValueError("covariance needs two vectors or more")
    return _cells(vectors.sparkSession, spread / (n - 1))


def correlation(vectors: DataFrame, column: str = "v") -> DataFrame:
    """``i, j, v``: correlations; of a constant component, 1 with itself and 0 with others."""
    n, mean, c = moments(vectors, column)
    if n < 2:
        raise ValueError("correlation needs two vectors or more")
    spread = np.sqrt(np.maximum(np.diag(c), 0))
    flat = spread <= 1e-12 * np.maximum(1.0, np.sqrt(n) * np.abs(mean))
    out = c / np.where(np.outer(spread, spread) == 0, 1, np.outer(spread, spread))
    out[flat, :] = out[:, flat] = 0
    np.fill_diagonal(out, 1.0)
    return _cells(vectors.sparkSession, np.clip(out, -1, 1))


def least_squares(rows: DataFrame, features: str = "v", target: str = "y") -> np.ndarray:
    """Coefficients of the best fit of ``target`` by the features, by the normal equations."""
    both = rows.select(F.concat(F.col(features).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("v"))
    n, mean, spread = moments(both)
    outer = spread + n * np.outer(mean, mean)
    return np.linalg.lstsq(outer[:-1, :-1], outer[:-1, -1], rcond=None)[0]


def principal_axes(vectors: DataFrame, k: int, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """The k largest variances and their axes (columns)."""
    n, _, spread = moments(vectors, column)
    values, axes = np.linalg.eigh(spread / max(1, n - 1))
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], axes[:, order]


def singular_values(vectors: DataFrame, column: str = "v") -> np.ndarray:
    """Of the n by d table, largest first."""
    n, mean, spread = moments(vectors, column)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(spread + n * np.outer(mean, mean))[::-1], 0))


def triangular_factor(vectors: DataFrame, column: str = "v") -> np.ndarray:
    """R of the table's QR factorization, with a positive diagonal, by factoring partitions and then
    their stacked factors in a tree."""
    rows, d = _wide(vectors, column)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["v"])

    parts = rows.mapInArrow(reduce, "v array<double>")
    n = rows.rdd.getNumPartitions()
    while n > 16:  # at most sixteen factors meet in one task
        n = -(-n // 16)
        parts = parts.repartition(n).mapInArrow(reduce, "v array<double>")
    r = np.linalg.qr(np.array([x.v for x in parts.collect()]), mode="r")
    return r * np.where(np.diag(r) < 0, -1, 1)[:, None]


def transformed(vectors: DataFrame, matrix: np.ndarray, column: str = "v") -> DataFrame:
    """Every vector times a small matrix, in the tasks; other columns and null vectors stay, other lengths are an error."""
    names, at = list(vectors.columns), vectors.columns.index(column)
    rows = vectors.withColumn(column, checked(column, matrix.shape[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at)
            live = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(len(given), None, object)
            x = given.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[0]) @ matrix
            for i, r in zip(live.tolist(), x.tolist()):
                out[i] = r
            moved = pa.array(out.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([moved if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return rows.mapInArrow(run, rows.schema)


def norm(column: str = "v"):
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def inner(a: str, b: str):
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def batched(matrices: DataFrame, operation: str, size: int, column: str = "m") -> DataFrame:
    """One result for each row's own ``size`` by ``size`` matrix (row by row in an array column).

    ``determinant`` gives ``out DOUBLE``; ``inverse``, ``symmetric_eigenvalues``, ``singular_values`` and
    ``exponential`` give ``out ARRAY<DOUBLE>``.  Whole batches go through one call; a singular
    matrix's inverse is null, as is the result of a null matrix.  Other columns stay.
    """
    names = [*matrices.columns, "out"]
    at = matrices.columns.index(column)
    rows = matrices.withColumn(column, F.col(column).cast("array<double>"))
    scalar = operation == "determinant"

    def compute(x: np.ndarray) -> np.ndarray:
        if operation == "determinant":
            return np.linalg.det(x)
        if operation == "inverse":
            return np.linalg.inv(x).reshape(len(x), -1)
        if operation == "symmetric_eigenvalues":
            return np.linalg.eigvalsh(x)
        if operation == "singular_values":
            return np.linalg.svd(x, compute_uv=False)
        if operation == "exponential":  # by halving, a short series, and squaring
            halvings = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(x).sum(2).max())))) + 2)
            y = x / 2.0**halvings
            term = out = np.broadcast_to(np.eye(size), x.shape)
            for k in range(1, 20):
                term = term @ y / k
                out = out + term
            for _ in range(halvings):
                out = out @ out
            return out.reshape(len(x), -1)
        raise ValueError(operation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at)
            live = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            x = given.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
            if operation == "inverse":
                fine = np.abs(np.linalg.det(x)) > 0
                live, x = live[fine], x[fine]
            out = np.full(len(given), None, object)
            for i, r in zip(live.tolist(), compute(x) if len(x) else []):
                out[i] = float(r) if scalar else r.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.tolist(), pa.float64() if scalar else pa.list_(pa.float64()))], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("out", T.DoubleType() if scalar else T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)
