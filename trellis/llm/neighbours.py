"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are turned by a rotation that is learned on a bounded sample (iterative quantization)
and reduced to signs.  A code is split into substrings, each with an index of its own.  If two
codes differ in at most r bits, some substring of m differs in at most r // m, so probing every
substring to that radius retrieves every code within r; those are reranked by their floats.

The index is a table with one row a vector and substring.  Values of a substring are gathered into
cells of about ``DATA_BLOCK`` rows, neighbouring values together and a value of more rows in several
cells.  A query goes to the cells that hold a value within its radius, once each; so vectors cross
the network once for each substring, however many queries there are.  A cell's rows come first, its queries pass by in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.rows import small_batches
from trellis.plans.lineage import cut, cut_counted, discard

#: Vectors that the rotation is learned on, and those of them that tell how near a query's k nearest are at least.
SAMPLE, BASE = 20_000, 1_024
#: Rows of a cell, and queries that meet it at a time.
DATA_BLOCK, QUERY_BLOCK = 16_384, 256
#: Bits of a substring at most; the values of all substrings are counted in one small table.
WIDTH = 16


@dataclass(frozen=True)
class Coder:
    """``turn`` maps vectors to ``bits`` columns whose signs are the code; ``radius`` is in bits."""

    turn: np.ndarray
    parts: int
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    @property
    def width(self) -> int:
        return -(-self.bits // self.parts)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Substrings as a matrix of numbers, one column a part."""
        signs, width = (vectors @ self.turn) > 0, self.width
        padded = np.zeros((len(signs), self.parts * width), bool)
        padded[:, : signs.shape[1]] = signs
        weights = (1 << np.arange(width)).astype(np.int64)
        return padded.reshape(len(signs), self.parts, width) @ weights


def valid(vectors: DataFrame, dim: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part.

    Those have an id and a vector (of ``dim`` numbers) without null, NaN or infinite components
    and other than zero.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows if dim is None else rows.where(F.size("v") == dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray, k: int, max_bits: int = 64, rounds: int = 30, recall: float = 0.985, seed: int = 7) -> Coder:
    """Learn the rotation by iterative quantization, and the radius from the sample's own neighbours.

    The radius is the share ``recall`` of the code distances between sample vectors and their k
    nearest in the sample.  In the whole table neighbours are nearer, so it serves there too.
    """
    rng = np.random.default_rng(seed)
    x = unit(sample)
    bits = min(max_bits, x.shape[1])
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values, kind="stable")[:bits]]
    low = x @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (left @ right).T
    whole = axes @ turn
    parts = -(-bits // WIDTH)
    signs = np.packbits((x @ whole) > 0, axis=1)
    picked = rng.choice(len(x), min(len(x), 400), replace=False)
    near = x[picked] @ x.T
    near[np.arange(len(picked)), picked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    apart = np.bitwise_count(signs[picked][:, None, :] ^ signs[best]).sum(2)
    return Coder(whole, parts, int(np.quantile(apart, recall, method="higher")) if len(x) > 1 else bits)


@dataclass(frozen=True)
class Cells:
    """For each part and value the first of its cells (-1: no row has it) and how many it has; the part of each cell."""

    first: np.ndarray
    several: np.ndarray
    part: np.ndarray

    @staticmethod
    def dealt(counts: list[tuple[int, int, int]], parts: int, width: int, most: int) -> Cells:
        """From the number of rows of each (part, value)."""
        first, several, part = np.full((parts, 1 << width), -1, np.int32), np.zeros((parts, 1 << width), np.int32), []
        room, now = 0, -1
        for p, value, n in sorted(counts):
            if n >= most or n > room or part[now] != p:
                now, room, few = len(part), max(0, most - n), max(1, -(-n // most))
                part += [p] * few
                several[p, value] = few
            else:
                room -= n
                several[p, value] = 1
            first[p, value] = now
        return Cells(first, several, np.array(part, np.int32))

    def of_rows(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The cell of each row for each part; rows of one value are dealt by their place."""
        at = np.arange(codes.shape[1])
        return self.first[at, codes] + place[:, None] % self.several[at, codes]

    def near(self, code: np.ndarray, reach: int) -> np.ndarray:
        """All cells with a row of which some part differs in ``reach`` bits or fewer."""
        out = []
        for p, value in enumerate(code.tolist()):
            hit = (np.bitwise_count(np.arange(self.first.shape[1]) ^ value) <= reach) & (self.first[p] >= 0)
            first, several = self.first[p][hit], self.several[p][hit]
            out += [np.unique(first), *(np.arange(a + 1, a + n) for a, n in zip(first[several > 1].tolist(), several[several > 1].tolist()))]
        return np.concatenate(out)


def retrieved(part: int, reach: int, radius: int, codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which rows (of ``codes``) each of ``asked`` finds by substring ``part``: those within ``radius`` that no earlier part finds."""
    apart = np.bitwise_count(codes[:, None, part] ^ asked[None, :, part])
    inside, whole = apart <= reach, apart
    for j in range(codes.shape[1]):
        if j != part:
            other = np.bitwise_count(codes[:, None, j] ^ asked[None, :, j])
            whole = whole + other
            if j < part:
                inside &= other > reach
    return inside & (whole <= radius)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of ``x`` and ``q``, each by the same sums whatever else is in ``x``."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def nearest_of_cell(ids: np.ndarray, x: np.ndarray, found: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> list[tuple]:
    """The k nearest of each query among the rows it has ``found`` and whose cosine is not below ``least``."""
    rows = np.flatnonzero(found.any(1))
    if not len(rows):
        return []
    ids, x = ids[rows], x[rows]
    rough = unit(x) @ unit(q).T
    slack = 1e-9
    found = found[rows] & (rough >= least - slack) & (ids[:, None] != query_ids)
    out = []
    for j in np.flatnonzero(found.any(0)).tolist():
        mine = np.flatnonzero(found[:, j])
        if len(mine) > k:
            last = np.partition(rough[mine, j], len(mine) - k)[len(mine) - k]
            mine = mine[rough[mine, j] >= last - slack]
        exact = cosine(x[mine], q[j])
        best = np.lexsort((ids[mine], -exact))[:k]
        out += [(int(query_ids[j]), i, s) for i, s in zip(ids[mine][best].tolist(), exact[best].tolist())]
    return out


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), kind))


@dataclass(frozen=True)
class _Search:
    """What a round's tasks know: the coder, the cells, and how far queries reach."""

    coder: Coder
    cells: Cells
    radius: int
    k: int
    query_block: int
    base_ids: np.ndarray
    base: np.ndarray

    @property
    def reach(self) -> int:
        return self.radius // self.coder.parts

    def entries(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The index rows of vectors (vec_id, v, code, place): one a substring."""
        codes = _matrix(batch.column(2), self.coder.parts, np.int64)
        cell = self.cells.of_rows(codes, batch.column(3).to_numpy())
        row = np.repeat(np.arange(len(codes)), self.coder.parts)
        return self._rows(batch, cell.ravel(), row, codes, 0, np.zeros(len(codes)))

    def probes(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of queries (vec_id, v): one a cell that may hold what they look for."""
        x = _matrix(batch.column(1), len(self.coder.turn), np.float64)
        codes, near = self.coder.codes(x), unit(x) @ unit(self.base).T
        near[batch.column(0).to_numpy()[:, None] == self.base_ids] = -np.inf
        short = near.shape[1] < self.k
        least = np.full(len(x), -np.inf) if short else np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
        cells = [self.cells.near(c, self.reach) for c in codes]
        row = np.repeat(np.arange(len(codes)), [len(c) for c in cells])
        return self._rows(batch, np.concatenate([*cells, np.zeros(0, np.int64)]), row, codes, 1, least)

    def _rows(self, batch: pa.RecordBatch, cell: np.ndarray, row: np.ndarray, codes: np.ndarray, asks: int, least: np.ndarray) -> pa.RecordBatch:
        columns = {"cell": pa.array(cell, pa.int32()), "asks": pa.array(np.full(len(row), asks), pa.int32()), "vec_id": batch.column(0).take(pa.array(row)),
                   "v": batch.column(1).take(pa.array(row)), "code": _lists(codes[row], pa.int32()), "least": pa.array(least[row])}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell's rows are held as they come, at most a cell's; its queries follow."""
        dim, parts = len(self.coder.turn), self.coder.parts
        cell, held, block = None, [], None
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(asks) != 0)) + 1
            out = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                if hi == lo:
                    continue
                if at[lo] != cell:
                    cell, held, block = at[lo], [], None
                read = lambda b: (b.column(2).to_numpy(), _matrix(b.column(3), dim, np.float64), _matrix(b.column(4), parts, np.uint16))
                if not asks[lo]:
                    held.append(read(batch.slice(lo, hi - lo)))
                    continue
                if not held:
                    continue
                block = block or tuple(map(np.concatenate, zip(*held)))
                for start in range(lo, hi, self.query_block):
                    some = batch.slice(start, min(hi - start, self.query_block))
                    own, q, asked = read(some)
                    found = retrieved(self.cells.part[cell], self.reach, self.radius, block[2], asked)
                    out += nearest_of_cell(block[0], block[1], found, own, q, some.column(5).to_numpy(), self.k)
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])


def _mapped(rows: DataFrame, one, schema: str) -> DataFrame:
    return rows.mapInArrow(lambda batches: (one(b) for b in batches if b.num_rows), schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found by cosine, ties to smaller ids.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``.  The rotation and radius come
    from ``sample`` rows at most; every row is indexed.  Rows with a query's id are not its
    candidates; a query id that repeats counts once, with the least of its vectors.  Vectors of another length than the sample's
    most common take no part, nor do those that ``valid`` leaves out.  Queries that find fewer than k within the radius search again
    with a wider one, in the end with that of all codes.
    """
    spark = vectors.sparkSession
    fine = valid(vectors)
    drawn = fine.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = pd.Series([len(r.v) for r in drawn]).value_counts()
    dim = int(dims[dims == dims.max()].index.min())
    drawn = [r for r in drawn if len(r.v) == dim]
    coder = fit(np.array([r.v for r in drawn]), k)
    base_ids, base = np.array([r.vec_id for r in drawn[:BASE]], np.int64), np.array([r.v for r in drawn[:BASE]])
    small_batches(spark)
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    numbers = F.col("v").cast(f"array<{kind}>").alias("v")

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = coder.codes(_matrix(batch.column(1), dim, np.float64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(codes, pa.int32()), batch.column(2)], names=["vec_id", "v", "code", "place"])

    data = fine.where(F.size("v") == dim).select("vec_id", numbers, F.monotonically_increasing_id().alias("place"))
    data = cut(_mapped(data, coded, f"vec_id long, v array<{kind}>, code array<int>, place long"))
    # At most 2 ** WIDTH values a part.
    values = data.select(F.posexplode("code").alias("part", "value")).groupBy("part", "value").count().collect()
    cells = Cells.dealt([tuple(r) for r in values], coder.parts, coder.width, data_block)
    tasks = max(1, min(len(cells.part), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cells.part) // 8)))
    left = cut(valid(queries, dim).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", numbers))
    schema = f"cell int, asks int, vec_id long, v array<{kind}>, code array<int>, least double"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    results = []
    for radius in sorted({coder.radius, min(coder.bits, coder.radius + coder.bits // 4), coder.bits}):
        # Reached bits are made whole for the last round: then every part's radius is a part's width.
        search = spark.sparkContext.broadcast(_Search(coder, cells, radius if radius < coder.bits else coder.parts * coder.width, k, query_block, base_ids, base))
        rows = _mapped(data, lambda b, s=search: s.value.entries(b), schema).unionAll(_mapped(left, lambda b, s=search: s.value.probes(b), schema))
        rows = rows.repartition(tasks, "cell").sortWithinPartitions("cell", "asks")
        found = rows.mapInArrow(lambda batches, s=search: s.value.meet(batches), "query_id long, vec_id long, score double")
        found = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        results.append(found)
        if radius == coder.bits:
            break
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        asked, (left, (n,)) = left, cut_counted(left.join(full, "vec_id", "left_anti"), F.count(F.lit(1)))
        discard(asked)
        if not n:
            break
    discard(data, left)
    out = results[-1]
    for round_ in results[:-1]:  # of a query that searched again only the last counts
        whole = round_.where(F.col("rank") == k).select("query_id")
        out = out.unionAll(round_.join(whole, "query_id", "left_semi"))
    return out
