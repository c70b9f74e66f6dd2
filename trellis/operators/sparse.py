"""Sparse matrices as coordinates ``i, j, v``, with sizes kept beside them.

Products are joins on the inner index with partial sums before the shuffle; a matrix without
values (``v`` null) is a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.relation import renumber
from trellis.plans.lineage import cut, cut_counted, discard, written

#: Vectors of up to this many bytes together are sent to all tasks; larger ones meet the cells by merging.
SENT = 40_000_000


@dataclass(frozen=True)
class Matrix:
    """``cells`` has ``i, j, v``, one line for each stored cell."""

    cells: DataFrame
    rows: int
    columns: int

    def _with(self, cells: DataFrame, rows: int | None = None, columns: int | None = None) -> Matrix:
        return replace(self, cells=cells.select("i", "j", "v"), rows=self.rows if rows is None else rows, columns=self.columns if columns is None else columns)

    def transpose(self) -> Matrix:
        return self._with(self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.columns, self.rows)

    def scale(self, by: float) -> Matrix:
        return self._with(self.cells.withColumn("v", F.col("v") * by))

    def add(self, other: Matrix, by: float = 1.0) -> Matrix:
        """This plus ``by`` times the other; a pattern if either is one."""
        self._same(other)
        both = self.cells.unionByName(other.cells.withColumn("v", F.col("v") * by))
        none = F.bool_or(F.col("v").isNull())
        return self._with(both.groupBy("i", "j").agg(F.when(~none, F.sum("v")).alias("v")))

    def subtract(self, other: Matrix) -> Matrix:
        return self.add(other, -1.0)

    def hadamard(self, other: Matrix) -> Matrix:
        """Cells of both, multiplied."""
        self._same(other)
        return self._with(self.cells.join(other.cells.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")))

    def times(self, other: Matrix, block: int = 1024) -> Matrix:
        """The product, by a join on the inner index.

        An inner index that a cells of this and b of the other share gives a times b products.  Where these are more than ``block`` squared, both lists
        are dealt into parts of about ``block`` cells by their outer index, and each pair of parts is one block: so no key of the join has more
        products than a block, and a cell is sent once for each part of the other side.  Sums are combined within tasks before they are dealt by cell.
        """
        if self.columns != other.rows:
            raise ValueError("inner sizes differ")
        left = self.cells.select("i", F.col("j").alias("k"), "v")
        right = other.cells.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
        hot = left.groupBy("k").agg(F.count("*").alias("a")).join(right.groupBy("k").agg(F.count("*").alias("b")), "k")
        parts = lambda c: F.ceil(F.col(c) / block).cast("int").alias("p" + c)
        hot, (some,) = cut_counted(hot.where(F.col("a") * F.col("b") > F.lit(block * block)).select("k", parts("a"), parts("b")), F.count(F.lit(1)))
        keys = ["k"]
        if some:
            dealt = lambda outer, own: F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64(outer), F.col(own)).cast("int"))
            every = lambda own: F.explode(F.when(F.col(own).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(own) - 1)))
            left = left.join(hot, "k", "left").select("i", "k", "v", dealt("i", "pa").alias("ra"), every("pb").alias("rb"))
            right = right.join(hot, "k", "left").select("k", "j", "w", every("pa").alias("ra"), dealt("j", "pb").alias("rb"))
            keys = ["k", "ra", "rb"]
        # A set number of parts: tasks that make many products of few cells would hold the sums of all of them.
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys).hint("merge")
        return self._with(left.join(right, keys).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v")), self.rows, other.columns)

    def apply(self, vector: DataFrame, sent: bool = False) -> DataFrame:
        """``i, v``: the product with a vector ``i, v``; rows that meet nothing are left out.

        With ``sent`` the vector goes to all tasks and the cells stay where they are.
        """
        x = vector.select(F.col("i").alias("j"), F.col("v").alias("x"))
        return self.cells.join(F.broadcast(x) if sent else x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))

    def scale_rows(self, by: DataFrame) -> Matrix:
        return self._with(self.cells.join(by.select("i", F.col("v").alias("w")), "i").select("i", "j", (F.col("v") * F.col("w")).alias("v")))

    def scale_columns(self, by: DataFrame) -> Matrix:
        return self._with(self.cells.join(by.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").select("i", "j", (F.col("v") * F.col("w")).alias("v")))

    def triangle(self, upper: bool = True, strict: bool = False) -> Matrix:
        gap = F.col("j") - F.col("i") if upper else F.col("i") - F.col("j")
        return self._with(self.cells.where(gap > 0 if strict else gap >= 0))

    def drop_zeros(self, tolerance: float = 0.0) -> Matrix:
        return self._with(self.cells.where(F.abs("v") > tolerance))

    def block(self, row_ids: DataFrame, column_ids: DataFrame) -> Matrix:
        """The cells of some rows and columns (``old, new`` each), renumbered."""
        r = row_ids.select(F.col("old").alias("i"), F.col("new").alias("i2"))
        c = column_ids.select(F.col("old").alias("j"), F.col("new").alias("j2"))
        moved = self.cells.join(r, "i").join(c, "j").select(F.col("i2").alias("i"), F.col("j2").alias("j"), "v")
        return self._with(moved, row_ids.count(), column_ids.count())

    def symmetric_part(self) -> Matrix:
        """Half of this plus its transpose."""
        return self.add(self.transpose()).scale(0.5)

    def power(self, n: int) -> Matrix:
        """The n-th power, n at least 1, by squaring; every product is written."""
        out, base = None, self
        while n:
            if n & 1:
                out = base if out is None else out.times(base)
                out = out._with(cut(out.cells))
            n >>= 1
            if n:
                base = base.times(base)
                base = base._with(cut(base.cells))
        return out

    def is_symmetric(self, tolerance: float = 0.0) -> bool:
        """Whether no cell differs from its mirror by more than the tolerance; missing cells are zero."""
        return self.rows == self.columns and self.add(self.transpose(), -1.0).cells.where(F.abs("v") > tolerance).isEmpty()

    def diagonal(self) -> DataFrame:
        return self.cells.where("i = j").select("i", "v")

    def kronecker(self, other: Matrix, block: int = 100_000) -> Matrix:
        """The Kronecker product; every cell of one meets every cell of the other, as it must.

        The other's cells are dealt into blocks of about ``block``, and this one's meet each block by an equi-join.
        """
        blocks = max(1, -(-other.cells.count() // block))
        b = other.cells.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w"), F.pmod(F.xxhash64("i", "j"), F.lit(blocks)).alias("block"))
        a = self.cells.select("i", "j", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        met = a.join(F.broadcast(b) if blocks == 1 else b, "block")
        return self._with(met.select((F.col("i") * other.rows + F.col("k")).alias("i"), (F.col("j") * other.columns + F.col("l")).alias("j"), (F.col("v") * F.col("w")).alias("v")), self.rows * other.rows, self.columns * other.columns)

    def row_extremes(self) -> DataFrame:
        """``i, arg_max, arg_min``: the columns of each row's largest and smallest value, the smaller one of equals."""
        return self.cells.where("v is not null").groupBy("i").agg(
            F.max_by("j", F.struct("v", (-F.col("j")).alias("c"))).alias("arg_max"), F.min_by("j", F.struct("v", F.col("j").alias("c"))).alias("arg_min"))

    def summary(self) -> DataFrame:
        """One row: cells, trace, sum, and the one-, infinity-, Frobenius- and largest-value norms."""
        rows = self.cells.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_inf"))
        columns = self.cells.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_one"))
        flat = self.cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("trace"),
                              F.sum("v").alias("total"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_frobenius"), F.max(F.abs("v")).alias("norm_max"))
        return flat.join(rows, F.lit(True)).join(columns, F.lit(True))  # one row each

    def _same(self, other: Matrix) -> None:
        if (self.rows, self.columns) != (other.rows, other.columns):
            raise ValueError("sizes differ")


def outer(x: DataFrame, y: DataFrame, rows: int, columns: int) -> Matrix:
    """The outer product of two vectors ``i, v``."""
    column = Matrix(x.select("i", F.lit(0).cast("long").alias("j"), "v"), rows, 1)
    return column.kronecker(Matrix(y.select(F.lit(0).cast("long").alias("i"), F.col("i").alias("j"), "v"), 1, columns))


def from_cells(cells: DataFrame, rows: int, columns: int, sum_repeated: bool = True) -> Matrix:
    """A matrix from ``i, j, v``; repeated cells are summed, or an error."""
    grouped = cells.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    if not sum_repeated:
        grouped = grouped.withColumn("v", F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("repeated cell")).cast("double")))
    return Matrix(grouped.select("i", "j", "v"), rows, columns)


def by_rows(cells: DataFrame) -> DataFrame:
    """``i, j, v`` as a written table whose tasks read whole rows, but for very long ones: so products are summed before they are dealt."""
    return cut(cells.select("i", "j", "v").hint("rebalance", "i"))


def may_be_sent(n: int, width: int = 1) -> bool:
    """Whether ``width`` vectors of ``n`` entries are small enough for all tasks."""
    return n * (32 + 8 * width) <= SENT


def assemble(connectivity: DataFrame, stiffness: DataFrame, loads: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sum element matrices and loads into ``i, j, v`` and ``i, v``.

    ``connectivity`` is ``elem, li, dof``, ``stiffness`` ``elem, li, lj, v``, ``loads`` ``elem, li, v``.  An
    element that names a degree of freedom twice is an error.

    An element's degrees of freedom come as one row, so that its matrix is dealt by element alone, if it is not already.
    """
    listed = connectivity.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("li", "dof"))).alias("own"))
    size, different = F.size("own"), lambda of: F.size(F.array_distinct(F.transform("own", lambda x: x[of])))
    checked = F.when(different("dof") == size, F.col("own")).otherwise(F.raise_error(F.lit("an element names a degree of freedom twice")).cast(listed.schema["own"].dataType))
    # Where places are numbered without gaps, from any number, one is found by its number.
    base, last = F.col("own")[0]["li"], F.element_at("own", -1)["li"]
    listed = listed.select("elem", checked.alias("own"), F.when((different("li") == size) & (last - base + 1 == size), base).alias("base"))

    def at(li: str) -> Column:
        far = F.col(li) - F.col("base")
        near = F.when((far >= 0) & (far < F.size("own")), F.array(F.get("own", far.cast("int"))["dof"]))
        return F.when(F.col("base").isNotNull(), near).otherwise(F.transform(F.filter("own", lambda x: x["li"] == F.col(li)), lambda x: x["dof"]))

    rows = stiffness.join(listed, "elem").select(F.explode(at("li")).alias("i"), at("lj").alias("to"), "v")
    cells = rows.select("i", F.explode("to").alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return cells, None if loads is None else loads.join(listed, "elem").select(F.explode(at("li")).alias("i"), "v").groupBy("i").agg(F.sum("v").alias("v"))


def _dot(a: DataFrame, b: DataFrame) -> float:
    return a.select("i", "v").join(b.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def _line(a: DataFrame, *more: tuple[float, DataFrame]) -> DataFrame:
    """a plus multiples of others, as one sum."""
    out = a.select("i", "v")
    for by, x in more:
        out = out.unionByName(x.select("i", (F.col("v") * by).alias("v")))
    return cut(out.groupBy("i").agg(F.sum("v").alias("v")))


def transposed_positions(m: Matrix) -> DataFrame:
    """``i, j, at, to``: the place of each stored cell among all in order of rows, and among all in order of columns, from 0.

    With it, values that are kept in one order are dealt into the other without sorting again.  Cells are different.
    """
    both = m.cells.select(F.struct("i", "j").alias("ij"), F.struct("j", "i").alias("ji"))
    at = renumber(both, "ij").select("old.i", "old.j", F.col("new").alias("at"))
    to = renumber(both, "ji").select("old.i", "old.j", F.col("new").alias("to"))
    return at.join(to, ["i", "j"])


def solve(a: Matrix, b: DataFrame, tolerance: float = 1e-10, max_rounds: int = 1000) -> DataFrame:
    """``i, v`` with a x = b by stabilised bi-conjugate gradients, scaled by the diagonal.

    All vectors are columns of one table, which each of a round's two products extends and writes
    to the shared folder; a round's inner products are two aggregates.  A right side of (nearly) zero
    gives no lines.
    """
    given = written(a.cells)
    scale = replace(a, cells=given).diagonal().select("i", F.when(F.abs("v") > 1e-300, 1.0 / F.col("v")).otherwise(1.0).alias("w"))
    m = Matrix(by_rows(given.join(scale, "i", "left").select("i", "j", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))), a.rows, a.columns)
    every = m.cells.select("i").union(m.cells.select("j")).union(b.select("i")).distinct()
    right = b.join(scale, "i", "left").select("i", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("b"))
    state, (n,) = cut_counted(every.join(right, "i", "left").select("i", F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("r")), F.count(F.lit(1)))
    if given is not a.cells:
        discard(given)
    state, sent = state.select("i", "x", "r", F.col("r").alias("hat"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v")), may_be_sent(n)

    def with_product(of: str, name: str) -> DataFrame:
        made = m.apply(state.select("i", F.col(of).alias("v")), sent).withColumnRenamed("v", "made")
        return cut(state.join(made, "i", "left").withColumn(name, F.coalesce("made", F.lit(0.0))).drop("made"))

    def sums(*pairs: str) -> list[float]:
        return [x or 0.0 for x in state.agg(*(F.sum(F.col(c[0]) * F.col(c[1])) for c in (q.split() for q in pairs))).first()]

    rho, size2 = sums("hat r", "r r")
    if size2 < 1e-300:
        return b.limit(0).select("i", "v")
    beta = omega = 0.0
    done = tolerance * tolerance * size2
    for _ in range(max_rounds):
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v")))
        state = with_product("p", "v")
        lean, left = sums("hat v", "r r")
        if left <= done:
            return state.select("i", F.col("x").alias("v"))
        if lean == 0:
            raise ArithmeticError("the iteration broke down")
        alpha = rho / lean
        state = state.withColumn("s", F.col("r") - alpha * F.col("v"))
        state = with_product("s", "t")
        ts, tt, hs, ht = sums("t s", "t t", "hat s", "hat t")
        omega = ts / tt if tt > 0 else 0.0
        old, rho = rho, hs - omega * ht
        beta = rho / old * alpha / omega if omega else 0.0
        state = state.select("i", (F.col("x") + alpha * F.col("p") + omega * F.col("s")).alias("x"), (F.col("s") - omega * F.col("t")).alias("r"), "hat", "p", "v")
    raise ArithmeticError(f"no solution within {max_rounds} rounds")
