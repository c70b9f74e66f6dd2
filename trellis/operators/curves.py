"""Closed polygons as tables ``loop, seq, x, y``: their edges, measures, direction and refinement.

Each loop is a group of its own; loops are dealt over tasks and their points are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Shorter edges count as none; an edge up to this much longer than its aim stays whole (fixed values).
NONE, SLACK = 1e-12, 1.01


def _along() -> WindowSpec:
    return Window.partitionBy("loop").orderBy("seq")


def _whole() -> WindowSpec:
    return _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def edges(loops: DataFrame) -> DataFrame:
    """``loop, seq, x, y, bx, by, length``: each point and the next one; the last is followed by the first."""
    nxt = lambda c: F.coalesce(F.lead(c).over(_along()), F.first(c).over(_whole()))
    ends = loops.select("loop", "seq", "x", "y", nxt("x").alias("bx"), nxt("y").alias("by"))
    return ends.withColumn("length", F.sqrt((F.col("bx") - F.col("x")) ** 2 + (F.col("by") - F.col("y")) ** 2))


def measures(loops: DataFrame) -> DataFrame:
    """One row a loop: ``points``, ``around`` (length), ``mean_edge``, its box, the mean of its points (``cx, cy``), signed ``area``."""
    turned = F.sum(F.col("x") * F.col("by") - F.col("bx") * F.col("y")) / 2
    low, high = ([f(c).alias(f"{c}_{n}") for c in "xy"] for f, n in ((F.min, "low"), (F.max, "high")))
    return edges(loops).groupBy("loop").agg(
        F.count("*").alias("points"), F.sum("length").alias("around"), F.avg("length").alias("mean_edge"), *low, *high, F.avg("x").alias("cx"), F.avg("y").alias("cy"), turned.alias("area"))


def oriented(loops: DataFrame, counter_clockwise: bool = True) -> DataFrame:
    """``loop, seq, x, y`` with ``seq`` from 0, turned round where a loop runs the other way; loops without area stay as they are."""
    step = F.col("x") * F.col("by") - F.col("bx") * F.col("y")
    placed = edges(loops).select("loop", "x", "y", (F.row_number().over(_along()) - 1).alias("seq"), F.sum(step).over(_whole()).alias("area"), F.count("*").over(_whole()).alias("n"))
    wrong = F.col("area") < 0 if counter_clockwise else F.col("area") > 0
    return placed.select("loop", F.when(wrong, F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq")).cast("long").alias("seq"), "x", "y")


def refined(loops: DataFrame, ratio: float = 2.0, least: int = 200) -> DataFrame:
    """``loop, seq, x, y``: long edges cut into equal parts, as near as whole numbers allow to the aim.

    The aim is the smaller of a loop's length over ``least`` and ``ratio`` times its shortest edge.
    Loops of fewer than three points or without length stay, with ``seq`` from 0; edges without length stay whole.
    """
    near = edges(loops).withColumns({
        "n": F.count("*").over(_whole()), "around": F.sum("length").over(_whole()),
        "shortest": F.min(F.when(F.col("length") > NONE, F.col("length"))).over(_whole())})
    aim = F.least(F.col("around") / least, F.col("shortest") * ratio)
    cut = (F.col("n") >= 3) & (F.col("around") >= NONE) & (F.col("length") >= NONE) & (F.col("length") > aim * SLACK)
    # Halves go to the even number.
    parts = F.when(cut, F.greatest(F.lit(1), F.bround(F.col("length") / aim).cast("long"))).otherwise(F.lit(1)).cast("long")
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    split = near.withColumn("parts", parts).withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    each = split.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = F.col("k") / F.col("parts")
    return each.select("loop", (F.col("start") + F.col("k")).alias("seq"), (F.col("x") + at * (F.col("bx") - F.col("x"))).alias("x"), (F.col("y") + at * (F.col("by") - F.col("y"))).alias("y"))
