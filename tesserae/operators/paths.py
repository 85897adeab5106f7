"""Polylines as rows (by, pos, x, y): arc length, resampling, areas, membership."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.arrow_udf(DoubleType())
def libm_atan2(y: pa.Array, x: pa.Array) -> pa.Array:
    """atan2 of the C library, as DuckDB's: Java's is an ulp off for one pair in eight, which counts where angles tie or end a bin."""
    return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist())], pa.float64())


def arc_length(points: DataFrame, by: str, pos: str, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with seg (length from the point before) and arc (running length)."""
    w = Window.partitionBy(by).orderBy(pos)
    seg = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return points.withColumn("seg", seg).withColumn("arc", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resample(points: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """by, k, x, y: n points at equal arc length, interpolated between the two around them.

    Every segment makes the samples that fall on it, so there is no range join.
    """
    w = Window.partitionBy(by).orderBy(pos)
    whole = Window.partitionBy(by)
    arcs = arc_length(points, by, pos).withColumn("total", F.max("arc").over(whole)).withColumn("last", F.lead("arc").over(w).isNull())
    step = F.col("total") / (n - 1)
    arcs = arcs.withColumns({"arc0": F.lag("arc").over(w), "x0": F.lag("x").over(w), "y0": F.lag("y").over(w)})
    # samples k with arc0 < k * step <= arc; the first point makes sample 0, and the last one is never missed by rounding
    first = F.floor(F.col("arc0") / step).cast("int") + 1
    upto = F.when(F.col("last"), F.lit(n - 1)).otherwise(F.floor(F.col("arc") / step).cast("int"))
    made = F.when(F.col("arc0").isNull(), F.when(F.col("last") | (F.col("total") <= 0), F.array(F.lit(0))).otherwise(F.array(F.lit(0)))).when(
        F.col("total") <= 0, F.array().cast("array<int>")
    ).when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<int>"))
    rows = arcs.withColumn("k", F.explode(made))
    t = F.when(F.col("seg") > 0, F.least(F.greatest((F.col("k") * step - F.col("arc0")) / F.col("seg"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    at = lambda c: F.when(F.col("arc0").isNull(), F.col(c)).otherwise(F.col(f"{c}0") + t * (F.col(c) - F.col(f"{c}0")))
    return rows.select(by, "k", at("x").alias("x"), at("y").alias("y"))


def shoelace(points: DataFrame, by: str, pos: str) -> DataFrame:
    """Signed area, perimeter and vertices of the closed ring of each polyline."""
    w = Window.partitionBy(by).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y"))
    rows = points.select(by, (0.5 * (F.col("x") * ny - nx * F.col("y"))).alias("cross"), F.hypot(nx - F.col("x"), ny - F.col("y")).alias("side"))
    return rows.groupBy(by).agg(F.sum("cross").alias("area"), F.sum("side").alias("perimeter"), F.count(F.lit(1)).alias("n"))


def match_area(points: DataFrame, targets: DataFrame, by: str, pos: str, within: float = 0.03, most: float = 0.15) -> DataFrame:
    """by, pos, x, y, scale: each closed ring scaled about the mean of its points until its area is that of ``targets`` (by, target).

    Areas go with the square of the scale, so no search is needed. Rings whose
    area is off by at most ``within`` stay; a scale changes by ``most`` at most.
    """
    facts = shoelace(points, by, pos).select(by, F.abs("area").alias("area"))
    middle = points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    off = F.abs(F.col("area") - F.col("target")) / F.greatest(F.col("target"), F.lit(1e-9))
    wanted = F.least(F.greatest(F.sqrt(F.col("target") / F.greatest(F.col("area"), F.lit(1e-9))), F.lit(1 - most)), F.lit(1 + most))
    scales = targets.join(facts, by).join(middle, by).select(by, "cx", "cy", F.when(off <= within, 1.0).otherwise(wanted).alias("scale"))
    at = lambda c: (F.col(f"c{c}") + F.col("scale") * (F.col(c) - F.col(f"c{c}"))).alias(c)
    return points.join(scales, by).select(by, pos, at("x"), at("y"), "scale")


def turn_angles(points: DataFrame, by: str, pos: str) -> DataFrame:
    """by, pos, turn: the turn at every vertex of the closed ring, wrapped to [-pi, pi] (pi itself by rounding alone)."""
    w = Window.partitionBy(by).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in ("x", "y")]
    after = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y")]
    steps = {"_ay": F.col("y") - before[1], "_ax": F.col("x") - before[0], "_by": after[1] - F.col("y"), "_bx": after[0] - F.col("x")}
    turned = points.withColumns(steps).withColumn("_t", libm_atan2("_by", "_bx") - libm_atan2("_ay", "_ax") + math.pi)
    return turned.select(by, pos, (F.col("_t") - 2 * math.pi * F.floor(F.col("_t") / (2 * math.pi)) - math.pi).alias("turn"))


def subsample(rows: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """At most n rows of each group, evenly by position: rows int(i * (N - 1) / (n - 1)) for i < n."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(pos)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)))
    return ranked.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_k").cast("long"))).drop("_k", "_n")


def points_in_rings(points: DataFrame, rings: DataFrame, by: str) -> DataFrame:
    """id, ring, inside of ``points`` (by, id, px, py) in ``rings`` (by, ring, pos, x, y), by crossings of a ray."""
    w = Window.partitionBy(by, "ring").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = rings.select(by, "ring", "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y")])
    crosses = ((F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))) & (
        F.col("px") < (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("ny") - F.col("y")) + F.col("x")
    )
    return points.join(sides, by).groupBy(by, "id", "ring").agg((F.count_if(crosses) % 2 == 1).alias("inside"))


def drop_repeats(points: DataFrame, by: str, pos: str) -> DataFrame:
    """Without points equal to the one before."""
    w = Window.partitionBy(by).orderBy(pos)
    same = F.col("x").eqNullSafe(F.lag("x").over(w)) & F.col("y").eqNullSafe(F.lag("y").over(w))
    return points.withColumn("_same", same).where("NOT _same").drop("_same")
