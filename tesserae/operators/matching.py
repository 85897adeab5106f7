"""Distances between point sets, retrieval by features, scores of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def nearest_points(a: DataFrame, b: DataFrame, by: str, cell: float) -> DataFrame:
    """by, id, d: distance from every point of ``a`` (by, id, x, y) to the nearest of ``b`` within its set.

    Points are hashed to a grid and looked for in rings of cells of growing
    width, so that no set is crossed with itself: a round joins by cell, is
    written once, and only points with nothing near go on to the next.
    """
    import math

    todo, out = written(a.select(by, "id", "x", "y"), "points"), None
    extent = a.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    other = b.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    reach = 2 * max([v for v in (*extent, *other) if v is not None], default=0.0) * math.sqrt(2) + cell
    size = cell
    while True:
        last = size > reach
        offsets = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        cells = todo.select("*", F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j"))
        cells = cells.withColumn("di", F.explode(offsets)).withColumn("dj", F.explode(offsets))
        cells = cells.select(by, "id", "x", "y", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
        far = b.select(by, F.col("x").alias("bx"), F.col("y").alias("by_"), F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j"))
        d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by_"))
        found = cells.join(far, [by, "i", "j"]).groupBy(by, "id").agg(F.min(d).alias("d"))
        # within one cell width nothing nearer can lie outside the ring
        sure = written(found if last else found.where(F.col("d") <= size), "near")
        out = sure if out is None else out.unionAll(sure)
        before, todo = todo, written(todo.join(sure.select(by, "id"), [by, "id"], "left_anti"), "points")
        discard(before)
        if last or todo.isEmpty():
            discard(todo)
            return out
        size *= 4


#: Distance from which the robust form of the Chamfer distance grows in a line.
HUBER = 8.0


def chamfer(a: DataFrame, b: DataFrame, by: str, cell: float, mode: str = "mean") -> DataFrame:
    """by, chamfer: half the sum (``mean``) or the sum (``sum``) of both sides' mean nearest distances; ``huber``: the sum of their Huber losses."""
    scale = {"mean": 0.5, "sum": 1.0, "huber": 1.0}[mode]
    d = F.col("d")
    if mode == "huber":
        d = F.when(d < HUBER, 0.5 * d * d / HUBER).otherwise(d - 0.5 * HUBER)
    one = nearest_points(a, b, by, cell).groupBy(by).agg(F.avg(d).alias("ab"))
    two = nearest_points(b, a, by, cell).groupBy(by).agg(F.avg(d).alias("ba"))
    return one.join(two, by).select(by, (scale * (F.col("ab") + F.col("ba"))).alias("chamfer"))


def seam_p95(a: DataFrame, b: DataFrame, by: str, cell: float) -> DataFrame:
    return nearest_points(a, b, by, cell).groupBy(by).agg(F.percentile("d", F.lit(0.95)).alias("seam_p95"))


def uncovered(a: DataFrame, b: DataFrame, by: str, cell: float, threshold: float, least: int = 4) -> DataFrame:
    """Points of ``a`` farther than ``threshold`` from ``b``; if too few, the farthest max(least, min(n, 24))."""
    d = nearest_points(a, b, by, cell)
    counts = d.groupBy(by).agg(F.count_if(F.col("d") > threshold).alias("far"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("d"), "id"))
    ranked = d.join(counts, by).withColumn("rank", rank)
    fallback = F.greatest(F.lit(least), F.least(F.col("n"), F.lit(24)))
    keep = F.when(F.col("far") >= least, F.col("d") > threshold).otherwise(F.col("rank") <= fallback)
    return ranked.where(keep).select(by, "id", "d")


def descriptor_distance(a: Column, b: Column) -> Column:
    """Euclidean distance on the common prefix plus 0.15 for each element that only one has."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)) + 0.15 * F.abs(F.size(a) - F.size(b))


def recall_score(d: Column, circ_gap: Column, elong_a: Column, elong_b: Column) -> Column:
    return F.exp(-d) + F.exp(-0.35 * F.abs(circ_gap)) + F.exp(-0.25 * F.abs(F.ln(elong_a) - F.ln(elong_b)))


def adjusted_recall(
    score: Column, complexity: Column, area_frac: Column, holes: Column, tagged: Column, region_simplicity: Column, region_area: Column, wants_holes: Column
) -> Column:
    """A recall score with what a region asks for beyond its outline.

    Fixed values: 1.35 for a wanted tag; 1.25 or .75 for a stamp with holes where the region wants holes or wants none
    (null: either); exp(-2.2 simplicity complexity); for simple regions (over .55) of some size (over .04) exp(-|fill - .75| simplicity).
    """
    hollow = holes > 0
    out = score * F.when(tagged, 1.35).otherwise(1.0)
    out = out * F.when(wants_holes & hollow, 1.25).when(~wants_holes & hollow, 0.75).otherwise(1.0)
    out = out * F.exp(-2.2 * region_simplicity * complexity)
    plain = (region_simplicity > 0.55) & (region_area > 0.04)
    return out * F.when(plain, F.exp(-F.abs(area_frac - 0.75) * region_simplicity)).otherwise(1.0)


def plain_stamp_score(circ: Column, elong: Column, stamp_circ: Column, stamp_elong: Column, complexity: Column, area_frac: Column, holes: Column) -> Column:
    """How well a stamp of low complexity stands in for a region of this circularity and elongation."""
    one = lambda c: F.greatest(c, F.lit(1.0))
    stretch = F.abs(F.ln(one(stamp_elong) + 1e-6) - F.ln(one(elong) + 1e-6))
    return F.exp(-2.0 * F.abs(stamp_circ - circ)) + F.exp(-1.5 * stretch) + F.exp(-3.0 * complexity) + 0.5 * area_frac + F.when(holes == 0, 0.4).otherwise(0.0)


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group with their rank, the smallest ``tie`` first among equals."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def complexity(circularity: Column, holes: Column, elongation: Column, descriptor_std: Column, area_frac: Column) -> Column:
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    fill = F.least(F.greatest(1 - 2 * F.abs(area_frac - 0.55), F.lit(0.0)), F.lit(0.5))
    import math

    return one(
        0.40 * (1 - F.least(circularity, F.lit(1.0))) + 0.25 * F.least(holes / 4.0, F.lit(1.0)) + 0.15 * one(F.ln(elongation) / math.log(6))
        + 0.15 * one(4 * descriptor_std) + 0.05 * 0.5 * one(fill)
    )


def simplicity(circularity: Column, elongation: Column, fill: Column, area: Column) -> Column:
    import math

    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return one(0.45 * F.least(circularity, F.lit(1.0)) + 0.30 * fill + 0.15 * (1 - one(F.ln(elongation) / math.log(4))) + 0.10 * one(8 * area))


def layer_simplicity(n: Column, most: int = 40) -> Column:
    return F.exp(-0.8 * n / float(most))


def pose_score(chamfer_px: Column, cover: Column, iou: Column, out: Column, area_ratio: Column) -> Column:
    ar = F.least(F.greatest(area_ratio, F.lit(0.02)), F.lit(50.0))
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return (
        0.50 * F.exp(-chamfer_px / 12) + 0.28 * cover + 0.18 * iou - 0.40 * out + 0.03 * F.ln(clip(ar, 0.2, 4.0))
        - 0.55 * out * clip(F.ln(F.greatest(ar, F.lit(1.0))), 0.0, 4.0) - 0.25 * (1 - cover) * out
    )


def boundary_score(chamfer_px: Column) -> Column:
    return F.exp(-chamfer_px / 14.0)


def similarity(iou: Column, weighted_error: Column, edge: Column, cover: Column) -> Column:
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.30 * iou + 0.35 * one(1 - weighted_error / 55.0) + 0.25 * edge + 0.10 * cover


def final_score(sim: Column, line: Column, n_layers: Column, hard_fail: Column, line_gate: float = 0.60) -> Column:
    """sim * line * (.55 + .45 layer simplicity), at most .35 after a hard fail or below the line gate."""
    overall = sim * line * (0.55 + 0.45 * layer_simplicity(n_layers))
    return F.when(hard_fail | (line < line_gate), F.least(overall, F.lit(0.35))).otherwise(overall)


def passed(sim: Column, line: Column, overall: Column, n_layers: Column, hard_fail: Column, gates: tuple[float, float, float]) -> Column:
    return (sim >= gates[0]) & (line >= gates[1]) & (overall >= gates[2]) & (n_layers <= 40) & ~hard_fail


#: Gates of similarity, line and overall score: of the scorer and of the recipe.
SCORER_GATES, RECIPE_GATES = (0.55, 0.60, 0.50), (0.50, 0.55, 0.48)
