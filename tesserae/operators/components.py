"""Connected components of label fields, without an image in a task: runs of a row joined to the runs below, and stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .raster import along_x, along_y


def roots(edges: DataFrame, by: str) -> DataFrame:
    """by, node, root of edges (by, a, b): the smallest node reachable, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # neighbours hang on the smallest one: the larger ones of a node, then the smaller ones and the node itself
        both = e.unionAll(e.select(by, F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy(by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m") if large else F.min("v").alias("m"))
        hung = both.where("v > u" if large else "true").join(least, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v"))
        return (hung if large else hung.unionAll(least.select(by, "u", F.col("m").alias("v")))).where("u > v").distinct()

    e = written(edges.select(by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        done, e = e, written(star(star(e, True), False), "stars")
        discard(done)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(by, "u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select(by, F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, y, x, component of the pixels with a label >= 0: 4-connected ones of equal labels.

    Components are numbered in the row-major order of their first pixel. Shuffles grow with the pixels, rounds with the
    logarithm of the longest chain of runs; an image of any size is spread over many tasks.
    """
    v = F.col(label)
    step = (~v.eqNullSafe(F.lag(v).over(along_x()))) | (F.lag("x").over(along_x()) != F.col("x") - 1)
    place = F.col("y").cast("long") * (1 << 24) + F.col("x")
    marked = pixels.select("image_id", "y", "x", v.alias("v"), F.when(step, place).alias("starts"))
    runs = marked.withColumn("run", F.last("starts", True).over(along_x().rowsBetween(Window.unboundedPreceding, 0))).where("v >= 0").select("image_id", "y", "x", "v", "run")
    runs = written(runs, "runs")
    below = [F.lead(c).over(along_y()) for c in ("run", "v", "y")]
    touching = runs.select("image_id", F.col("run").alias("a"), below[0].alias("b"), (below[1].eqNullSafe(F.col("v")) & (below[2] == F.col("y") + 1)).alias("same")).where("same")
    found = roots(touching.select("image_id", "a", "b").distinct(), "image_id").select("image_id", F.col("node").alias("run"), "root")
    named = runs.select("image_id", "run").distinct().join(found, ["image_id", "run"], "left").withColumn("root", F.coalesce("root", "run"))
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("root")) - 1
    return runs.join(named.select("image_id", "run", number.cast("int").alias("component")), ["image_id", "run"]).select("image_id", "y", "x", "component")
