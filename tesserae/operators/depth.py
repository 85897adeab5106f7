"""Painter depth of regions and the role of their shared edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import degrees


def depth_order(faces: DataFrame, borders: DataFrame, size: tuple[float, float]) -> DataFrame:
    """image_id, label, score, depth of ``faces`` (image_id, label, pixels, cx, cy, enclosing).

    score = .45 area/max + .25 degree/max + .15 exp(-2.5 r^2) + .15/(1 + enclosing); r from the canvas centre in
    canvas sizes; borders with the background do not count; the highest score is depth 0, at the bottom, ties by label.
    """
    h, w = size
    image = Window.partitionBy("image_id")
    joined = faces.join(degrees(borders.where("a >= 0 AND b >= 0")), ["image_id", "label"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    dx, dy = (F.col("cx") - w / 2) / w, (F.col("cy") - h / 2) / h
    score = (
        0.45 * F.col("pixels") / F.max("pixels").over(image) + 0.25 * F.col("degree") / F.greatest(F.max("degree").over(image), F.lit(1))
        + 0.15 * F.exp(-2.5 * (dx * dx + dy * dy)) + 0.15 / (1 + F.col("enclosing"))
    )
    scored = joined.withColumn("score", score)
    return scored.select("image_id", "label", "score", (F.row_number().over(image.orderBy(F.desc("score"), "label")) - 1).alias("depth"))


def _centre() -> list:
    """The pixel that holds the centroid, halves rounded up."""
    return [F.floor(F.col(c) + 0.5).cast("int").alias(out) for c, out in (("cx", "x"), ("cy", "y"))]


def enclosing(faces: DataFrame, pixels: DataFrame, label: str = "label") -> DataFrame:
    """``faces`` with enclosing: how many larger faces hold the rounded centroid (an equi-join on the pixel)."""
    at = faces.select("image_id", "label", "pixels", *_centre())
    hit = at.join(pixels.select("image_id", "y", "x", F.col(label).alias("under")), ["image_id", "y", "x"]).where("under <> label AND under >= 0")
    area = faces.select("image_id", F.col("label").alias("under"), F.col("pixels").alias("under_pixels"))
    inside = hit.join(area, ["image_id", "under"]).where(F.col("under_pixels") * 0.95 > F.col("pixels")).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("enclosing"))
    return faces.join(inside, ["image_id", "label"], "left").withColumn("enclosing", F.coalesce("enclosing", F.lit(0)))


def edge_roles(borders: DataFrame, depth: DataFrame, faces: DataFrame, pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, a, b, role: OCCLUSION_CUT if the upper face's centroid lies in the lower, larger one; else SHAPE."""
    at = faces.select("image_id", F.col("label"), "pixels", *_centre())
    under = at.join(pixels.select("image_id", "y", "x", F.col(label).alias("under")), ["image_id", "y", "x"], "left")
    info = under.join(depth.select("image_id", "label", "depth"), ["image_id", "label"]).select("image_id", "label", F.struct("label", "depth", "pixels", "under").alias("f"))
    both = borders.join(info.withColumnsRenamed({"label": "a", "f": "fa"}), ["image_id", "a"], "left").join(info.withColumnsRenamed({"label": "b", "f": "fb"}), ["image_id", "b"], "left")
    upper = F.when(F.col("fa.depth") > F.col("fb.depth"), F.col("fa")).otherwise(F.col("fb"))
    lower = F.when(F.col("fa.depth") > F.col("fb.depth"), F.col("fb")).otherwise(F.col("fa"))
    cut = (upper["under"] == lower["label"]) & (upper["pixels"] < 0.95 * lower["pixels"])
    role = F.when((F.col("a") >= 0) & cut, "OCCLUSION_CUT").otherwise("SHAPE")
    return both.select("image_id", "a", "b", "length", role.alias("role"))
