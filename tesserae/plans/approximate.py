"""From labelled images to layer stacks and their scores, all images at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import depth, layers, matching, raster, stamps, stats
from .recipe import Recipe


def approximate(pixels: DataFrame, palette: DataFrame, library: DataFrame, recipe: Recipe) -> DataFrame:
    """doc_id, idx and layer fields for ``pixels`` (image_id, y, x, label), bottom to top.

    ``palette`` has image_id, label, fill; ``library`` has asset_id, rings.
    Faces are laid in depth order, and a stack ends at the recipe's budget.
    """
    if recipe.assets:
        library = library.where(F.col("asset_id").isin(*recipe.assets))
    if recipe.blocked:
        library = library.where(~F.col("asset_id").isin(*recipe.blocked))
    faces = depth.enclosing(stats.region_profile(pixels), pixels)
    order = depth.depth_order(faces, raster.border_lengths(pixels), (float(recipe.canvas), float(recipe.canvas)))
    # with effects, stamps that can carry a gradient are preferred
    best = stamps.recall(stamps.region_features(pixels), stamps.stamp_features(library), recipe.recall, ["gradient_candidate"] if recipe.effects else None)
    laid = stamps.cover_regions(pixels, best, library, recipe.stamps_per_face, recipe.particles, recipe.min_cover)
    if recipe.angles:
        laid = laid.withColumn("angle", layers.nearest_angle(F.col("angle"), list(recipe.angles)))
    ranked = laid.join(order, ["image_id", "label"]).join(palette, ["image_id", "label"])
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("depth", "step")) - 1
    return as_layers(ranked.withColumn("idx", idx).where(F.col("idx") < recipe.max_layers).withColumnRenamed("image_id", "doc_id"))


def as_layers(laid: DataFrame) -> DataFrame:
    """Laid stamps (doc_id, idx, asset_id, pose, fill) with the fields of a layer."""
    return laid.select(
        "doc_id", "idx", F.col("asset_id").alias("asset"), F.lit(1.0).alias("opacity"), "angle", F.lit(False).alias("flipX"),
        F.lit(False).alias("flipY"), "top", "left", "height", "width", "fill", F.lit(True).alias("selectable"),
    )


def coverage_of(stack: DataFrame, pixels: DataFrame, library: DataFrame, size: int) -> DataFrame:
    """doc_id, cover, leak, iou, n_layers and layer simplicity of each stack against its image's subject."""
    drawn = stamps.render_layers(stack, library, size).where(F.col("a") >= 0.5).select("doc_id", "y", "x")
    subject = pixels.where("label >= 0").select(F.col("image_id").alias("doc_id"), "y", "x")
    n = stack.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_layers"))
    return stats.coverage(subject, drawn, ["y", "x"], "doc_id").join(n, "doc_id").withColumn("simplicity", matching.layer_simplicity(F.col("n_layers")))
