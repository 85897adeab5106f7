"""From RGB pictures to layer stacks and their scores, all pictures at once: every field of the recipe takes part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.color import rgb_to_hex, rgb_to_lab
from ..operators import components, halfedges, labels, layers, matching, raster, regions, selection, stamps, stats
from ..sources.scratch import written
from .approximate import approximate, as_layers
from .recipe import Recipe

#: Rounds of 3x3 means of each smoothing policy.
SMOOTHING = {"off": 0, "weak": 1, "medium": 2, "strong": 4}


def fit_canvas(pixels: DataFrame, canvas: int, fit: str = "contain") -> DataFrame:
    """Pictures scaled about their centre until they fit into the square canvas (``contain``) or fill it (``cover``).

    A pixel goes to all canvas pixels whose centre it covers, or to the one that
    holds its centre; what meets there is averaged.
    """
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    side = F.greatest("h", "w") if fit == "contain" else F.least("h", "w")
    scaled = pixels.join(size.withColumn("s", F.lit(float(canvas)) / side), "image_id")

    def places(at: str, length: str):
        start = F.col(at) * F.col("s") + (canvas - F.col(length) * F.col("s")) / 2
        low, high = F.ceil(start - 0.5).cast("int"), F.ceil(start + F.col("s") - 0.5).cast("int") - 1
        one = F.array(F.floor(start + F.col("s") / 2).cast("int"))
        return F.when((F.col("s") >= 1) & (low <= high), F.sequence(low, high)).when(F.col("s") < 1, one).otherwise(F.array().cast("array<int>"))

    moved = scaled.withColumn("ty", F.explode(places("y", "h"))).withColumn("tx", F.explode(places("x", "w")))
    inside = moved.where(F.col("ty").between(0, canvas - 1) & F.col("tx").between(0, canvas - 1))
    return inside.groupBy("image_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(*[F.avg(c).alias(c) for c in ("r", "g", "b", "alpha")])


def subject_alpha(pixels: DataFrame, tolerance: float = 28.0) -> DataFrame:
    """``pixels`` whose alpha tells the subject: as it is if any pixel is transparent, else by a flood from the corners in LAB."""
    lab = pixels.select("*", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).select(*pixels.columns, "lab.*")

    def kernel(image: pa.Table) -> pa.Table:
        alpha = image.column("alpha").to_numpy()
        if (alpha >= 0.5).all():
            # the picture may not reach the canvas's edges; its own corners count
            y, x = image.column("y").to_numpy(), image.column("x").to_numpy()
            y, x = y - y.min(), x - x.min()
            grid = np.zeros((y.max() + 1, x.max() + 1, 3))
            grid[y, x] = np.column_stack([image.column(c).to_numpy() for c in ("lab_l", "lab_a", "lab_b")])
            alpha = kernels.flood_background(grid, tolerance)[y, x].astype(float)
        return image.select(["image_id", "y", "x", "r", "g", "b"]).append_column("alpha", pa.array(alpha))

    return lab.groupBy("image_id").applyInArrow(kernel, "image_id string, y int, x int, r double, g double, b double, alpha double")


def faces_of(pixels: DataFrame, recipe: Recipe) -> DataFrame:
    """``pixels`` with label: the faces of the label field, at most ``max_faces`` an image; -1 outside the subject."""
    smooth = pixels
    for c in "rgb":
        smooth = raster.box_mean(smooth, c, SMOOTHING[recipe.smoothing])
    whole = smooth.withColumns({c: F.round(c).cast("int") for c in "rgb"})
    field = regions.kmeans_labels(written(whole, "smooth"), recipe.colours)
    if recipe.boundary == "curve_fit":
        field = labels.smooth_round(field)
    field = field.join(pixels.select("image_id", "y", "x", "alpha"), ["image_id", "y", "x"])
    field = written(regions.clean_labels(field), "field")
    parts = components.components(field).withColumnRenamed("component", "label")
    capped = selection.cap_faces(written(parts, "faces"), recipe.max_faces)
    return pixels.join(capped, ["image_id", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def picture_stacks(pictures: DataFrame, library: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """(faces, stack) of pictures (image_id, y, x, r, g, b, alpha): the canvas pixels with their faces, and the layers over them."""
    canvas = subject_alpha(fit_canvas(pictures, recipe.canvas, recipe.fit))
    faces = written(faces_of(written(canvas, "canvas"), recipe), "faces")
    level = lambda c: F.round(F.avg(c)).cast("int")
    palette = faces.where("label >= 0").groupBy("image_id", "label").agg(rgb_to_hex(level("r"), level("g"), level("b")).alias("fill"))
    stack = written(approximate(faces.select("image_id", "y", "x", "label"), palette, library, recipe), "stack")
    return faces, repair_gaps(stack, faces, library, recipe)


def repair_gaps(stack: DataFrame, faces: DataFrame, library: DataFrame, recipe: Recipe, rounds: int = 2, least: int = 10) -> DataFrame:
    """``stack`` with further layers over what it leaves bare of its faces, in their colours, within the budget of layers.

    A round draws the stack, takes the bare pixels of each face (at least
    ``least`` of them) as a region and covers it by the same search; it ends when nothing is bare or laid.
    """
    features = written(stamps.stamp_features(library), "features")
    level = lambda c: F.round(F.avg(c)).cast("int")
    fills = faces.where("label >= 0").groupBy("image_id", "label").agg(rgb_to_hex(level("r"), level("g"), level("b")).alias("fill"))
    for n in range(rounds):
        drawn = stamps.render_layers(stack, library, recipe.canvas).where("a >= 0.5").select(F.col("doc_id").alias("image_id"), "y", "x").distinct()
        bare = faces.where("label >= 0").select("image_id", "label", "y", "x").join(drawn, ["image_id", "y", "x"], "left_anti")
        enough = bare.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
        bare = written(bare.join(enough, ["image_id", "label"], "left_semi"), "bare")
        if bare.isEmpty():
            break
        # the canvas's last pixel keeps the mask of a region as large as the canvas
        whole = faces.select("image_id", "y", "x").join(bare.withColumnRenamed("label", "bare"), ["image_id", "y", "x"], "left").withColumn("label", F.coalesce("bare", F.lit(-1)))
        best = stamps.recall(stamps.region_features(whole), features, recipe.recall)
        laid = stamps.cover_regions(whole, best, library, 2, max(8, recipe.particles // 3), recipe.min_cover, seed=n + 1)
        if recipe.angles:
            laid = laid.withColumn("angle", layers.nearest_angle(F.col("angle"), list(recipe.angles)))
        highest = stack.groupBy("doc_id").agg((F.max("idx") + 1).alias("first"))
        added = laid.join(fills, ["image_id", "label"]).withColumnRenamed("image_id", "doc_id").join(highest, "doc_id", "left")
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("label", "step")) - 1 + F.coalesce("first", F.lit(0))
        added = as_layers(added.withColumn("idx", place).where(F.col("idx") < recipe.max_layers))
        before, stack = stack.count(), written(stack.unionByName(added), "repaired")
        if stack.count() == before:
            break
    return stack


def score_stacks(stack: DataFrame, faces: DataFrame, library: DataFrame, canvas: int, gates: tuple[float, float, float] = matching.RECIPE_GATES) -> DataFrame:
    """doc_id, n_layers, cover, leak, iou, colour_error, edge, similarity, overall, passed of each stack against its picture.

    colour_error is the mean absolute difference over the subject, both laid
    over grey; edge falls with the Chamfer distance of both outlines and also
    stands for the quality of the lines. Pictures without a layer have no row.
    """
    drawn = written(stamps.render_layers(stack, library, canvas).where((F.col("y") >= 0) & (F.col("x") >= 0)), "drawn")
    flat = layers.over_fold(drawn, ["doc_id", "y", "x"], "idx", "a", ["r", "g", "b"])
    mask = flat.where("alpha >= 0.5").select("doc_id", "y", "x")
    subject = faces.where("label >= 0").select(F.col("image_id").alias("doc_id"), "y", "x")
    cover = stats.coverage(subject, mask, ["y", "x"], "doc_id")
    seen = flat.select("doc_id", "y", "x", *[(F.col(c) + 128.0 * (1.0 - F.col("alpha"))).alias(f"d{c}") for c in "rgb"])
    real = raster.on_grey(faces.where("label >= 0")).select(F.col("image_id").alias("doc_id"), "y", "x", "r", "g", "b")
    both = real.join(seen, ["doc_id", "y", "x"], "left")
    gap = sum((F.abs(F.col(c) - F.coalesce(f"d{c}", F.lit(128.0))) for c in "rgb"), F.lit(0.0)) / 3.0
    error = both.groupBy("doc_id").agg(F.avg(gap).alias("colour_error"))

    def outline(points: DataFrame) -> DataFrame:
        edges = halfedges.half_edges(_filled(points, canvas))
        corners = edges.select(F.col("image_id").alias("doc_id"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")).distinct()
        return written(corners.withColumn("id", F.col("y").cast("long") * (canvas + 1) + F.col("x").cast("long")), "outline")

    chamfer = matching.chamfer(outline(mask), outline(subject), "doc_id", 4.0)
    n = stack.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_layers"))
    scored = n.join(cover, "doc_id").join(error, "doc_id").join(chamfer, "doc_id", "left").withColumn("edge", F.coalesce(matching.boundary_score(F.col("chamfer")), F.lit(0.0)))
    similarity = matching.similarity(F.col("iou"), F.col("colour_error"), F.col("edge"), F.col("cover"))
    scored = scored.withColumn("similarity", similarity)
    scored = scored.withColumn("overall", matching.final_score(F.col("similarity"), F.col("edge"), F.col("n_layers"), F.col("cover") <= 0))
    passed = matching.passed(F.col("similarity"), F.col("edge"), F.col("overall"), F.col("n_layers"), F.col("cover") <= 0, gates)
    return scored.select("doc_id", "n_layers", "cover", "leak", "iou", "colour_error", "edge", "similarity", "overall", passed.alias("passed"))


def _filled(points: DataFrame, canvas: int) -> DataFrame:
    """Points of a mask as a whole canvas with label 0 on them and -1 elsewhere, so that neighbours stand side by side."""
    spark = points.sparkSession
    grid = spark.range(canvas * canvas).select((F.col("id") / canvas).cast("int").alias("y"), (F.col("id") % canvas).cast("int").alias("x"))
    each = points.select("doc_id").distinct().join(F.broadcast(grid))  # as many rows as a canvas has pixels
    marked = each.join(points.withColumn("on", F.lit(0)), ["doc_id", "y", "x"], "left")
    return marked.select(F.col("doc_id").alias("image_id"), "y", "x", F.coalesce("on", F.lit(-1)).alias("label"))
