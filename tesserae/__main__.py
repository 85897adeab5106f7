"""Command line: python -m tesserae approx | render | score | validate | prefit."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layers, stamps
from .plans import pictures
from .plans.recipe import PRESETS, recipe
from .sources import documents, png


def _drawn(stack: DataFrame, library: DataFrame, size: int) -> DataFrame:
    """image_id, y, x, r, g, b, alpha of rendered stacks, colours not premultiplied."""
    flat = layers.over_fold(stamps.render_layers(stack, library, size), ["doc_id", "y", "x"], "idx", "a", ["r", "g", "b"])
    return flat.select(F.col("doc_id").alias("image_id"), "y", "x", *[(F.col(c) / F.col("alpha")).alias(c) for c in "rgb"], "alpha")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("command", choices=["approx", "render", "score", "validate", "prefit"])
    p.add_argument("--pictures", help="folder of PNG files (approx, score)")
    p.add_argument("--documents", help="folder of layer documents (render, score, validate)")
    p.add_argument("--out", help="folder of what is made")
    p.add_argument("--mode", default="illustration", choices=sorted(PRESETS))
    p.add_argument("--canvas", type=int)
    p.add_argument("--particles", type=int)
    p.add_argument("--recall", type=int)
    p.add_argument("--max-layers", type=int)
    o = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tesserae").getOrCreate()
    asked = {k: v for k, v in (("canvas", o.canvas), ("particles", o.particles), ("recall", o.recall), ("max_layers", o.max_layers)) if v}
    run, library = recipe(o.mode, **asked), stamps.stamp_table(spark)
    needed = {"approx": ("pictures", "out"), "render": ("documents", "out"), "score": ("documents", "pictures"), "validate": ("documents",), "prefit": ("out",)}
    if missing := [n for n in needed[o.command] if not getattr(o, n)]:
        p.error(f"{o.command} needs --{' and --'.join(missing)}")
    if o.command == "prefit":
        rows = documents.build_incrementally(spark, library, o.out, stamps.stamp_features)
        print(f"{rows.count()} stamps in the store")
        return 0
    if o.command == "approx":
        faces, stack = pictures.picture_stacks(png.read_pictures(spark, o.pictures), library, run)
        n = png.write_files(documents.document_bodies(stack), "doc_id", "body", o.out, ".json")
        png.write_files(png.pictures(_drawn(stack, library, run.canvas)), "image_id", "content", o.out, ".preview.png")
        pictures.score_stacks(stack, faces, library, run.canvas).orderBy("doc_id").show(1000, False)
        print(f"{n} documents written")
        return 0
    read = documents.read_documents(spark, o.documents)
    problems = read.where("problem IS NOT NULL")
    if o.command == "validate":
        problems.select("doc_id", "idx", "problem").orderBy("doc_id", "idx").show(1000, False)
        return 1 if problems.limit(1).count() else 0
    stack = documents.resolve_assets(read.where("problem IS NULL"), library).where("asset_id IS NOT NULL").withColumn("asset", F.col("asset_id")).drop("asset_id", "problem")
    if o.command == "render":
        print(f"{png.write_files(png.pictures(_drawn(stack, library, run.canvas)), 'image_id', 'content', o.out, '.png')} pictures written")
        return 0
    faces = pictures.subject_alpha(pictures.fit_canvas(png.read_pictures(spark, o.pictures), run.canvas, run.fit))
    faces = faces.withColumn("label", F.when(F.col("alpha") >= 0.5, 0).otherwise(-1))
    pictures.score_stacks(stack, faces, library, run.canvas).orderBy("doc_id").show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
