import pytest
from pyspark.sql import functions as F

from tesserae.operators import stamps
from tesserae.plans.approximate import approximate, coverage_of
from tesserae.plans.recipe import recipe
from tesserae.sources import rasters
from tesserae.streaming.watch import watch


def test_recipes():
    pixel = recipe("pixel")
    assert pixel.assets == ("Square",) and pixel.angles == (0.0, 90.0) and not pixel.effects
    assert recipe("logo", colours=3).colours == 3 and recipe("logo").colours == 6
    with pytest.raises(ValueError):
        recipe("logo", max_layers=41)


def test_images_to_layers(spark):
    px = rasters.formula_rasters(spark, {k: rasters.FORMULAS[k] for k in ("split64", "disk64")})
    palette = px.where("label >= 0").select("image_id", "label").distinct().withColumn("fill", F.lit("#112233"))
    library = stamps.stamp_table(spark)
    stack = spark.createDataFrame(approximate(px, palette, library, recipe("logo", canvas=64, recall=3, particles=8)).collect())
    got = {r.doc_id: r for r in coverage_of(stack, px, library, 64).collect()}
    assert set(got) == {"split64", "disk64"} and all(r.cover > 0.8 and r.n_layers <= 40 for r in got.values())
    square = approximate(px, palette, library, recipe("pixel", canvas=64, recall=3, particles=8)).collect()
    assert {r.asset for r in square} == {"Square"} and {r.angle for r in square} <= {0.0, 90.0}


def test_stream_of_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"asset":"Line","top":1,"left":2,"height":3,"width":4,"fill":"#abc"},{"asset":"Line"}]')
    for _ in range(2):  # the second run finds nothing new
        watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.doc_id, r.n_layers, r.problems) for r in row] == [("a", 2, 1)]
