"""Pixel relations: formula rasters, rasters read out of vectors, image tables.

A pixel relation has image_id, y, x and any of r, g, b, alpha, label; label -1
is background. It is keyed by image_id everywhere, so any number of images is
one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXEL = T.StructType(
    [T.StructField("image_id", T.StringType(), False), T.StructField("y", T.IntegerType(), False), T.StructField("x", T.IntegerType(), False)]
    + [T.StructField(c, T.ShortType()) for c in "rgb"]
    + [T.StructField("alpha", T.DoubleType()), T.StructField("label", T.IntegerType())]
)

#: Height, width and label of the formula rasters, in SQL over y and x.
FORMULAS: dict[str, tuple[int, int, str]] = {
    "split64": (64, 64, "CASE WHEN x < 32 THEN 0 ELSE 1 END"),
    "quad48": (48, 48, "CASE WHEN y < 24 THEN CASE WHEN x < 24 THEN 0 ELSE 1 END ELSE CASE WHEN x < 24 THEN 2 ELSE 3 END END"),
    "disk64": (64, 64, "CASE WHEN (x-32)*(x-32)+(y-32)*(y-32) <= 400 THEN 0 ELSE -1 END"),
    "disk160": (160, 160, "CASE WHEN (x-80)*(x-80)+(y-80)*(y-80) <= 2025 THEN 0 ELSE -1 END"),
    "diskbg64": (64, 64, "CASE WHEN (x-32)*(x-32)+(y-32)*(y-32) <= 419 THEN 1 ELSE 0 END"),
    "ring96": (96, 96, "CASE WHEN (x-48)*(x-48)+(y-48)*(y-48) BETWEEN 256 AND 1296 THEN 0 ELSE -1 END"),
    "ring128": (128, 128, "CASE WHEN (x-64)*(x-64)+(y-64)*(y-64) BETWEEN 325 AND 2025 THEN 0 ELSE -1 END"),
    "ell48": (48, 48, "CASE WHEN y >= 12 AND y < 32 AND x >= 16 AND x < 32 THEN 1 WHEN x < 16 OR y >= 32 THEN 0 ELSE -1 END"),
}


def formula_raster(spark: SparkSession, name: str, formulas: dict[str, tuple[int, int, str]] = FORMULAS) -> DataFrame:
    h, w, label = formulas[name]
    grid = spark.range(h * w).select(F.expr(f"CAST(id DIV {w} AS INT)").alias("y"), F.expr(f"CAST(id % {w} AS INT)").alias("x"))
    return grid.select(F.lit(name).alias("image_id"), "y", "x", F.expr(f"CAST({label} AS INT)").alias("label"))


def formula_rasters(spark: SparkSession, formulas: dict[str, tuple[int, int, str]] = FORMULAS) -> DataFrame:
    return reduce(DataFrame.unionByName, (formula_raster(spark, n, formulas) for n in formulas))


def formula_sql(formulas: dict[str, tuple[int, int, str]] = FORMULAS) -> str:
    """The same rasters as one DuckDB query."""
    each = [
        f"SELECT '{n}' AS image_id, CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x FROM range({h * w}) t(i)" for n, (h, w, _) in formulas.items()
    ]
    cases = " ".join(f"WHEN image_id = '{n}' THEN ({label})" for n, (_, _, label) in formulas.items())
    return f"SELECT image_id, y, x, CAST(CASE {cases} END AS INT) AS label FROM ({' UNION ALL '.join(each)})"


def vector_pixels(vectors: DataFrame, image_id: str = "emb") -> DataFrame:
    """Vectors as a grey raster: y = vec_id, x = element position, value = element."""
    return vectors.select(F.lit(image_id).alias("image_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).select(
        "image_id", "y", "x", F.col("v").cast("double").alias("value")
    )


VECTOR_PIXELS_SQL = (
    "SELECT 'emb' AS image_id, CAST(vec_id AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS value "
    "FROM embeddings, range(1, 65) t(i)"
)


def vector_rgb(vectors: DataFrame, image_id: str = "emb") -> DataFrame:
    """Consecutive triples of a vector as colours of one row, 21 pixels wide, all subject."""

    def channel(c: int):
        e = F.element_at("embedding", F.col("x") * 3 + c + 1).cast("double")
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e + 0.5) * 255))).cast("int")

    at = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    return at.select(
        F.lit(image_id).alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x",
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.lit(1.0).alias("alpha"),
    )


VECTOR_RGB_SQL = "SELECT 'emb' AS image_id, CAST(vec_id AS INT) AS y, CAST(t.x AS INT) AS x, " + ", ".join(
    f"CAST(greatest(0, least(255, floor((CAST(embedding[t.x * 3 + {k + 1}] AS DOUBLE) + 0.5) * 255))) AS INT) AS {c}" for k, c in enumerate("rgb")
) + ", 1.0::DOUBLE AS alpha FROM embeddings, range(0, 21) t(x)"


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel relation stored as Parquet, columns and rows pruned at the scan."""
    return spark.read.schema(PIXEL).parquet(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Range-sorted by image, so that a scan of some images skips the row groups of others."""
    pixels.repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(path)
