"""Aggregates over pixel relations: histograms, colour statistics, ratios, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import gradient

#: A pixel at least this opaque belongs to the subject.
SUBJECT_ALPHA = 0.5


def quantised_histogram(pixels: DataFrame, step: int = 32) -> DataFrame:
    """image_id, key, n: subject colours with ``step`` levels to a bin."""
    q = [F.floor(F.col(c) / step).cast("int") for c in "rgb"]
    n = 1024 // step
    return pixels.where(F.col("alpha") >= SUBJECT_ALPHA).groupBy("image_id", (q[0] * n * n + q[1] * n + q[2]).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def colour_stats(pixels: DataFrame) -> DataFrame:
    """image_id, colours, peak_ratio, grad_frac.

    peak_ratio is the largest bin over the second (1 if there is none);
    grad_frac is the share of subject pixels whose grey step reaches max(70th percentile, 4).
    """
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "key")
    ranked = quantised_histogram(pixels).withColumn("rank", F.row_number().over(order))
    top = ranked.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("colours"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("c2")
    )
    peak = F.col("c1") / F.greatest(F.coalesce("c2", "c1"), F.lit(1)).cast("double")
    grey = gradient(pixels.withColumn("grey", (F.col("r") + F.col("g") + F.col("b")) / 3.0), "grey").where(F.col("alpha") >= SUBJECT_ALPHA)
    cut = grey.groupBy("image_id").agg(F.greatest(F.percentile("gradient", F.lit(0.7)), F.lit(4.0)).alias("cut"))
    share = grey.join(F.broadcast(cut), "image_id").groupBy("image_id").agg(F.avg((F.col("gradient") >= F.col("cut")).cast("double")).alias("grad_frac"))
    return top.select("image_id", "colours", peak.alias("peak_ratio")).join(share, "image_id")


def region_profile(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Per image and label: pixels, fraction of the labelled ones, half-open bbox, centroid."""
    n = F.count(F.lit(1))
    grouped = pixels.where(F.col(label) >= 0).groupBy("image_id", F.col(label).alias("label")).agg(
        n.alias("pixels"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    return grouped.withColumn("fraction", F.col("pixels") / F.sum("pixels").over(Window.partitionBy("image_id")))


def label_ratios(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, subject, gap_frac (subject pixels without a label), soft_frac (.05 < alpha < .95)."""
    subject = F.col("alpha") >= SUBJECT_ALPHA
    return pixels.groupBy("image_id").agg(
        F.count_if(subject).alias("subject"),
        (F.count_if(subject & (F.col(label) < 0)) / F.greatest(F.count_if(subject), F.lit(1))).alias("gap_frac"),
        F.avg(((F.col("alpha") > 0.05) & (F.col("alpha") < 0.95)).cast("double")).alias("soft_frac"),
    )


def coverage(target: DataFrame, union: DataFrame, keys: list[str], by: str) -> DataFrame:
    """cover = |t and u| / |t|, leak = |u not t| / |u|, iou, per ``by``; both sides are sets of ``keys``."""
    t = target.select(by, *keys).distinct().withColumn("t", F.lit(1))
    u = union.select(by, *keys).distinct().withColumn("u", F.lit(1))
    both = t.join(u, [by, *keys], "full").groupBy(by).agg(
        F.count("t").alias("n_target"), F.count("u").alias("n_union"), F.count_if(F.col("t").isNotNull() & F.col("u").isNotNull()).alias("n_both")
    )
    return both.select(
        by, (F.col("n_both") / F.greatest("n_target", F.lit(1))).alias("cover"),
        ((F.col("n_union") - F.col("n_both")) / F.greatest("n_union", F.lit(1))).alias("leak"),
        (F.col("n_both") / F.greatest(F.col("n_target") + F.col("n_union") - F.col("n_both"), F.lit(1))).alias("iou"),
    )


def majority(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each group; of equals the one that is seen first by ``order``."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("v")))
    return counted.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.v").alias(value), (-F.col("best.n")).alias("n"))


def angle_histogram(angles: DataFrame, by: list[str], angle: str, bins: int = 24) -> DataFrame:
    """Share of angles in each of ``bins`` equal parts of [-pi, pi]; the upper end belongs to the last."""
    import math

    part = F.least(F.floor((F.nanvl(F.col(angle), F.lit(None)) + math.pi) / (2 * math.pi / bins)) + 1, F.lit(bins))
    counted = angles.groupBy(*by, part.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def principal_axis(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean, spreads and angle of the principal axis of the points (x, y), from the population covariance."""
    m = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    half = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.pow("vxy", F.lit(2.0)))
    return m.select(
        *by, "mx", "my", ((F.col("vx") + F.col("vy")) / 2 + half).alias("major"), F.greatest((F.col("vx") + F.col("vy")) / 2 - half, F.lit(0.0)).alias("minor"),
        (0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))).alias("angle"),
    )
