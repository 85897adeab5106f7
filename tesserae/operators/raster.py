"""Ordered-neighbour operators on pixel relations.

Row windows run along x inside (image, y), column windows along y inside
(image, x); each costs one shuffle of its image's pixels and none collects an
image into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def along_x() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def gradient(pixels: DataFrame, value: str = "value", out: str = "gradient") -> DataFrame:
    """max(|backward dx|, |backward dy|); the first row and column have no step."""
    v = F.col(value)
    dx = F.abs(v - F.coalesce(F.lag(v).over(along_x()), v))
    dy = F.abs(v - F.coalesce(F.lag(v).over(along_y()), v))
    return pixels.withColumn(out, F.greatest(dx, dy))


def forward_jump(pixels: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Largest step of any column to the right or lower neighbour, kept at the left or upper pixel."""
    steps = [F.abs(F.coalesce(F.lead(c).over(w), F.col(c)) - F.col(c)) for c in columns for w in (along_x(), along_y())]
    return pixels.withColumn(out, F.greatest(*steps))


def visible_boundary(pixels: DataFrame, colour_jump: float = 28.0) -> DataFrame:
    """Pixels where a channel jumps by more than 28, or alpha by more than its own cut-off, and alpha is visible.

    The alpha cut-off is max(.12, .4 times the k-th largest alpha step), k a
    tenth of the image's pixels.
    """
    stepped = forward_jump(forward_jump(pixels, ["r", "g", "b"], "rgb_jump"), ["alpha"], "alpha_jump")
    ranked = stepped.groupBy("image_id", "alpha_jump").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("image_id").orderBy(F.desc("alpha_jump"))
    upto = ranked.select("image_id", "alpha_jump", F.sum("n").over(down).alias("upto"), F.sum("n").over(Window.partitionBy("image_id")).alias("all"))
    kth = upto.where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("all") * 0.1))).groupBy("image_id").agg(F.max("alpha_jump").alias("kth"))
    cut = F.greatest(F.lit(0.12), 0.4 * F.col("kth"))
    return stepped.join(kth, "image_id").withColumn(
        "boundary", ((F.col("rgb_jump") > colour_jump) | (F.col("alpha_jump") > cut)) & (F.col("alpha") > 0.05)
    )


def border_lengths(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, a, b, length: unequal right and lower neighbours by unordered pair of labels."""
    return _pairs(pixels, label).where("a <> b").groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("length"))


def _pairs(pixels: DataFrame, label: str) -> DataFrame:
    right = pixels.select("image_id", F.col(label).alias("p"), F.lead(label).over(along_x()).alias("q"))
    down = pixels.select("image_id", F.col(label).alias("p"), F.lead(label).over(along_y()).alias("q"))
    return right.unionAll(down).where("q IS NOT NULL").select("image_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def degrees(borders: DataFrame) -> DataFrame:
    """Border length of every label, summed over both ends."""
    ends = borders.select("image_id", F.col("a").alias("label"), "length").unionAll(borders.select("image_id", F.col("b").alias("label"), "length"))
    return ends.groupBy("image_id", "label").agg(F.sum("length").alias("degree"))



def dilate(pixels: DataFrame, mask: str = "mask") -> DataFrame:
    """3x3 maximum, one axis after the other."""
    return pixels.withColumn(mask, F.max(mask).over(along_x().rowsBetween(-1, 1))).withColumn(mask, F.max(mask).over(along_y().rowsBetween(-1, 1)))


def erode(pixels: DataFrame, mask: str = "mask") -> DataFrame:
    """3x3 minimum; outside the canvas counts as inside the mask."""
    return pixels.withColumn(mask, F.min(mask).over(along_x().rowsBetween(-1, 1))).withColumn(mask, F.min(mask).over(along_y().rowsBetween(-1, 1)))


def close_open(pixels: DataFrame, mask: str = "mask", close: int = 1, open_: int = 1) -> DataFrame:
    for _ in range(close):
        pixels = erode(dilate(pixels, mask), mask)
    for _ in range(open_):
        pixels = dilate(erode(pixels, mask), mask)
    return pixels


def box_mean(pixels: DataFrame, value: str, rounds: int = 1) -> DataFrame:
    """3x3 mean with the border repeated, ``rounds`` times."""
    v = F.col(value)
    for _ in range(rounds):
        for w in (along_x(), along_y()):
            pixels = pixels.withColumn(value, (F.coalesce(F.lag(v).over(w), v) + v + F.coalesce(F.lead(v).over(w), v)) / 3.0)
    return pixels


def soft_sdf(pixels: DataFrame, mask: str = "mask", rounds: int = 24, out: str = "sdf") -> DataFrame:
    """(0.5 - blurred mask) * 16 * sqrt(rounds / 12): positive outside, negative inside; a blur, not a distance."""
    blurred = box_mean(pixels.withColumn(out, F.col(mask).cast("double")), out, rounds)
    return blurred.withColumn(out, (0.5 - F.col(out)) * 16.0 * (rounds / 12.0) ** 0.5)


def median3(pixels: DataFrame, value: str, out: str) -> DataFrame:
    """Median of the 3x3 neighbours that exist (the lower one of an even number)."""
    row = F.collect_list(value).over(along_x().rowsBetween(-1, 1))
    rows = pixels.withColumn("_row", row)
    every = F.array_sort(F.flatten(F.collect_list("_row").over(along_y().rowsBetween(-1, 1))))
    return rows.withColumn(out, F.element_at(every, F.ceil(F.size(every) / 2).cast("int"))).drop("_row")


def downsample(pixels: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """Box mean of factor x factor cells."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def laplacian(pixels: DataFrame, value: str, out: str) -> DataFrame:
    """5-point Laplacian that wraps around both axes."""
    v = F.col(value)

    def around(w, ends) -> Column:
        whole = ends
        before = F.coalesce(F.lag(v).over(w), F.last(v).over(whole))
        after = F.coalesce(F.lead(v).over(w), F.first(v).over(whole))
        return before + after

    whole_x = along_x().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole_y = along_y().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pixels.withColumn(out, around(along_x(), whole_x) + around(along_y(), whole_y) - 4 * v)


def central_difference(pixels: DataFrame, value: str, out_x: str, out_y: str) -> DataFrame:
    """lead - lag in the interior, 0 at the ends."""
    v = F.col(value)
    dx, dy = (F.coalesce(F.lead(v).over(w) - F.lag(v).over(w), F.lit(0.0)) for w in (along_x(), along_y()))
    return pixels.withColumn(out_x, dx).withColumn(out_y, dy)


def affine_sample(pixels: DataFrame, value: str, height: int, width: int, centre: tuple[float, float], texture_centre: tuple[float, float], scale: float, angle: float) -> DataFrame:
    """image_id, y, x, value: each canvas pixel looked up in a texture that is scaled and turned clockwise about its centre.

    The inverse map of a pixel is a constant expression; its four neighbours
    are joined by place and weighted bilinearly, 0 beyond the texture. These
    are four rows for each canvas pixel, whatever the number of images, and are
    broadcast.
    Centres are (x, y); pixels that see nothing of the texture have no row.
    """
    import math

    spark = pixels.sparkSession
    c, s = math.cos(math.radians(angle)) / scale, math.sin(math.radians(angle)) / scale
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    grid = spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    grid = grid.withColumn("u", dx * c + dy * s + texture_centre[0]).withColumn("v", dy * c - dx * s + texture_centre[1])
    fx, fy = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corners = F.array(*[
        F.struct((F.floor("u") + i).cast("int").alias("tx"), (F.floor("v") + j).cast("int").alias("ty"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for j in (0, 1) for i in (0, 1)
    ])
    taps = grid.select("y", "x", F.explode(corners).alias("t")).select("y", "x", "t.tx", "t.ty", "t.w").where("w > 0")
    texture = pixels.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), F.col(value).alias("tv"))
    return texture.join(F.broadcast(taps), ["ty", "tx"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("w") * F.col("tv")).alias("value"))


def on_grey(pixels: DataFrame, grey: float = 128.0) -> DataFrame:
    """``pixels`` laid over an opaque grey: r, g, b within 0 and 255."""
    a = F.col("alpha")
    return pixels.withColumns({c: F.least(F.greatest(F.col(c) * a + grey * (1.0 - a), F.lit(0.0)), F.lit(255.0)) for c in "rgb"})


def dual_edges(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Unit segments (x0, y0)-(x1, y1) of pixel corners between unequal neighbours and along the canvas frame.

    left_label and right_label are the labels on both sides; the frame has -1 outside
    and is kept only where the pixel is labelled.
    """
    x, y, lab = F.col("x"), F.col("y"), F.col(label)
    right, down, left, up = (f(label).over(w) for w, f in ((along_x(), F.lead), (along_y(), F.lead), (along_x(), F.lag), (along_y(), F.lag)))
    n = pixels.select("image_id", "y", "x", lab.alias("own"), right.alias("right"), down.alias("down"), left.alias("left"), up.alias("up"))

    def segment(when: Column, x0, y0, x1, y1, a: Column, b: Column) -> DataFrame:
        return n.where(when).select("image_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), a.alias("left_label"), b.alias("right_label"))

    own, outside = F.col("own"), F.lit(-1)
    parts = [
        segment(F.col("right").isNotNull() & (own != F.col("right")), x + 1, y, x + 1, y + 1, own, F.col("right")),
        segment(F.col("down").isNotNull() & (own != F.col("down")), x, y + 1, x + 1, y + 1, own, F.col("down")),
        segment(F.col("right").isNull() & (own >= 0), x + 1, y, x + 1, y + 1, own, outside),
        segment(F.col("down").isNull() & (own >= 0), x, y + 1, x + 1, y + 1, own, outside),
        segment(F.col("left").isNull() & (own >= 0), x, y, x, y + 1, outside, own),
        segment(F.col("up").isNull() & (own >= 0), x, y, x + 1, y, outside, own),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
