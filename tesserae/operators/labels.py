"""Label fields: nearest palette colours, Lloyd steps, clean-up of small regions and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import rgb_to_lab

#: A palette of at most this many colours becomes a literal of the expression.
LITERAL_COLOURS = 256


def assign_palette(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """label = index of the nearest palette colour in LAB, the lower one of equals; -1 outside the subject.

    The palette is a literal, so this is one projection and no join.
    """
    if len(palette) > LITERAL_COLOURS:
        raise ValueError("use nearest_centroid for large palettes")
    lab = pixels.withColumn("_lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    colours = F.array(*[rgb_to_lab(F.lit(r), F.lit(g), F.lit(b)) for r, g, b in palette])
    distance = F.transform(colours, lambda c, i: F.struct(
        sum((F.pow(F.col("_lab")[k] - c[k], F.lit(2.0)) for k in ("lab_l", "lab_a", "lab_b")), F.lit(0.0)).alias("d"), i.alias("i")
    ))
    nearest = F.array_min(distance)["i"]
    return lab.withColumn("label", F.when(F.col("alpha") >= 0.5, nearest).otherwise(-1).cast("int")).drop("_lab")


def centroids(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector and size of every cluster, aggregated map-side by (cluster, element)."""
    each = points.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("pos", "v"))
    mean = each.groupBy("cluster", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def nearest_centroid(points: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """key, cluster, distance: the nearest centre, the smallest cluster of equals.

    There are at most a few hundred clusters (the palette bound), so all centres are one broadcast row.
    """
    row = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    joined = points.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v")).crossJoin(F.broadcast(row))
    squares = lambda c: F.aggregate(F.zip_with("v", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("centres", lambda c: F.struct(squares(c).alias("d"), c["cluster"].alias("cluster"))))
    return joined.select(key, best.alias("best")).select(key, F.col("best.cluster").alias("cluster"), F.sqrt("best.d").alias("distance"))


def palette_table(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """image_id, label, hex, fraction of the subject, by the labels that occur, largest first (rank)."""
    from ..functions.color import rgb_to_hex

    hexes = F.array(*[rgb_to_hex(F.lit(r), F.lit(g), F.lit(b)) for r, g, b in palette])
    n = pixels.where("label >= 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "label")) - 1
    return n.select("image_id", "label", F.get(hexes, F.col("label")).alias("hex"), (F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))).alias("fraction"), rank.alias("rank"))


def neighbour_votes(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, own label, and each labelled 4-neighbour's label with its place (up, down, left, right)."""
    along_x, along_y = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), f("label").over(w).alias("label")) for k, (f, w) in enumerate(((F.lag, along_y), (F.lead, along_y), (F.lag, along_x), (F.lead, along_x)))])
    return pixels.select("image_id", "y", "x", F.col("label").alias("own"), F.filter(sides, lambda s: s["label"] >= 0).alias("near"))


def smooth_round(pixels: DataFrame) -> DataFrame:
    """One parallel round of smoothing: a labelled pixel takes the label that it and its 4-neighbours have most, its own among equals."""
    votes = neighbour_votes(pixels)
    all_ = F.concat(F.array("own"), F.transform("near", lambda s: s["label"]))
    each = F.transform(all_, lambda c, i: F.struct(F.size(F.filter(all_, lambda x: x == c)).alias("n"), (-i).alias("place"), c.alias("label")))
    return votes.select("image_id", "y", "x", F.when(F.col("own") >= 0, F.array_max(each)["label"]).otherwise(F.col("own")).alias("label"))


def fill_gaps_round(pixels: DataFrame) -> DataFrame:
    """One parallel round of gap filling: an unlabelled pixel takes the majority label of its neighbours, first side on ties."""
    votes = neighbour_votes(pixels).withColumn("v", F.explode_outer("near"))
    count = votes.groupBy("image_id", "y", "x", "own", "v.label").agg(F.count("v").alias("n"), F.min("v.side").alias("side"))
    best = count.groupBy("image_id", "y", "x", "own").agg(F.min(F.struct((-F.col("n")).alias("n"), "side", "label")).alias("best"))
    return best.select("image_id", "y", "x", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.coalesce("best.label", F.lit(-1))).alias("label"))
