"""Choosing rows and labels: overlaps, flags, best candidates, samples, caps, duplicates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import libm_atan2
from .raster import border_lengths


def with_any_tag(rows: DataFrame, tags: str, wanted: list[str]) -> DataFrame:
    """Rows whose array ``tags`` has one of ``wanted``; null and empty arrays have none."""
    return rows.where(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))))


def flags(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """``any_<name>`` and ``all_<name>`` of every condition in each group."""
    both = [f(c).alias(f"{kind}_{name}") for name, c in conditions.items() for kind, f in (("any", F.bool_or), ("all", F.bool_and))]
    return rows.groupBy(*by).agg(*both)


def best_candidate(rows: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that is smallest by ``order``, compared in turn; a partial aggregate, so no group is sorted."""
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(order)])
    return rows.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("best")).select(*by, "best.*")


def sample(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group without replacement, those with the smallest digests of seed and key; reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(digest, key))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def ordered_unique(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``values``: the distinct values of each group by their first place, as one array."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.col(value).alias("v"))))
    return first.groupBy(*by).agg(F.transform(listed, lambda s: s["v"]).alias("values"))


def largest_labels(profile: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest labels of each image with their place from 0, the smaller label first among equals."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("pixels"), "label")) - 1
    return profile.withColumn("place", place).where(F.col("place") < n)


def global_mode(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, label, n: the most frequent label >= 0, the smallest of equals."""
    counted = pixels.where(F.col(label) >= 0).groupBy("image_id", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("image_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("image_id", "b.label", (-F.col("b.n")).alias("n"))


def polar_order(points: DataFrame, by: str, tie: str) -> DataFrame:
    """``points`` (by, x, y) with angle around their centroid and place in its order.

    The centroid is summed in the order of ``tie``, so that reruns agree however rows arrive.
    """
    whole = Window.partitionBy(by)
    summed = whole.orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = points.withColumns({"_dy": F.col("y") - F.avg("y").over(summed), "_dx": F.col("x") - F.avg("x").over(summed)})
    angled = off.withColumn("angle", libm_atan2("_dy", "_dx")).drop("_dy", "_dx")
    return angled.withColumn("place", F.row_number().over(whole.orderBy("angle", tie)))


#: The smaller of two areas is nil below this, and they are alike.
NIL_AREA = 1e-6


def _least_in_span(area: np.ndarray, ring: np.ndarray, asked: np.ndarray, least_ratio: float) -> np.ndarray:
    """For every area of ``asked`` the smallest ``ring`` whose ``area`` is alike, None without one; no nil areas."""
    order = np.argsort(area, kind="stable")
    area, table = area[order], [ring[order]]
    while (step := 1 << (len(table) - 1)) * 2 <= len(area):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    # the outermost doubles that still pass the comparison of quotients, which is monotone
    low, high = asked * least_ratio, asked / least_ratio
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(4):
            low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
        for _ in range(9):
            low = np.where(low / asked >= least_ratio, low, np.nextafter(low, np.inf))
            high = np.where(asked / high >= least_ratio, high, np.nextafter(high, -np.inf))
    low, high = np.where(np.isinf(asked), np.inf, low), np.where(np.isinf(asked), np.inf, high)
    i, j = np.searchsorted(area, low, "left"), np.searchsorted(area, high, "right")
    found = np.full(len(asked), None, object)
    for level, least in enumerate(table):
        here = (j - i >= 1 << level) & (j - i < 2 << level)
        found[here] = np.minimum(least[i[here]], least[j[here] - (1 << level)])
    return found


def duplicate_rings(rings: DataFrame, distance: float = 3.0, least_ratio: float = 0.7) -> DataFrame:
    """``rings`` (image_id, ring, cx, cy, area) that have an earlier near-duplicate: centroids within ``distance``, areas alike.

    Areas are alike if the smaller is ``least_ratio`` of the larger or one is nil; an unknown area is like any known one.

    If any duplicate is earlier, so is the smallest of all, which a ring shares with its likes. So distinct centroids meet by
    grid cells, rings of one centroid and one narrow range of areas are one group, and groups meet instead of rings. Only where
    some areas of two groups are alike and others not are rings looked up, by binary search in the sorted areas of the other group.
    Work grows with the pairs of distinct centroids within ``distance``, not with the pairs of rings.
    """
    # two areas of one range are always alike, and those of ranges more than three apart never
    width = math.inf if least_ratio <= 0 else max(-math.log(min(least_ratio, 1.0)) / 2, 1e-9)
    spot = ["image_id", "cx", "cy"]
    area = F.abs("area").cast("double")
    wild = F.isnan(area) | (area < NIL_AREA)
    kind = F.when(area.isNull(), "unknown").when(wild, "wild").otherwise("plain")
    rows = rings.where("ring IS NOT NULL").select(*spot, "ring", area.alias("area"), kind.alias("kind")).withColumn(
        "range", F.when(F.col("kind") == "plain", F.floor(F.ln(F.least("area", F.lit(1e308))) / width))
    )
    kinds = ("unknown", "wild", "plain")
    spots = rows.groupBy(*spot).agg(*[F.min(F.when(F.col("kind") == k, F.col("ring"))).alias(k) for k in kinds])
    cell = lambda c: F.floor(F.least(F.greatest(F.col(c) / distance, F.lit(-1e15)), F.lit(1e15)))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    here = spots.select("image_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), *kinds, cell("cx").alias("i"), cell("cy").alias("j"))
    there = spots.select(*spot, cell("cx").alias("ci"), cell("cy").alias("cj")).withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
    there = there.select(*spot, (F.col("ci") + F.col("di")).alias("i"), (F.col("cj") + F.col("dj")).alias("j"))
    near = there.join(here, ["image_id", "i", "j"]).where(F.hypot(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")) <= distance)
    # what is alike whatever the areas
    free = near.groupBy(*spot).agg(*[F.min(k).alias(k) for k in kinds])
    free = free.select(*spot, F.least("wild", "unknown").alias("plain"), F.least("wild", "plain").alias("unknown"), F.least(*kinds).alias("wild"))
    # groups of plain areas
    groups = rows.where("kind = 'plain'").groupBy(*spot, "range").agg(F.min("ring").alias("least"), F.min("area").alias("lo"), F.max("area").alias("hi"))
    other = groups.select("image_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("range").alias("arange"), F.col("least").alias("aleast"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    reach = F.explode(F.sequence(F.col("range") - 3, F.col("range") + 3))
    met = groups.join(near.select(*spot, "ax", "ay"), spot).withColumn("arange", reach).join(other, ["image_id", "ax", "ay", "arange"])
    alike = lambda a, b: F.least(a, b) / F.greatest(a, b) >= least_ratio
    whole = alike("lo", "ahi") & alike("hi", "alo")
    none = ((F.col("hi") < F.col("alo")) & ~alike("hi", "alo")) | ((F.col("ahi") < F.col("lo")) & ~alike("ahi", "lo"))
    common = met.where(whole).groupBy(*spot, "range").agg(F.min("aleast").alias("common"))
    # groups alike in part, if they could give a smaller ring than is found already
    group = [*spot, "range"]
    known = groups.select(*group).join(free.select(*spot, F.col("plain").alias("free")), spot).join(common, group, "left").withColumn("known", F.least("free", "common"))
    part = met.where(~whole & ~none).join(known.select(*group, "known"), group).where("known IS NULL OR aleast < known")
    pair = ["image_id", "cx", "cy", "range", "ax", "ay", "arange"]
    part = part.select(*pair)
    asks = part.join(rows.select(*group, "ring", "area"), group).select(*pair, "ring", "area", F.lit(True).alias("asks"))
    gives = rows.select("image_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("range").alias("arange"), "ring", "area")
    gives = part.join(gives, ["image_id", "ax", "ay", "arange"]).select(*pair, "ring", "area", F.lit(False).alias("asks"))

    def look_up(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        ring, area = np.array(rows.column("ring").to_pylist(), object), rows.column("area").to_numpy()
        found = _least_in_span(area[~asks], ring[~asks], area[asks], least_ratio)
        out = rows.filter(rows.column("asks")).select(["image_id", "ring"])
        return out.append_column("found", pa.array(found.tolist(), out.schema.field("ring").type))

    kind_of = lambda c: rings.schema[c].dataType.simpleString()
    looked = asks.unionAll(gives).groupBy(*pair).applyInArrow(look_up, f"image_id {kind_of('image_id')}, ring {kind_of('ring')}, found {kind_of('ring')}")
    joined = rows.join(free, spot).join(common, [*spot, "range"], "left")
    mine = F.when(F.col("kind") == "plain", F.least("plain", "common")).when(F.col("kind") == "wild", F.col("wild")).otherwise(F.col("unknown"))
    found = joined.select("image_id", "ring", mine.alias("found")).unionAll(looked)
    return found.where("found < ring").groupBy("image_id", "ring").agg(F.min("found").alias("first_ring"))


def cap_faces(pixels: DataFrame, most: int) -> DataFrame:
    """``pixels`` with at most ``most`` labels an image: smaller faces join the kept one they touch along most sides, else the largest.

    Touching is by 4-neighbours in the picture as it was; the smaller label wins among equals.
    """
    n = pixels.where("label >= 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixels"))
    ranked = n.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("pixels"), "label")))
    kept, lost = ranked.where(F.col("place") <= most), ranked.where(F.col("place") > most)
    sides = border_lengths(pixels)
    both = sides.select("image_id", F.col("a").alias("label"), F.col("b").alias("to"), "length").unionAll(sides.select("image_id", F.col("b").alias("label"), F.col("a").alias("to"), "length"))
    votes = both.join(kept.select("image_id", F.col("label").alias("to")), ["image_id", "to"], "left_semi")
    chosen = votes.groupBy("image_id", "label").agg(F.min(F.struct((-F.col("length")).alias("n"), "to")).alias("b")).select("image_id", "label", F.col("b.to").alias("to"))
    largest = kept.where("place = 1").select("image_id", F.col("label").alias("largest"))
    moved = lost.join(chosen, ["image_id", "label"], "left").join(largest, "image_id").select("image_id", "label", F.coalesce("to", "largest").alias("to"))
    return pixels.join(moved, ["image_id", "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
