"""Queries of the engine over the driver's tables and formula rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import depth, halfedges, labels, layers, matching, paths, raster, regions, selection, stamps, stats
from ..sources import documents, rasters
from . import approximate, pictures
from .recipe import recipe

PALETTE = [(224, 32, 32), (32, 32, 224), (240, 220, 40), (40, 180, 80), (128, 128, 128), (20, 20, 20)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rgb(spark: SparkSession, d: str) -> DataFrame:
    return rasters.vector_rgb(read(spark, d, "embeddings"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels.assign_palette(rgb(spark, d), PALETTE)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def region_profile(spark, d):
    return r6(stats.region_profile(labelled(spark, d)), "cx", "cy", "fraction")


def region_borders(spark, d):
    return raster.border_lengths(labelled(spark, d))


def region_degrees(spark, d):
    return raster.degrees(raster.border_lengths(labelled(spark, d)))


def formula_profile(spark, d):
    return r6(stats.region_profile(rasters.formula_rasters(spark)), "cx", "cy", "fraction")


def formula_borders(spark, d):
    return raster.border_lengths(rasters.formula_rasters(spark))


def colour_lab(spark, d):
    lab = rgb(spark, d).withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    return lab.select("y", "x", *[F.round(f"lab.{c}", 5).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


def colour_roundtrip(spark, d):
    lab = rgb(spark, d).withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    back = lab.select("r", "g", "b", color.lab_to_rgb(F.col("lab.lab_l"), F.col("lab.lab_a"), F.col("lab.lab_b")).alias("q"))
    same = (F.col("r") == F.col("q.r")) & (F.col("g") == F.col("q.g")) & (F.col("b") == F.col("q.b"))
    return back.agg(F.count(F.lit(1)).alias("pixels"), F.count_if(same).alias("same"))


def colour_hex(spark, d):
    h = color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).groupBy(h.alias("hex")).agg(F.count(F.lit(1)).alias("n")).withColumn("r", color.hex_to_rgb(F.col("hex"))["r"])


def colour_histogram(spark, d):
    return stats.quantised_histogram(rgb(spark, d))


def colour_stats(spark, d):
    return r6(stats.colour_stats(rgb(spark, d)), "peak_ratio", "grad_frac")


def palette(spark, d):
    return r6(labels.palette_table(labelled(spark, d), PALETTE), "fraction")


def label_ratios(spark, d):
    return r6(stats.label_ratios(labelled(spark, d)), "gap_frac", "soft_frac")


def gradient(spark, d):
    g = raster.gradient(rasters.vector_pixels(read(spark, d, "embeddings")))
    return r6(g.groupBy("y").agg(F.avg("gradient").alias("mean"), F.max("gradient").alias("top"), F.percentile("gradient", F.lit(0.9)).alias("p90")), "mean", "top", "p90")


def visible_boundary(spark, d):
    b = raster.visible_boundary(rgb(spark, d))
    return b.groupBy("y").agg(F.count_if("boundary").alias("boundary"), F.max("rgb_jump").alias("jump"))


def morphology(spark, d):
    mask = rasters.vector_pixels(read(spark, d, "embeddings")).select("image_id", "y", "x", (F.col("value") > 0).cast("int").alias("mask"))
    return raster.close_open(mask).groupBy("y").agg(F.sum("mask").alias("kept"))


def soft_sdf(spark, d):
    mask = rasters.formula_rasters(spark).select("image_id", "y", "x", (F.col("label") >= 0).cast("int").alias("mask"))
    return raster.soft_sdf(mask, rounds=2).select("image_id", "y", "x", F.round("sdf", 6).alias("sdf"))


def laplacian(spark, d):
    lap = raster.laplacian(rasters.vector_pixels(read(spark, d, "embeddings")), "value", "lap")
    return r6(lap.groupBy("y").agg(F.sum(F.abs("lap")).alias("energy")), "energy")


def downsample(spark, d):
    return r6(raster.downsample(rasters.vector_pixels(read(spark, d, "embeddings")), 4, ["value"]), "value")


def dual_edges(spark, d):
    e = raster.dual_edges(rasters.formula_rasters(spark))
    return e.groupBy("image_id", F.least("left_label", "right_label").alias("a"), F.greatest("left_label", "right_label").alias("b")).agg(F.count(F.lit(1)).alias("length"))


def lloyd_step(spark, d):
    v = read(spark, d, "embeddings")
    near = labels.nearest_centroid(v, "vec_id", "embedding", labels.centroids(v, "label", "embedding"))
    return r6(near, "distance")


def recall_topk(spark, d):
    v = read(spark, d, "embeddings")
    centres = labels.centroids(v, "label", "embedding")
    row = centres.select("cluster", "centre", F.col("n").alias("size"))
    q = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    # at most one row per label (a palette of at most 256): a side of fixed size
    pairs = q.join(F.broadcast(row))
    gap = matching.descriptor_distance(F.col("v"), F.col("centre"))
    scored = pairs.withColumn("score", F.exp(-gap) + F.exp(-0.25 * F.abs(F.ln(F.col("size").cast("double")) - F.lit(3.0))))
    return r6(matching.top_k(scored, ["vec_id"], "score", "cluster", 3).select("vec_id", "cluster", "rank", "score"), "score")


def _point_sets(spark, d):
    v = read(spark, d, "embeddings")
    p = v.select(F.lit("emb").alias("image_id"), F.col("vec_id").alias("id"), "label", *[(F.element_at("embedding", k).cast("double") * 100).alias(c) for k, c in ((1, "x"), (2, "y"))])
    return p.where("label = 0").drop("label"), p.where("label = 1").drop("label")


def chamfer(spark, d):
    a, b = _point_sets(spark, d)
    return r6(matching.chamfer(a, b, "image_id", 4.0), "chamfer")


def seam_p95(spark, d):
    a, b = _point_sets(spark, d)
    return r6(matching.seam_p95(a, b, "image_id", 4.0), "seam_p95")


def chamfer_huber(spark, d):
    a, b = _point_sets(spark, d)
    return r6(matching.chamfer(a, b, "image_id", 4.0, "huber"), "chamfer")


def uncovered(spark, d):
    a, b = _point_sets(spark, d)
    return r6(matching.uncovered(a, b, "image_id", 4.0, 3.0), "d")


def coverage(spark, d):
    lab, docs = read(spark, d, "labels"), read(spark, d, "documents").select("doc_id", "lang")
    marked = lab.join(docs, "doc_id")
    return r6(stats.coverage(marked.where("quality = 1"), marked.where("toxic = 0"), ["doc_id"], "lang"), "cover", "leak", "iou")


def missing_keys(spark, d):
    return layers.missing_keys(read(spark, d, "documents"), "doc_id", read(spark, d, "labels"), "doc_id")


def allow_list(spark, d):
    allowed = read(spark, d, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return read(spark, d, "customer").join(allowed, "c_nationkey", "left_semi").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def role_runs(spark, d):
    return layers.fill_runs(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


def type_runs(spark, d):
    e = read(spark, d, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return layers.fill_runs(e.select("user_id", "at", "event_type"), "user_id", "at", "event_type")


def majority_type(spark, d):
    return stats.majority(read(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


def _paths(spark, d):
    e = read(spark, d, "events")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", at.alias("pos"), at.cast("double").alias("x"), F.col("value").alias("y"))


def arc_length(spark, d):
    return r6(paths.arc_length(_paths(spark, d), "user_id", "pos").groupBy("user_id").agg(F.max("arc").alias("arc"), F.count(F.lit(1)).alias("n")), "arc")


def resample(spark, d):
    return paths.resample(_paths(spark, d), "user_id", "pos", 8).select("user_id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def shoelace(spark, d):
    return r6(paths.shoelace(_paths(spark, d), "user_id", "pos"), "area", "perimeter")


def turn_histogram(spark, d):
    turns = paths.turn_angles(_paths(spark, d), "user_id", "pos")
    return stats.angle_histogram(turns.withColumn("all", F.lit("events")), ["all"], "turn").select("bin", "n", F.round("share", 6).alias("share"))


def subsample(spark, d):
    return paths.subsample(_paths(spark, d), "user_id", "pos", 5).select("user_id", "pos")


def point_in_ring(spark, d):
    e = read(spark, d, "events").select(F.lit("e").alias("k"), F.col("event_id").alias("id"), ((F.col("event_id") % 40) / 4.0).alias("px"), (F.pmod(F.floor("value"), F.lit(40)) / 4.0).alias("py"))
    ring = spark.sql("SELECT 'e' AS k, 0 AS ring, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM VALUES (0, 0.1, 0.1), (1, 9.1, 1.1), (2, 5.1, 4.1), (3, 8.1, 9.1), (4, 1.1, 7.1) AS t(pos, x, y)")
    # the ring has five corners: a side of fixed size
    return paths.points_in_rings(e, F.broadcast(ring), "k").select("id", "inside")


def principal_axis(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return stats.principal_axis(li, ["l_returnflag"]).select("l_returnflag", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mx", "my", "major", "minor", "angle")])


def spread(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.round(F.stddev_pop("o_totalprice"), 3).alias("pop"), F.round(F.stddev_samp("o_totalprice"), 3).alias("samp"),
        F.round(F.percentile("o_totalprice", F.lit(0.7)), 3).alias("p70"), F.round(F.median("o_totalprice"), 3).alias("median"),
    )


def weighted_error(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / (F.sum("l_quantity") + 1e-8), 8).alias("error"))


def _off_tie(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded beside the decimal ties that sums of products of short decimals hit."""
    return df.withColumns({c: F.round(F.col(c) + 1.234e-7, 6) for c in columns})


def _order_lines(spark, d):
    """Line items with idx, a number of their own within the order (line numbers repeat)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return read(spark, d, "lineitem").withColumn("idx", F.row_number().over(w).cast("long"))


def _order_layers(spark, d):
    return _order_lines(spark, d).select("l_orderkey", "idx", (F.col("l_discount") + 0.5).alias("a"), F.col("l_tax").alias("c"))


def painter_fold(spark, d):
    folded = layers.over_fold(_order_layers(spark, d), ["l_orderkey"], "idx", "a", ["c"])
    return _off_tie(folded, "c", "alpha")


def leave_one_out(spark, d):
    change = layers.layer_contributions(_order_layers(spark, d), ["l_orderkey"], "idx", "a", ["c"])
    return _off_tie(change.select("l_orderkey", "idx", "d_rgb", "d_alpha"), "d_rgb", "d_alpha")


def budget_limit(spark, d):
    li = _order_lines(spark, d).select("l_orderkey", "idx", "l_quantity")
    return layers.within_budget(li, "l_orderkey", ["idx"], "l_quantity", 60.0)


def props_json(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k", F.to_json("p").alias("body"))


def hex_normalise(spark, d):
    tokens = read(spark, d, "documents").select(F.explode(F.split("text", "[ \\n\\t]+")).alias("raw")).where(F.col("raw").rlike("^#?[0-9A-Fa-f]{3,6}$"))
    made = tokens.unionAll(read(spark, d, "events").select(F.concat(F.lit("#"), F.substring(F.md5("props"), 1, 3)).alias("raw")))
    return made.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", color.normalise_hex(F.col("raw")).alias("hex"), "n")


def angles(spark, d):
    e = read(spark, d, "events").select("event_id", (F.pmod("event_id", F.lit(720)) - 360).cast("double").alias("angle"))
    return e.select("event_id", layers.discrete_angle(F.col("angle")).alias("square"), layers.nearest_angle(F.col("angle"), [0.0, 30.0, 45.0, 90.0, 180.0]).alias("near"))


def canvas_points(spark, d):
    e = read(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(360)).cast("double").alias("angle"))
    p = layers.canvas_points(F.lit(0.5), F.lit(-0.25), F.lit(160.0), F.lit(100.0), F.lit(40.0), F.lit(20.0), F.col("angle"), F.col("event_id") % 2 == 1, F.lit(False))
    return e.select("event_id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def score_formulas(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("u"), (F.col("p_retailprice") / 2000.0).alias("v"))
    u, v = F.col("u"), F.col("v")
    return p.select(
        "p_partkey", F.round(matching.complexity(u, F.col("p_partkey") % 5, 1 + v * 3, v / 8, u), 8).alias("complexity"), F.round(matching.simplicity(u, 1 + v * 3, v, u / 10), 8).alias("simplicity"),
        F.round(matching.layer_simplicity(F.col("p_partkey") % 41), 8).alias("layers"), F.round(matching.pose_score(v * 20, u, u * v, 1 - u, 0.1 + 4 * v), 8).alias("pose"),
        F.round(matching.similarity(u, v * 60, 1 - v, u), 8).alias("similarity"), F.round(matching.final_score(u, v, F.col("p_partkey") % 41, F.lit(False)), 8).alias("final"),
    )


def depth_order(spark, d):
    px = labelled(spark, d)
    h = px.agg(F.max("y")).first()[0] + 1
    faces = depth.enclosing(stats.region_profile(px), px)
    return r6(depth.depth_order(faces, raster.border_lengths(px), (float(h), 21.0)), "score")


def edge_roles(spark, d):
    px = rasters.formula_rasters(spark)
    faces, borders = stats.region_profile(px), raster.border_lengths(px)
    order = depth.depth_order(depth.enclosing(faces, px), borders, (64.0, 64.0))
    return depth.edge_roles(borders, order, faces, px).select("image_id", "a", "b", "role")


def component_sizes(spark, d):
    return regions.component_sizes(rasters.formula_rasters(spark))


def vector_components(spark, d):
    px = rasters.vector_pixels(read(spark, d, "embeddings")).select("image_id", "y", "x", F.when(F.col("value") > 0.15, 0).otherwise(-1).cast("int").alias("label"))
    return regions.component_sizes(px).groupBy("pixels").agg(F.count(F.lit(1)).alias("components"))


def hole_sizes(spark, d):
    return regions.holes(rasters.formula_rasters(spark))


def contour_facts(spark, d):
    return regions.contours(rasters.formula_rasters(spark)).select("image_id", "label", "ring", "kind", "area", "perimeter")


def planar_map(spark, d):
    return regions.planar_edges(raster.dual_edges(rasters.formula_rasters(spark))).groupBy("image_id", "a", "b").agg(
        F.sum("length_px").alias("length_px"), F.count(F.lit(1)).alias("chains"), F.round(F.sum("length_fit"), 4).alias("length_fit")
    )


def planar_problems(spark, d):
    px = rasters.formula_rasters(spark)
    faces = px.where("label >= 0").select("image_id", "label").distinct()
    found = regions.planar_problems(faces, regions.planar_edges(raster.dual_edges(px)))
    return faces.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces")).join(found.groupBy("image_id").agg(F.count(F.lit(1)).alias("problems")), "image_id", "left").withColumn(
        "problems", F.coalesce("problems", F.lit(0))
    )


def kmeans(spark, d):
    return regions.kmeans_labels(rgb(spark, d), 6).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def clean_labels(spark, d):
    px = rasters.formula_rasters(spark).withColumn("alpha", F.lit(1.0))
    return regions.clean_labels(px).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


def gap_round(spark, d):
    px = rasters.formula_rasters(spark)
    return labels.fill_gaps_round(px).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


def stamp_library(spark, d):
    f = stamps.stamp_features(stamps.stamp_table(spark))
    return f.select("asset_id", "n_holes", F.array_join("tags", ",").alias("tags"), *[F.round(c, 4).alias(c) for c in ("circularity", "elongation", "area_frac", "complexity")])


def stamp_recall(spark, d):
    f = stamps.stamp_features(stamps.stamp_table(spark))
    return stamps.recall(stamps.region_features(rasters.formula_rasters(spark)), f).withColumn("score", F.round("score", 4))


def stamp_cover(spark, d):
    table, px = stamps.stamp_table(spark), rasters.formula_rasters(spark)
    best = stamps.recall(stamps.region_features(px), stamps.stamp_features(table), 3)
    out = stamps.cover_regions(px, best, table)
    return out.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("steps"), F.round(F.max("cover"), 4).alias("cover"))


def svg_sizes(spark, d):
    made = read(spark, d, "part").select(
        F.col("p_name").alias("asset_id"), F.lit("").alias("path"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<svg viewBox=\"0 0 "), F.col("p_size"), F.lit(" "), F.col("p_size") * 2, F.lit("\"/>")))
        .otherwise(F.concat(F.lit("<svg width=\""), F.col("p_size"), F.lit("px\" height=\"7.5\"/>"))).alias("svg"),
    )
    return documents.svg_sizes(made).select("asset_id", "native_w", "native_h").groupBy("native_w", "native_h").agg(F.count(F.lit(1)).alias("n"))


def layer_documents(spark, d):
    li = read(spark, d, "lineitem")
    body = F.to_json(F.struct(
        F.concat(F.lit("S"), F.col("l_partkey"), F.lit(".svg")).alias("asset"), F.col("l_extendedprice").alias("top"), F.col("l_discount").alias("left"), F.col("l_quantity").alias("height"),
        F.col("l_tax").alias("width"), F.when(F.col("l_linenumber") == 2, F.lit("#abc")).otherwise(F.lit("3a9ffa")).alias("fill"), F.col("l_linenumber").alias("unknown"),
    ))
    docs = li.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", body.alias("j")))), lambda s: s["j"]), ","), F.lit("]")).alias("body")
    )
    parsed = documents.parse_documents(docs)
    return parsed.groupBy("fill", "problem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("height"), 2).alias("height"))


def approximate_layers(spark, d):
    px = rasters.formula_rasters(spark)
    fills = px.where("label >= 0").select("image_id", "label").distinct().withColumn("fill", color.rgb_to_hex(F.col("label") * 40, F.lit(90), F.lit(160)))
    return approximate.approximate(px, fills, stamps.stamp_table(spark), recipe("logo", canvas=64))


def picture_scores(spark, d):
    px = rasters.formula_rasters(spark).select("image_id", "y", "x", *[F.when(F.col("label") >= 0, 40 + F.col("label") * 60 + k).otherwise(0).alias(c) for k, c in enumerate("rgb")], F.when(F.col("label") >= 0, 1.0).otherwise(0.0).alias("alpha"))
    run, library = recipe("logo", canvas=64), stamps.stamp_table(spark)
    faces, stack = pictures.picture_stacks(px, library, run)
    return pictures.score_stacks(stack, faces, library, run.canvas).select("doc_id", "n_layers", *[F.round(c, 4).alias(c) for c in ("cover", "leak", "iou", "colour_error", "similarity", "overall")], "passed")


def recall_formulas(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("u"), (F.col("p_retailprice") / 2000.0).alias("v"))
    u, v, n = F.col("u"), F.col("v"), F.col("p_partkey")
    wants = F.when(n % 3 == 0, F.lit(True)).when(n % 3 == 1, F.lit(False))
    return p.select(
        "p_partkey", F.round(matching.adjusted_recall(u + v, u, v, n % 2, n % 5 == 0, v, u / 5, wants), 8).alias("recall"),
        F.round(matching.plain_stamp_score(u, 1 + 3 * v, v, 1 + u, u * v, v, n % 2), 8).alias("plain"),
    )


def tag_overlap(spark, d):
    p = read(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    return selection.with_any_tag(p, "tags", ["ring", "red"]).select("p_partkey")


def order_flags(spark, d):
    return selection.flags(read(spark, d, "lineitem"), ["l_orderkey"], returned=F.col("l_returnflag") == "R", large=F.col("l_quantity") > 5)


def best_line(spark, d):
    order = [F.col("l_discount"), -F.col("l_quantity"), F.col("l_tax"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    return selection.best_candidate(read(spark, d, "lineitem"), ["l_partkey"], order, ["l_discount", "l_quantity", "l_tax", "l_orderkey"])


def random_sample(spark, d):
    return selection.sample(read(spark, d, "customer"), ["c_nationkey"], "c_custkey", 3, seed=7).select("c_nationkey", "c_custkey")


def unique_concat(spark, d):
    at = F.struct("ts", "event_id")
    found = selection.ordered_unique(read(spark, d, "events").withColumn("at", at), ["user_id"], "at", "event_type")
    return found.select("user_id", F.array_join("values", ",").alias("types"))


def largest_labels(spark, d):
    return selection.largest_labels(stats.region_profile(labelled(spark, d)), 4).select("image_id", "label", "pixels", "place")


def global_mode(spark, d):
    return selection.global_mode(rasters.formula_rasters(spark))


def polar_order(spark, d):
    return selection.polar_order(_paths(spark, d), "user_id", "pos").select("user_id", "pos", "place")


def duplicate_rings(spark, d):
    p = read(spark, d, "part").select(F.lit("p").alias("image_id"), F.col("p_partkey").alias("ring"), (F.col("p_size") * 4.0).alias("cx"), (F.col("p_partkey") % 97).cast("double").alias("cy"), F.col("p_retailprice").alias("area"))
    return selection.duplicate_rings(p)


def face_cap(spark, d):
    return selection.cap_faces(labelled(spark, d), 4).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


def affine_sample(spark, d):
    out = raster.affine_sample(rasters.vector_pixels(read(spark, d, "embeddings")), "value", 64, 64, (32.0, 32.0), (31.5, 31.5), 1.25, 30.0)
    return out.withColumn("value", F.round("value", 6) + 0.0)


def grey_composite(spark, d):
    px = rgb(spark, d).withColumn("alpha", (F.col("x") % 5) / 4.0)
    return raster.on_grey(px).groupBy("y").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])


def median_filter(spark, d):
    out = raster.median3(rasters.vector_pixels(read(spark, d, "embeddings")), "value", "median")
    return r6(out.groupBy("y").agg(F.sum("median").alias("total"), F.max("median").alias("top")), "total", "top")


def central_steps(spark, d):
    out = raster.central_difference(rasters.vector_pixels(read(spark, d, "embeddings")), "value", "dx", "dy")
    return r6(out.groupBy("y").agg(F.sum(F.abs("dx")).alias("across"), F.sum(F.abs("dy")).alias("down")), "across", "down")


def correlation(spark, d):
    return r6(read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("corr")), "corr")


def face_cycles(spark, d):
    px = labelled(spark, d).unionByName(rasters.formula_rasters(spark), allowMissingColumns=True)
    found = halfedges.face_cycles(px)
    # outlines less holes is the Euler number of a face, which can be counted without a walk
    euler = F.count_if(F.col("area") > 0) - F.count_if(F.col("area") < 0)
    return found.groupBy("image_id", "face").agg(euler.alias("euler"), F.sum("length").alias("length"), F.sum("area").cast("long").alias("pixels"))


def area_match(spark, d):
    p = _paths(spark, d)
    targets = p.groupBy("user_id").agg((F.sum("y") * (1 + F.col("user_id") % 3)).alias("target"))
    out = paths.match_area(p, targets, "user_id", "pos")
    return _off_tie(out.select("user_id", "pos", "x", "y", "scale"), "x", "y", "scale")
