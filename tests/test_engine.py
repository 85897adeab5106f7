"""Operators against closed forms, brute force and the SQL of the registry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import color, kernels
from tesserae.operators import components, depth, halfedges, labels, layers, matching, paths, raster, regions, selection, stamps, stats
from tesserae.plans import registry
from tesserae.sources import documents, rasters

SF = "/root/testdata/sf0.001"


def test_lab_golden_values(spark):
    rows = spark.createDataFrame([(255, 0, 0), (0, 0, 255), (58, 159, 250)], "r int, g int, b int")
    got = [tuple(r.lab) for r in rows.select(color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).collect()]
    want = [(53.240794, 80.09246, 67.203197), (32.297011, 79.18752, -107.860162), (63.830978, 1.518681, -53.511612)]
    assert np.allclose(got, want, atol=1e-5)


def test_hex(spark):
    rows = spark.createDataFrame([("3a9ffa",), ("#abc",), ("not-a-color",), (None,)], "v string")
    assert [r[0] for r in rows.select(color.normalise_hex(F.col("v"))).collect()] == ["#3A9FFA", "#AABBCC", None, None]


def test_formula_facts(spark):
    px = rasters.formula_rasters(spark)
    n = {(r.image_id, r.label): r.pixels for r in stats.region_profile(px).collect()}
    assert n["disk64", 0] == 1257 and n["ring96", 0] == 3260 and n["ell48", 1] == 320 and n["diskbg64", 1] == 1313
    b = {(r.image_id, r.a, r.b): r.length for r in raster.border_lengths(px).collect()}
    assert b["disk64", -1, 0] == 164 and b["ring128", -1, 0] == 512 and b["ell48", 0, 1] == 36
    holes = {(r.image_id, r.pixels) for r in regions.holes(px).collect()}
    assert {("ring96", 793), ("ring128", 1009)} <= holes
    rings = regions.contours(px).where("image_id = 'ring96'").collect()
    assert sorted(r.kind for r in rings) == ["hole", "outer"]
    assert sum(r.area if r.kind == "outer" else -r.area for r in rings) == 3260


def test_over_fold_and_prune(spark):
    two = spark.createDataFrame([("d", 0, 0.5, 1.0), ("d", 1, 0.25, 0.0)], "doc string, idx int, a double, c double")
    row = layers.over_fold(two, ["doc"], "idx", "a", ["c"]).first()
    assert row.c == pytest.approx(0.375) and row.alpha == pytest.approx(0.625)
    # two equal opaque layers add nothing beyond each other and go together, but one layer stays
    same = spark.createDataFrame([("d", 0, 0, k, 1.0, 9.0, 9.0, 9.0) for k in (0, 1)], "doc_id string, y int, x int, idx int, a double, r double, g double, b double")
    assert [(r.idx, r.kept) for r in layers.prune(same).orderBy("idx").collect()] == [(0, True), (1, False)]


def test_leave_one_out_agrees_with_refolding(spark):
    rows = [("d", k, 0.1 + 0.15 * k, float(k % 3)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc string, idx int, a double, c double")
    fast = {r.idx: (r.d_rgb, r.d_alpha) for r in layers.layer_contributions(df, ["doc"], "idx", "a", ["c"]).collect()}
    slow = {r.idx: (r.d_rgb, r.d_alpha) for r in layers.leave_one_out(df, ["doc"], "idx", "a", ["c"]).collect()}
    assert fast.keys() == slow.keys() and all(np.allclose(fast[k], slow[k], atol=1e-12) for k in fast)


def test_nearest_points(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 50, (80, 2)), rng.normal(0, 5, (60, 2))
    frame = lambda p: spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in enumerate(p)], "s string, id int, x double, y double")
    got = {r.id: r.d for r in matching.nearest_points(frame(a), frame(b), "s", 2.0).collect()}
    want = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)).min(1)
    assert np.allclose([got[k] for k in range(80)], want)


def test_circle_area_and_resample(spark):
    t = np.linspace(0, 2 * math.pi, 64, endpoint=False)
    ring = spark.createDataFrame([("c", k, 40 * math.cos(a), 40 * math.sin(a)) for k, a in enumerate(t)], "id string, pos int, x double, y double")
    assert paths.shoelace(ring, "id", "pos").first().area == pytest.approx(5018.477585)
    got = [(r.x, r.y) for r in paths.resample(ring, "id", "pos", 10).orderBy("k").collect()]
    want = kernels.resample_path(np.column_stack([40 * np.cos(t), 40 * np.sin(t)]), 10)
    assert len(got) == 10 and np.allclose(got, want, atol=1e-9)


def test_kernels():
    stair = np.array([(0, 0)] + [p for k in range(20) for p in ((k + 1, k), (k + 1, k + 1))], float)
    assert len(kernels.fit_path(stair)) < len(stair) / 2
    corner = np.array([(x, 0) for x in range(41)] + [(40, y) for y in range(1, 41)], float)
    assert np.hypot(*(kernels.fit_path(corner) - [40, 0]).T).min() <= 3
    gap = np.zeros((9, 9), int)
    gap[3:5, 3:5] = -1
    assert (kernels.fill_gaps(gap, np.ones((9, 9), bool)) == 0).all()
    speck = np.zeros((12, 12), int)
    speck[5, 5] = 1
    assert (kernels.merge_small(speck, 4) == 0).all()
    cost = np.zeros((12, 12, 2))
    cost[:, :, 1] = 1
    assert (kernels.potts_relax(speck, cost, np.zeros((12, 12))) == 0).all()


def test_planar_map_is_whole(spark):
    assert all(r.problems == 0 and r.faces > 0 for r in registry.QUERIES["planar_problems"](spark, SF).collect())
    total = {r.image_id: r.n for r in registry.QUERIES["planar_map"](spark, SF).groupBy("image_id").agg(F.sum("length_px").alias("n")).collect()}
    assert total["split64"] == 64 + 4 * 64 and total["disk64"] == 164


def test_stamp_features_and_cover(spark):
    table = stamps.stamp_table(spark)
    f = {r.asset_id: r for r in stamps.stamp_features(table).collect()}
    assert f["OpenCircle"].n_holes >= 1 and "ring" in f["OpenCircle"].tags and f["Circle"].n_holes == 0 and f["Circle"].contour_area_rel_err <= 0.15
    assert all(0 <= r.complexity <= 1 for r in f.values()) and f["Circle"].complexity < f["Star"].complexity
    best = registry.QUERIES["stamp_cover"](spark, SF).collect()
    assert {r.image_id for r in best} == set(rasters.FORMULAS) and all(r.cover >= 0.35 for r in best)


def test_depth_by_hand(spark):
    """Two faces on a canvas of 8 x 8: the left three columns are face 0, a block of four pixels in it is face 1, the rest background."""
    rows = [("i", y, x, 1 if 2 <= y < 4 and 0 <= x < 2 else 0 if x < 3 else -1) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, label int")
    faces = depth.enclosing(stats.region_profile(px), px)
    got = {r.label: (r.score, r.depth) for r in depth.depth_order(faces, raster.border_lengths(px), (8.0, 8.0)).collect()}
    # 20 and 4 pixels; their shared border has 6 sides for either, the background's do not count
    cx0, cy0 = (sum(x for _, y, x, v in rows if v == 0) / 20, sum(y for _, y, x, v in rows if v == 0) / 20)
    r0, r1 = ((cx0 - 4) / 8) ** 2 + ((cy0 - 4) / 8) ** 2, ((0.5 - 4) / 8) ** 2 + ((2.5 - 4) / 8) ** 2
    assert got[0][0] == pytest.approx(0.45 + 0.25 + 0.15 * math.exp(-2.5 * r0) + 0.15)
    # the centroid (0.5, 2.5) of face 1 is rounded up to (1, 3), a pixel of its own
    assert got[1][0] == pytest.approx(0.45 * 0.2 + 0.25 + 0.15 * math.exp(-2.5 * r1) + 0.15)
    assert (got[0][1], got[1][1]) == (0, 1)


def test_majority_takes_the_first_seen_of_equals(spark):
    rows = spark.createDataFrame([("g", 1, "b"), ("g", 2, "a"), ("g", 3, "a"), ("g", 4, "b"), ("h", 1, "z")], "k string, at int, v string")
    assert sorted((r.k, r.v, r.n) for r in stats.majority(rows, ["k"], "v", ["at"]).collect()) == [("g", "b", 2), ("h", "z", 1)]


def test_small_parts_without_neighbours_join_the_mode():
    grid = np.full((9, 9), -1)
    grid[0:3, 0:3], grid[6:9, 0:3], grid[4, 7] = 2, 1, 0
    grid[6, 0] = -1
    assert kernels.merge_small(grid, 3)[4, 7] == 2


def test_components_equal_search(spark):
    rng = np.random.default_rng(1)
    grid = rng.integers(-1, 2, (40, 37))
    grid[5:35, 20] = 1
    rows = [("i", y, x, int(grid[y, x])) for y in range(40) for x in range(37)] + [("j", y, x, 0) for y, x in ((0, 0), (0, 2), (1, 1), (2, 0), (5, 5), (5, 6))]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, label int")
    got = {(r.image_id, r.y, r.x): r.component for r in components.components(px).collect()}
    want = kernels.components4(grid)
    assert all(got.get(("i", y, x), -1) == want[y, x] for y in range(40) for x in range(37))
    assert [got["j", y, x] for y, x in ((0, 0), (0, 2), (1, 1), (2, 0), (5, 5), (5, 6))] == [0, 1, 2, 3, 4, 4]


def test_half_edges_close(spark):
    px = rasters.formula_rasters(spark)
    edges = halfedges.half_edges(px)
    assert halfedges.unbalanced(edges).count() == 0
    found = {(r.image_id, r.face): (r.n, r.holes, r.area) for r in halfedges.face_cycles(px).groupBy("image_id", "face").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").alias("area")).collect()}
    assert found["ring96", 0] == (2, 1, 3260.0) and found["split64", 0] == (1, 0, 2048.0) and found["diskbg64", 0] == (2, 1, 64 * 64 - 1313.0)
    touching = spark.createDataFrame([("t", 0, 0, 0), ("t", 0, 1, -1), ("t", 1, 0, -1), ("t", 1, 1, 0)], "image_id string, y int, x int, label int")
    assert sorted(r.length for r in halfedges.face_cycles(touching).collect()) == [4, 4]  # parts that touch in a corner stay apart


def test_robust_chamfer(spark):
    a, b = np.array([[0.0, 0], [0, 1]]), np.array([[3.0, 0], [20, 0]])
    frame = lambda p: spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in enumerate(p)], "s string, id int, x double, y double")
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    loss = lambda v: np.where(v < 8, v * v / 16, v - 4).mean()
    got = matching.chamfer(frame(a), frame(b), "s", 2.0, "huber").first().chamfer
    assert got == pytest.approx(loss(d.min(1)) + loss(d.min(0)))


def test_feature_store_builds_only_what_is_missing(spark, tmp_path):
    asked, store = [], str(tmp_path / "store")
    def compute(missing):
        asked.append(sorted(r.asset_id for r in missing.select("asset_id").collect()))
        return missing.select("asset_id", F.length("asset_id").alias("n"))
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "asset_id string")
    documents.build_incrementally(spark, ids("a", "b"), store, compute)
    assert documents.build_incrementally(spark, ids("a", "b", "c"), store, compute).count() == 3
    assert asked == [["a", "b"], ["c"]]


def test_documents_round_trip(spark):
    body = '[{"asset":"Circle.svg","top":1,"left":2,"height":3,"width":4,"fill":"#abc","more":1},{"asset":"Line","top":1,"left":2,"height":0,"width":4,"fill":"red"}]'
    rows = documents.parse_documents(spark.createDataFrame([("d", body)], "doc_id string, body string"))
    first, second = rows.orderBy("idx").collect()
    assert (first.asset, first.fill, first.opacity, first.problem) == ("Circle", "#AABBCC", 1.0, None) and second.problem == "fill is not a colour"
    again = documents.parse_documents(documents.document_bodies(rows))
    assert again.orderBy("idx").collect() == [first, second]


def test_empty_inputs(spark):
    px = rasters.formula_rasters(spark).where("false")
    assert stats.region_profile(px).count() == raster.border_lengths(px).count() == regions.components(px).count() == 0
    assert labels.fill_gaps_round(px).count() == 0


def test_turns_at_the_edges_of_bins(spark):
    rings = [(u, k, float(k), round(k * (u + 1) * 0.11, 2)) for u in range(400) for k in range(5)]
    turns = paths.turn_angles(spark.createDataFrame(rings, "by long, pos int, x double, y double").repartition(3), "by", "pos")
    got = {r.bin: r.n for r in stats.angle_histogram(turns.withColumn("all", F.lit(1)), ["all"], "turn").collect()}
    want: dict[int, int] = {}
    for u in range(400):
        ring = [r[2:] for r in rings[5 * u : 5 * u + 5]]
        for (bx, by), (x, y), (nx, ny) in zip(ring[-1:] + ring, ring, ring[1:] + ring[:1]):
            t = math.atan2(ny - y, nx - x) - math.atan2(y - by, x - bx) + math.pi
            t = t - 2 * math.pi * math.floor(t / (2 * math.pi)) - math.pi
            b = min(math.floor((t + math.pi) / (2 * math.pi / 24)) + 1, 24)
            want[b] = want.get(b, 0) + 1
    assert got == want
    odd = stats.angle_histogram(spark.sql("SELECT 1 AS all, t FROM VALUES (CAST('NaN' AS DOUBLE)), (NULL), (pi()), (-pi()) AS v(t)"), ["all"], "t")
    assert {r.bin: r.n for r in odd.collect()} == {1: 1, 24: 3}


def test_polar_order_does_not_depend_on_how_rows_arrive(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.uniform(-1, 1, 400) * 10.0 ** rng.integers(-3, 16, 400), 3).tolist()
    total = 0.0
    for v in y:
        total += v
    mean = total / len(y)
    angle = [math.atan2(v - mean, k - (len(y) - 1) / 2) for k, v in enumerate(y)]
    want = {k: (angle[k], place) for place, k in enumerate(sorted(range(len(y)), key=lambda k: (angle[k], k)), 1)}
    rows = [(1, k, float(k), v) for k, v in enumerate(y)]
    for seed in (1, 2):
        mixed = spark.createDataFrame([rows[k] for k in np.random.default_rng(seed).permutation(len(y))], "by long, pos int, x double, y double")
        assert {r.pos: (r.angle, r.place) for r in selection.polar_order(mixed, "by", "pos").collect()} == want


@pytest.mark.parametrize("ratio", [0.7, 1.0])
def test_duplicate_rings_equal_brute_force(spark, ratio):
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), 0.0, 5e-7, 70.0, 100.0, 49.0]
    areas = [odd[k] if k < len(odd) else float(np.round(a, 1)) for k, a in zip(rng.integers(0, 40, 300).tolist(), rng.uniform(20, 200, 300) * rng.choice([1, -1], 300))]
    rows = [("ab"[k % 2], int(r), float(rng.integers(0, 5) * 2), float(rng.integers(0, 9)), a) for k, (r, a) in enumerate(zip(rng.permutation(300), areas))]
    rows += [("c", r, x, 1.0, 5.0) for r, x in enumerate([1e300, 1e300, float("inf"), float("inf"), float("nan")])]
    df = spark.createDataFrame(rows, "image_id string, ring long, cx double, cy double, area double")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE r (image_id VARCHAR, ring BIGINT, cx DOUBLE, cy DOUBLE, area DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", rows)
    small, large = "least(abs(a.area), abs(b.area))", "greatest(abs(a.area), abs(b.area))"
    want = con.execute(f"""SELECT b.image_id, b.ring, min(a.ring) FROM r a JOIN r b ON a.image_id = b.image_id AND a.ring < b.ring AND sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) <= 3
        AND ({small} < 1e-6 OR {small} / {large} >= {ratio}) GROUP BY 1, 2""").fetchall()
    assert sorted(map(tuple, selection.duplicate_rings(df, least_ratio=ratio).collect())) == sorted(want) and len(want) > 40


def test_duplicate_rings_of_one_place_do_not_meet_in_pairs(spark):
    """40,000 rings on two centroids have 8e8 pairs; areas fall into ranges that are alike in part."""
    n = 40_000
    area = F.pow(F.lit(1.00002), F.col("id"))
    rings = spark.range(n).select(F.lit("i").alias("image_id"), F.col("id").alias("ring"), (F.col("id") % 2).cast("double").alias("cx"), F.lit(0.0).alias("cy"), area.alias("area"))
    rings = rings.cache()
    areas = np.array([r.area for r in rings.orderBy("ring").collect()])
    first = [int(np.flatnonzero(areas[: k + 1] / areas[k] >= 0.7)[0]) for k in range(0, n, 997)]
    got = {r.ring: r.first_ring for r in selection.duplicate_rings(rings).collect()}
    assert [got.get(k, k) for k in range(0, n, 997)] == first and len(got) == n - 1


FAST = ["edge_roles", "recall_formulas", "unique_concat", "duplicate_rings", "face_cap", "affine_sample", "face_cycles", "random_sample", "region_profile", "region_borders", "colour_stats", "gradient", "majority_type", "role_runs", "resample", "painter_fold", "leave_one_out", "budget_limit", "props_json", "score_formulas", "coverage", "layer_documents"]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    df = registry.QUERIES[name](spark, SF)
    got = sorted([tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=str)
    cur = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted([tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()], key=str)
    assert sorted(df.columns) == sorted(cols) and got == want
