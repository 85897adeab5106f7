"""The stamp library and its features: formula stamps, shape statistics, tags, retrieval, cover search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as k
from .matching import adjusted_recall, complexity, descriptor_distance, recall_score, simplicity, top_k

#: Texture size that a stamp is measured on.
TEXTURE = 128


def _circle(n: int = 96, a: float = 0.5, b: float = 0.5) -> np.ndarray:
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return np.column_stack([a * np.cos(t), b * np.sin(t)])


def formula_stamps() -> dict[str, list[np.ndarray]]:
    """Rings of the basic stamps in the unit box [-.5, .5]; later rings are cut out by the even-odd rule."""
    box = lambda w, h: np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    t = np.linspace(-math.pi / 2, 1.5 * math.pi, 10, endpoint=False)
    r = np.where(np.arange(10) % 2 == 0, 0.5, 0.2)
    half = np.linspace(0, math.pi, 48)
    return {
        "Circle": [_circle()], "Square": [box(1, 1)], "OpenCircle": [_circle(), _circle(96, 0.3, 0.3)], "Oval": [_circle(96, 0.5, 0.3)],
        "Triangle": [np.array([[0, -0.5], [0.5, 0.5], [-0.5, 0.5]])], "RightTriangle": [np.array([[-0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]])],
        "HalfCircle": [np.column_stack([0.5 * np.cos(half), 0.5 - np.sin(half)])], "Line": [box(1, 0.12)],
        "Drop": [np.array([[0, -0.5], *[[0.3 * math.cos(a), 0.2 + 0.3 * math.sin(a)] for a in np.linspace(-0.4, math.pi + 0.4, 40)]])],
        "Star": [np.column_stack([r * np.cos(t), r * np.sin(t)])],
        "Cross": [np.array([[-1, -3], [1, -3], [1, -1], [3, -1], [3, 1], [1, 1], [1, 3], [-1, 3], [-1, 1], [-3, 1], [-3, -1], [-1, -1]]) / 6],
        "L": [np.array([[-0.5, -0.5], [-0.1, -0.5], [-0.1, 0.1], [0.5, 0.1], [0.5, 0.5], [-0.5, 0.5]])],
    }


def stamp_table(spark: SparkSession) -> DataFrame:
    """asset_id, rings: array of arrays of (x, y) points."""
    rows = [(name, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for name, rings in formula_stamps().items()]
    return spark.createDataFrame(rows, "asset_id string, rings array<array<struct<x:double,y:double>>>")


def _mask(rings: list, size: int) -> np.ndarray:
    out = np.zeros((size, size), bool)
    for ring in rings:
        points = np.array([(p["x"], p["y"]) for p in ring])
        out ^= k.fill_polygon((points + 0.5) * size, size, size)
    return out


def measure_mask(mask: np.ndarray) -> dict:
    """Shape statistics of a mask: descriptor, circularity, elongation, area fraction, holes."""
    traced = k.rings(mask)
    outer = max((p for kind, p in traced if kind == "outer"), key=lambda p: abs(k.signed_area(p)))
    inner = [p for kind, p in traced if kind == "hole"]
    ring = k.resample_path(outer, min(256, max(64, len(outer))), closed=True)
    smooth = sum(np.roll(ring, s, 0) for s in range(-2, 3)) / 5
    area, hole_area = abs(k.signed_area(outer)), sum(abs(k.signed_area(p)) for p in inner)
    length = k.perimeter(smooth)
    w, h = np.ptp(outer[:, 0]), np.ptp(outer[:, 1])
    histogram = k.turn_histogram(smooth)
    return {
        "descriptor": [*histogram.tolist(), len(inner) / 8, min(hole_area / max(area, 1), 2.0), min(len(outer) / 256, 2.0)],
        "circularity": float(np.clip(4 * math.pi * max(area - hole_area, 1) / (length**2 + 1e-6), 0, 2)), "elongation": float(max(w / max(h, 1), h / max(w, 1), 1)),
        "area_frac": float(mask.mean()), "n_holes": len(inner), "contour_area_rel_err": float(abs(abs(k.signed_area(smooth)) - area) / max(area, 1)),
    }


def effect_tags(mask: np.ndarray, circularity: float, elongation: float, area_frac: float, n_holes: int) -> list[str]:
    h, w = mask.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    yy, xx = np.mgrid[:h, :w]
    r = np.hypot(yy - cy, xx - cx)
    tags = []
    if area_frac >= 0.35 and circularity >= 0.45 and elongation < 1.8:
        tags.append("solid")
    core = mask[r <= max(2, min(h, w) // 8)].mean()
    band = mask[r <= 0.4 * min(h, w)].mean()
    if n_holes or (core < 0.25 and band > 0.2):
        tags.append("ring")
    angle = np.arctan2(yy - cy, xx - cx)[mask]
    radius = r[mask]
    sector = ((angle + math.pi) / (2 * math.pi) * 72).astype(int) % 72
    reach = np.zeros(72)
    np.maximum.at(reach, sector, radius)
    smooth = sum(np.roll(reach, s) for s in range(-2, 3)) / 5
    peaks = int(((smooth > np.roll(smooth, 1)) & (smooth >= np.roll(smooth, -1)) & (smooth > smooth.mean())).sum())
    star = peaks >= 5 and circularity < 0.7
    if star:
        tags.append("star")
    spread = np.histogram(angle, 16, (-math.pi, math.pi))[0] / max(len(angle), 1)
    radial = (spread.std() < 0.04 and 0.08 < area_frac < 0.55 and star) or (spread.std() < 0.03 and elongation < 1.4 and 0.1 < area_frac < 0.45)
    if radial:
        tags.append("radial")
    if radial or star or (0.15 < area_frac < 0.55 and elongation > 2.5):
        tags.append("gradient_candidate")
    return tags


FEATURES = (
    "asset_id string, descriptor array<double>, circularity double, elongation double, area_frac double, n_holes int, "
    "contour_area_rel_err double, tags array<string>, sdf array<float>, contour array<struct<x:double,y:double>>"
)


def stamp_features(stamps: DataFrame, size: int = TEXTURE) -> DataFrame:
    """The feature store's rows for ``stamps`` (asset_id, rings), with complexity."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mask = _mask(row["rings"], size)
                m = measure_mask(mask)
                tags = effect_tags(mask, m["circularity"], m["elongation"], m["area_frac"], m["n_holes"])
                sdf = k.blur_distance(mask, max(16, min(64, size // 8)))
                out.append({"asset_id": row["asset_id"], **m, "tags": tags, "sdf": sdf.astype(np.float32).ravel().tolist(), "contour": row["rings"][0]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([
        ("asset_id", pa.string()), ("descriptor", pa.list_(pa.float64())), ("circularity", pa.float64()), ("elongation", pa.float64()), ("area_frac", pa.float64()),
        ("n_holes", pa.int32()), ("contour_area_rel_err", pa.float64()), ("tags", pa.list_(pa.string())), ("sdf", pa.list_(pa.float32())),
        ("contour", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
    ])
    rows = stamps.select("asset_id", "rings").mapInArrow(run, FEATURES)
    mean = F.aggregate(F.slice("descriptor", 1, 24), F.lit(0.0), lambda s, x: s + x) / 24
    std = F.sqrt(F.aggregate(F.transform(F.slice("descriptor", 1, 24), lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / 24)
    return rows.withColumn("complexity", complexity(F.col("circularity"), F.col("n_holes"), F.col("elongation"), std, F.col("area_frac")))


def tag_counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def region_features(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, label, descriptor, circularity, elongation, area_frac, n_holes of every region."""

    def kernel(image: pa.Table) -> pa.Table:
        y, x, v = (image.column(c).to_numpy() for c in ("y", "x", label))
        grid = np.full((y.max() + 1, x.max() + 1), -1)
        grid[y, x] = v
        out = [{"image_id": image.column("image_id")[0].as_py(), "label": int(n), **measure_mask(grid == n)} for n in sorted(set(v[v >= 0].tolist()))]
        names = ("image_id", "label", "descriptor", "circularity", "elongation", "area_frac", "n_holes")
        kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.int32())
        return pa.table({n: pa.array([o[n] for o in out], t) for n, t in zip(names, kinds)})

    schema = "image_id string, label int, descriptor array<double>, circularity double, elongation double, area_frac double, n_holes int"
    return pixels.select("image_id", "y", "x", label).groupBy("image_id").applyInArrow(kernel, schema)


#: A library of more stamps than this is not broadcast.
LIBRARY = 20_000


def recall(
    regions: DataFrame, features: DataFrame, n: int = 3, tags: list[str] | None = None, wants_holes: bool | None = None, most_complex: float | None = None, least_fill: float = 0.0
) -> DataFrame:
    """The n best stamps of every region, of those that are no more complex and no emptier than asked for.

    The library is one side of all pairs and is broadcast; its size is checked.
    """
    if features.limit(LIBRARY + 1).count() > LIBRARY:
        raise ValueError(f"a library has at most {LIBRARY} stamps")
    asked = features.where(F.col("area_frac") >= least_fill)
    asked = asked if most_complex is None else asked.where(F.col("complexity") <= most_complex)
    tagged = F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False)
    s = asked.select(
        "asset_id", F.slice("descriptor", 1, 24).alias("s_descriptor"), F.col("circularity").alias("s_circ"), F.col("elongation").alias("s_elong"), "n_holes",
        "complexity", F.col("area_frac").alias("s_fill"), tagged.alias("tagged"),
    )
    fill = F.least(F.col("area_frac") * F.lit(4.0), F.lit(1.0))
    r = regions.select(
        "image_id", "label", F.slice("descriptor", 1, 24).alias("r_descriptor"), F.col("circularity").alias("r_circ"), F.col("elongation").alias("r_elong"),
        F.col("area_frac").alias("r_area"), simplicity(F.col("circularity"), F.col("elongation"), fill, F.col("area_frac")).alias("r_simple"),
    )
    pairs = r.join(F.broadcast(s))
    d = descriptor_distance(F.col("r_descriptor"), F.col("s_descriptor"))
    plain = recall_score(d, F.col("r_circ") - F.col("s_circ"), F.col("r_elong"), F.col("s_elong"))
    wants = F.lit(wants_holes).cast("boolean")
    scored = pairs.withColumn("score", adjusted_recall(plain, F.col("complexity"), F.col("s_fill"), F.col("n_holes"), F.col("tagged"), F.col("r_simple"), F.col("r_area"), wants))
    return top_k(scored, ["image_id", "label"], "score", "asset_id", n).select("image_id", "label", "asset_id", "score", "rank")


#: Gains below which the first and a later stamp are not taken, and leaks above which they are not unless cover grows by the least.
FIRST_GAIN, LATER_GAIN, FIRST_LEAK, LATER_LEAK, GROWTH = 0.08, 0.007, 0.72, 0.70, 0.02
#: Poses of a step that are refined.
REFINED = 3


def outline_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance between the border pixels of two masks, both ways; the diagonal if one is empty."""

    def border(mask: np.ndarray) -> np.ndarray:
        p = np.pad(mask, 1)
        return np.argwhere(mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]))

    p, q = border(a), border(b)
    if not len(p) or not len(q):
        return math.hypot(*a.shape)
    least_p, least_q = [], np.full(len(q), np.inf)
    for k in range(0, len(p), 512):  # a bounded block of distances at a time
        d = np.hypot(p[k : k + 512, 0][:, None] - q[:, 0], p[k : k + 512, 1][:, None] - q[:, 1])
        least_p.append(d.min(1))
        least_q = np.minimum(least_q, d.min(0))
    return float(np.concatenate(least_p).mean() + least_q.mean()) / 2


def cover_regions(
    pixels: DataFrame, recalled: DataFrame, stamps: DataFrame, most: int = 5, particles: int = 32, least_cover: float = 0.9, seed: int = 0, refine: int = 3
) -> DataFrame:
    """image_id, label, step, asset_id, left, top, width, height, angle, cover, leak: stamps laid greedily over every region.

    A region is one task's group: its mask, the outlines of its recalled
    stamps, and poses drawn around its largest uncovered part. The poses with
    the best gain less leak are refined by ever smaller steps; of those that
    pass the limits of gain and leak the one whose union has the nearest
    outline, the best cover and the least leak is taken. Only chosen poses leave the task.
    """
    chosen = recalled.join(F.broadcast(stamps.select("asset_id", "rings")), "asset_id").select("image_id", "label", "asset_id", "rank", "rings")

    def kernel(key: tuple, region: pa.Table, candidates: pa.Table) -> pa.Table:
        if not region.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        y, x = region.column("y").to_numpy(), region.column("x").to_numpy()
        size = int(region.column("size")[0].as_py())
        target = np.zeros((size, size), bool)
        target[y, x] = True
        area = int(target.sum())
        outlines = {c["asset_id"]: [np.array([(p["x"], p["y"]) for p in ring]) for ring in c["rings"]] for c in sorted(candidates.to_pylist(), key=lambda c: c["rank"])}
        rng = np.random.default_rng([seed, int(key[1].as_py()), size])
        union, cover, gap, out = np.zeros_like(target), 0.0, math.inf, []

        def tried(asset: str, pose: tuple, rest: np.ndarray) -> tuple[float, str, tuple, np.ndarray]:
            m = np.logical_xor.reduce([k.stamp_mask(ring, size, *pose) for ring in outlines[asset]])  # inner rings are holes
            return ((m & rest).sum() - 0.8 * (m & ~target).sum()) / area, asset, pose, m

        for step in range(most):
            rest = target & ~union
            if rest.sum() < max(10, 0.015 * area):
                break
            parts = k.components4(np.where(rest, 0, -1))
            ry, rx = np.nonzero(parts == np.bincount(parts[parts >= 0]).argmax())
            w, h = np.ptp(rx) + 1, np.ptp(ry) + 1
            found = []
            for asset in outlines:
                found.append(tried(asset, ((rx.min() + rx.max() + 1) / 2, (ry.min() + ry.max() + 1) / 2, float(w), float(h), 0.0), rest))
                for n in range(1, particles):
                    j = rng.normal(size=5)
                    pose = (rx.mean() + 0.5 + 0.08 * w * j[0], ry.mean() + 0.5 + 0.08 * h * j[1], w * math.exp(0.15 * j[2]), h * math.exp(0.15 * j[3]), 90.0 * (n % 4) + 12 * j[4])
                    found.append(tried(asset, pose, rest))
            found = sorted(found, key=lambda f: -f[0])[:REFINED]
            for turn in range(refine):
                reach = 0.5 ** (turn + 1)
                for n, (_, asset, (left, top, width, height, angle), _) in enumerate(found):
                    for j in rng.normal(size=(8, 5)) * reach:
                        near = tried(asset, (left + 0.06 * w * j[0], top + 0.06 * h * j[1], width * math.exp(0.1 * j[2]), height * math.exp(0.1 * j[3]), angle + 8 * j[4]), rest)
                        found[n] = max(found[n], near, key=lambda f: f[0])
            best = None
            for _, asset, pose, m in found:
                trial, gain = union | m, (m & rest).sum() / area
                now, leak = (trial & target).sum() / area, (trial & ~target).sum() / max(trial.sum(), 1)
                if gain < (LATER_GAIN if step else FIRST_GAIN) or (leak > (LATER_LEAK if step else FIRST_LEAK) and now < cover + GROWTH):
                    continue
                distance = outline_gap(trial, target)
                order = (distance + 2.2 * (1 - now) + 0.8 * max(0.0, leak - 0.25), cover - now, leak)
                if best is None or order < best[0]:
                    best = (order, asset, pose, trial, now, leak, distance)
            if best is None or (step and best[4] < cover + 1e-4 and best[6] > 0.995 * gap):
                break
            _, asset, pose, union, cover, leak, gap = best
            out.append((key[0].as_py(), key[1].as_py(), step, asset, *map(float, pose), float(cover), float(leak)))
            if cover >= least_cover:
                break
        cols = list(zip(*out)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds)})

    names = ("image_id", "label", "step", "asset_id", "left", "top", "width", "height", "angle", "cover", "leak")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 7)
    schema = "image_id string, label int, step int, asset_id string, left double, top double, width double, height double, angle double, cover double, leak double"
    size = pixels.groupBy("image_id").agg((F.greatest(F.max("y"), F.max("x")) + 1).alias("size"))
    sized = pixels.where("label >= 0").join(F.broadcast(size), "image_id").select("image_id", "label", "y", "x", "size")
    return sized.groupBy("image_id", "label").cogroup(chosen.groupBy("image_id", "label")).applyInArrow(kernel, schema)


def render_layers(layers: DataFrame, stamps: DataFrame, size: int, factor: int = 2) -> DataFrame:
    """doc_id, y, x, idx, a, r, g, b: the pixels each layer covers, alpha by supersampled boxes, clockwise rotation."""
    rings = stamps.select(F.col("asset_id").alias("asset"), "rings")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                c, s = math.cos(math.radians(row["angle"])), math.sin(math.radians(row["angle"]))
                mask = np.zeros((size * factor, size * factor), bool)
                for ring in row["rings"]:
                    p = np.array([(q["x"], q["y"]) for q in ring]) * [-1 if row["flipX"] else 1, -1 if row["flipY"] else 1] * [row["width"], row["height"]]
                    turned = np.column_stack([row["left"] + c * p[:, 0] - s * p[:, 1], row["top"] + s * p[:, 0] + c * p[:, 1]])
                    mask ^= k.fill_polygon(turned * factor, size * factor, size * factor)
                alpha = mask.reshape(size, factor, size, factor).mean((1, 3)) * row["opacity"]
                y, x = np.nonzero(alpha)
                rgb = [int(row["fill"][n : n + 2], 16) for n in (1, 3, 5)]
                out.append(pd.DataFrame({"doc_id": row["doc_id"], "y": y.astype(np.int32), "x": x.astype(np.int32), "idx": np.int32(row["idx"]), "a": alpha[y, x], **{n: float(v) for n, v in zip("rgb", rgb)}}))
            frame = pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "y", "x", "idx", "a", "r", "g", "b"])
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    arrow = pa.schema([("doc_id", pa.string()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32()), ("a", pa.float64()), ("r", pa.float64()), ("g", pa.float64()), ("b", pa.float64())])
    joined = layers.join(F.broadcast(rings), "asset").select("doc_id", "idx", "left", "top", "width", "height", "angle", "opacity", "flipX", "flipY", "fill", "rings")
    return joined.mapInArrow(run, "doc_id string, y int, x int, idx int, a double, r double, g double, b double")
