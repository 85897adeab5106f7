"""Per-image operators that need the whole label field: components, holes, palettes, clean-up, planar maps, contours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .components import components


def _grid(image: pa.Table, column: str, fill: float = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = image.column("y").to_numpy(), image.column("x").to_numpy()
    values = image.column(column).to_numpy()
    out = np.full((y.max() + 1, x.max() + 1), fill, values.dtype)
    out[y, x] = values
    return out, y, x


def _by_image(pixels: DataFrame, columns: list[str], kernel, schema: str) -> DataFrame:
    """One image of a canvas's size per group; its rows may come in any order."""
    return pixels.select("image_id", "y", "x", *columns).groupBy("image_id").applyInArrow(kernel, f"image_id string, {schema}")


def _table(image: pa.Table, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"image_id": pa.array([image.column("image_id")[0].as_py()] * n, pa.string()), **columns})


def component_sizes(pixels: DataFrame, label: str = "label") -> DataFrame:
    parts = components(pixels, label)
    return parts.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("pixels"), F.min("y").alias("y0"), F.min("x").alias("x0"))


def holes(pixels: DataFrame, label: str = "label", value: int = 0) -> DataFrame:
    """image_id, hole, pixels: enclosed background of one label, largest first, at most 32."""

    def kernel(image: pa.Table) -> pa.Table:
        grid, _, _ = _grid(image, label)
        found = k.holes(grid == value)
        return _table(image, hole=pa.array(range(len(found)), pa.int32()), pixels=pa.array([int(m.sum()) for m in found], pa.int64()))

    return _by_image(pixels, [label], kernel, "hole int, pixels long")


def kmeans_labels(pixels: DataFrame, n_colours: int = 6, seed: int = 0) -> DataFrame:
    """image_id, y, x, label by k-means in LAB over the subject; background is -1.

    An image's task holds its distinct colours with their counts, not its pixels: 16.7 million rows at most, whatever the image.
    """
    from ..functions.color import rgb_to_lab

    colours = pixels.where("alpha >= 0.5").groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    lab = colours.select("*", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).select("image_id", "r", "g", "b", "n", "lab.*")

    def kernel(image: pa.Table) -> pa.Table:
        image = image.sort_by([("r", "ascending"), ("g", "ascending"), ("b", "ascending")])
        points = np.column_stack([image.column(c).to_numpy() for c in ("lab_l", "lab_a", "lab_b")])
        label = k.kmeans(points, n_colours, seed, weights=image.column("n").to_numpy().astype(float))[1]
        return image.select(["image_id", "r", "g", "b"]).append_column("label", pa.array(label, pa.int32()))

    kind = {f.name: f.dataType.simpleString() for f in pixels.schema}
    found = lab.groupBy("image_id").applyInArrow(kernel, f"image_id string, r {kind['r']}, g {kind['g']}, b {kind['b']}, label int")
    found = found.withColumn("subject", F.lit(True))
    joined = pixels.withColumn("subject", F.col("alpha") >= 0.5).join(found, ["image_id", "r", "g", "b", "subject"], "left")
    return joined.select("image_id", "y", "x", F.coalesce("label", F.lit(-1)).alias("label"))


def clean_labels(pixels: DataFrame, least_frac: float = 0.0015) -> DataFrame:
    """Gaps filled from the nearest label and small components merged into their majority neighbour."""

    def kernel(image: pa.Table) -> pa.Table:
        grid, y, x = _grid(image, "label")
        subject, _, _ = _grid(image, "alpha", 0.0)
        filled = k.fill_gaps(grid, subject >= 0.5)
        merged = k.merge_small(filled, max(1, int(least_frac * grid.size)))
        return _table(image, y=y, x=x, label=merged[y, x].astype(np.int32))

    return _by_image(pixels, ["label", "alpha"], kernel, "y int, x int, label int")


def relax_labels(pixels: DataFrame, palette: list[tuple[float, float, float]], weight: float = 2.5, rounds: int = 5) -> DataFrame:
    """Potts relaxation against a LAB palette; input has lab_l, lab_a, lab_b, edge (0 to 2) and label."""
    colours = np.array(palette, float)

    def kernel(image: pa.Table) -> pa.Table:
        grid, y, x = _grid(image, "label")
        lab = np.stack([_grid(image, c, 0.0)[0] for c in ("lab_l", "lab_a", "lab_b")], 2)
        edge = _grid(image, "edge", 0.0)[0]
        cost = np.sqrt(((lab[:, :, None, :] - colours[None, None]) ** 2).sum(3))
        out = k.potts_relax(grid, cost, edge, weight, rounds)
        return _table(image, y=y, x=x, label=out[y, x].astype(np.int32))

    return _by_image(pixels, ["label", "lab_l", "lab_a", "lab_b", "edge"], kernel, "y int, x int, label int")


def contours(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, label, ring, kind, area, perimeter, points: all rings of every label."""

    def kernel(image: pa.Table) -> pa.Table:
        grid, _, _ = _grid(image, label)
        out: list[tuple] = []
        for value in sorted(set(grid[grid >= 0].tolist())):
            for n, (kind, points) in enumerate(k.rings(grid == value)):
                out.append((value, n, kind, abs(k.signed_area(points)), k.perimeter(points), [{"x": a, "y": b} for a, b in points.tolist()]))
        cols = list(zip(*out)) or [()] * 6
        point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), point)
        return _table(image, **{n: pa.array(c, t) for n, c, t in zip(("label", "ring", "kind", "area", "perimeter", "points"), cols, kinds)})

    return _by_image(pixels, [label], kernel, "label int, ring int, kind string, area double, perimeter double, points array<struct<x:double,y:double>>")


def planar_edges(segments: DataFrame) -> DataFrame:
    """Chains of dual segments: image_id, edge_id, a, b (faces, a < b), length, closed, fitted points.

    Segments of one pair of labels are walked from junctions (corners that more
    than two segments or another pair meet at), then around what is left.
    """

    def kernel(image: pa.Table) -> pa.Table:
        rows = image.select(["x0", "y0", "x1", "y1", "left_label", "right_label"]).to_pylist()
        degree: dict[tuple, int] = {}
        pairs: dict[tuple, set] = {}
        by_pair: dict[tuple, dict[tuple, list[tuple]]] = {}
        for r in rows:
            p, q = (r["x0"], r["y0"]), (r["x1"], r["y1"])
            pair = tuple(sorted((r["left_label"], r["right_label"])))
            for a, b in ((p, q), (q, p)):
                degree[a] = degree.get(a, 0) + 1
                pairs.setdefault(a, set()).add(pair)
                by_pair.setdefault(pair, {}).setdefault(a, []).append(b)
        out: list[tuple] = []
        for pair in sorted(by_pair):
            near = by_pair[pair]
            for ends in near.values():
                ends.sort()
            junctions = sorted(v for v in near if degree[v] != 2 or len(pairs[v]) > 1)
            for start in [*junctions, *sorted(near)]:
                while near.get(start):
                    path, at = [start], start
                    while True:
                        nxt = near[at].pop(0)
                        near[nxt].remove(at)
                        path.append(nxt)
                        at = nxt
                        if at == start or degree[at] != 2 or len(pairs[at]) > 1 or not near[at]:
                            break
                    points = np.array(path, float)
                    fitted = points if path[0] == path[-1] else k.fit_path(points)
                    out.append((len(out), *pair, len(path) - 1, path[0] == path[-1], float(np.hypot(*np.diff(fitted, axis=0).T).sum()), [{"x": a, "y": b} for a, b in fitted.tolist()]))
        cols = list(zip(*out)) or [()] * 7
        point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), point)
        return _table(image, **{n: pa.array(c, t) for n, c, t in zip(("edge_id", "a", "b", "length_px", "closed", "length_fit", "points"), cols, kinds)})

    schema = "image_id string, edge_id int, a int, b int, length_px long, closed boolean, length_fit double, points array<struct<x:double,y:double>>"
    return segments.groupBy("image_id").applyInArrow(kernel, schema)


def planar_vertices(edges: DataFrame) -> DataFrame:
    """image_id, x, y, degree of the ends of open edges, joined on half pixels."""
    ends = edges.where("NOT closed").select("image_id", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("p"))
    half = lambda c: (F.bround(F.col(f"p.{c}") * 2) / 2).alias(c)
    return ends.groupBy("image_id", half("x"), half("y")).agg(F.count(F.lit(1)).alias("degree"))


def planar_problems(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, problem, id: edges of unknown or equal faces and faces without an edge; no rows if the map is whole."""
    sides = edges.select("image_id", "edge_id", F.explode(F.array("a", "b")).alias("label")).where("label >= 0")
    unknown = sides.join(faces, ["image_id", "label"], "left_anti").select("image_id", F.lit("edge of an unknown face").alias("problem"), F.col("edge_id").alias("id"))
    equal = edges.where("a = b").select("image_id", F.lit("edge within a face").alias("problem"), F.col("edge_id").alias("id"))
    bare = faces.join(sides, ["image_id", "label"], "left_anti").select("image_id", F.lit("face without an edge").alias("problem"), F.col("label").alias("id"))
    return unknown.unionAll(equal).unionAll(bare)
