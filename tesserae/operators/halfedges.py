"""Half-edges of label fields: directed unit sides of faces, linked into cycles.

Every side between a face's pixel and what is not that face is a half-edge of
the face, directed so that the face lies on its right (y points down). At each
corner as many half-edges of a face come in as go out, so the directions are
balanced as they are made, and each face's half-edges fall into cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .raster import along_x, along_y


def half_edges(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, face, id, x0, y0, x1, y1, other: the half-edges of all labels >= 0; ``other`` is the label across, -1 beyond the frame.

    ``id`` is unique in the image: four for each pixel, in row-major order.
    """
    own = F.col(label)
    sides = [F.coalesce(f(own).over(w), F.lit(-1)) for f, w in ((F.lag, along_y()), (F.lead, along_x()), (F.lead, along_y()), (F.lag, along_x()))]
    at = pixels.select("image_id", "y", "x", own.alias("face"), *[s.alias(f"s{k}") for k, s in enumerate(sides)])
    x, y = F.col("x"), F.col("y")
    ends = ((x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y))
    made = F.array(*[F.struct(F.lit(k).alias("side"), *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), e)], F.col(f"s{k}").alias("other")) for k, e in enumerate(ends)])
    number = (F.col("y").cast("long") * (1 << 24) + F.col("x")) * 4 + F.col("e.side")
    each = at.where("face >= 0").select("image_id", "y", "x", "face", F.explode(made).alias("e")).where("e.other <> face")
    return each.select("image_id", "face", number.alias("id"), "e.x0", "e.y0", "e.x1", "e.y1", "e.other")


def link(edges: DataFrame) -> DataFrame:
    """``edges`` with next: the half-edge of the same face that goes on from the end, keeping to the same pixel where two do.

    Where two faces' corners touch, the sharpest turn to the right goes on, so parts that touch in a corner stay apart.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    after = edges.select("image_id", "face", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("id").alias("to"), dx.alias("ex"), dy.alias("ey"))
    turn = (F.col("x1") - F.col("x0")) * F.col("ey") - (F.col("y1") - F.col("y0")) * F.col("ex")
    met = edges.join(after, ["image_id", "face", "x1", "y1"])
    best = met.groupBy("image_id", "face", "id").agg(F.min_by("to", -turn).alias("next"))
    return edges.join(best, ["image_id", "face", "id"])


def cycles(linked: DataFrame) -> DataFrame:
    """``linked`` with cycle: the smallest id on the half-edge's cycle, by pointers that double their reach each round."""
    state = written(linked.select("image_id", "id", F.col("next").alias("to"), F.least("id", "next").alias("cycle")), "cycles")
    while True:
        there = state.select("image_id", F.col("id").alias("to"), F.col("to").alias("further"), F.col("cycle").alias("seen"))
        moved = state.join(there, ["image_id", "to"]).select("image_id", "id", F.col("further").alias("to"), F.least("cycle", "seen").alias("cycle"), (F.col("seen") < F.col("cycle")).alias("new"))
        done, state = state, written(moved, "cycles")
        discard(done)
        if state.where("new").isEmpty():
            break
    return linked.join(state.select("image_id", "id", "cycle"), ["image_id", "id"])


def face_cycles(pixels: DataFrame, label: str = "label") -> DataFrame:
    """image_id, face, cycle, length, area: every cycle of every face; area is negative for holes."""
    whole = cycles(link(half_edges(pixels, label)))
    area = F.sum(0.5 * (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")))
    return whole.groupBy("image_id", "face", "cycle").agg(F.count(F.lit(1)).alias("length"), area.alias("area"))


def unbalanced(edges: DataFrame) -> DataFrame:
    """image_id, face, x, y: corners where not as many half-edges of a face come in as go out; no rows for a whole map."""
    ends = edges.select("image_id", "face", F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("n")).unionAll(edges.select("image_id", "face", "x1", "y1", F.lit(-1)))
    return ends.groupBy("image_id", "face", "x", "y").agg(F.sum("n").alias("n")).where("n <> 0").drop("n")
