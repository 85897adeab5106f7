"""Layer documents: ordered folds (painter compositing), pruning, runs, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import HEX, normalise_hex

LAYER = T.StructType(
    [
        T.StructField("asset", T.StringType()), T.StructField("opacity", T.DoubleType()), T.StructField("angle", T.DoubleType()),
        T.StructField("flipX", T.BooleanType()), T.StructField("flipY", T.BooleanType()), T.StructField("top", T.DoubleType()),
        T.StructField("left", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("width", T.DoubleType()),
        T.StructField("fill", T.StringType()), T.StructField("selectable", T.BooleanType()),
    ]
)
REQUIRED = ("asset", "top", "left", "height", "width", "fill")


def over_fold(layers: DataFrame, by: list[str], order: str, alpha: str, colours: list[str]) -> DataFrame:
    """Bottom-to-top ``over`` compositing of each group, as an aggregate.

    A layer shows with its alpha times the transparency of all above it, so the
    fold is a sum over one descending running product; nothing is collected.
    Outputs the premultiplied ``colours`` and ``alpha``.
    """
    shown = visible_weight(layers, by, order, alpha)
    weight = F.col("weight")
    return shown.groupBy(*by).agg(*[F.sum(F.col(c) * weight).alias(c) for c in colours], F.sum(weight).alias("alpha"))


def visible_weight(layers: DataFrame, by: list[str], order: str, alpha: str) -> DataFrame:
    """``layers`` with weight = alpha_i times the product of (1 - alpha_j) over the layers j above."""
    above = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    clear = 1.0 - F.col(alpha)
    # an opaque layer hides all below it; logarithms of the others
    hidden = F.coalesce(F.max((clear <= 0).cast("int")).over(above), F.lit(0))
    through = F.when(hidden == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(clear > 0, F.ln(clear)).otherwise(0.0)).over(above), F.lit(0.0))))
    return layers.withColumn("weight", F.col(alpha) * through)


def layer_contributions(layers: DataFrame, by: list[str], order: str, alpha: str, colours: list[str]) -> DataFrame:
    """How much the composite changes when one layer alone is left out: |d rgb| (Euclidean) and |d alpha|.

    Without layer i, everything below it shows 1 / (1 - alpha_i) times more, so
    all leave-one-out composites come from one pass of running sums. Layers
    must not be wholly opaque here (their removal uncovers what the sums have
    already lost); ``prune`` handles those by folding again.
    """
    w = visible_weight(layers, by, order, alpha)
    below = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gain = F.col(alpha) / (1.0 - F.col(alpha))
    change = [F.col(c) * F.col("weight") - gain * F.coalesce(F.sum(F.col(c) * F.col("weight")).over(below), F.lit(0.0)) for c in colours]
    change_alpha = F.col("weight") - gain * F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    return w.withColumn("d_rgb", F.sqrt(sum((d * d for d in change), F.lit(0.0)))).withColumn("d_alpha", F.abs(change_alpha))


def leave_one_out(layers: DataFrame, by: list[str], order: str, alpha: str, colours: list[str]) -> DataFrame:
    """The same by folding each group once for every layer left out; exact for opaque layers too.

    A document has at most ``BUDGET`` layers, so a group grows by that factor at most.
    """
    held = layers.select(*by, F.col(order).alias("held"))
    each = layers.join(held, by).where(F.col(order) != F.col("held"))
    without = over_fold(each, [*by, "held"], order, alpha, colours)
    whole = over_fold(layers, by, order, alpha, colours)
    renamed = whole.select(*by, *[F.col(c).alias(f"w_{c}") for c in [*colours, "alpha"]])
    both = held.join(renamed, by).join(without, [*by, "held"], "left")
    diff = [F.col(f"w_{c}") - F.coalesce(F.col(c), F.lit(0.0)) for c in colours]
    return both.select(
        *by, F.col("held").alias(order), F.sqrt(sum((d * d for d in diff), F.lit(0.0))).alias("d_rgb"), F.abs(F.col("w_alpha") - F.coalesce("alpha", F.lit(0.0))).alias("d_alpha")
    )


#: Layers of a document.
BUDGET = 40
#: A layer must change the picture by this much on average.
PRUNE_AT = 0.004


def prune(pixel_layers: DataFrame, doc: str = "doc_id", order: str = "idx", eps: float = PRUNE_AT) -> DataFrame:
    """doc, order, contribution, kept: mean over pixels of |d rgb| / 255 + |d alpha| without the layer.

    Input: doc, y, x, order, a, r, g, b (a row for each pixel that a layer
    covers). All layers are held out of the full stack at once, so two equal
    layers go together; if all would go, the first stays.
    """
    change = leave_one_out(pixel_layers, [doc, "y", "x"], order, "a", ["r", "g", "b"])
    area = pixel_layers.groupBy(doc).agg(F.count_distinct("y", "x").alias("area"))
    total = change.groupBy(doc, order).agg(F.sum(F.col("d_rgb") / 255.0 + F.col("d_alpha")).alias("change"))
    scored = total.join(area, doc).select(doc, order, (F.col("change") / F.col("area")).alias("contribution"))
    whole = Window.partitionBy(doc)
    first = (F.max("contribution").over(whole) < eps) & (F.col(order) == F.min(order).over(whole))
    return scored.withColumn("kept", (F.col("contribution") >= eps) | first)


def fill_runs(layers: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, run, value, first, last, n: maximal runs of equal values, compared without case."""
    w = Window.partitionBy(by).orderBy(order)
    v = F.lower(value)
    change = (~v.eqNullSafe(F.lag(v).over(w))).cast("int")
    run = layers.withColumn("_change", change).withColumn("run", F.sum("_change").over(w) - 1)
    return run.groupBy(by, "run").agg(F.min_by(value, order).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def within_budget(rows: DataFrame, by: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows of each group, in order, while their running cost stays within the budget."""
    running = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def missing_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``known`` does not have."""
    return rows.select(F.col(key).alias("missing")).distinct().join(known.select(F.col(known_key).alias("missing")), "missing", "left_anti")


def normalise_layers(layers: DataFrame) -> DataFrame:
    """Defaults filled in, fills normalised, and ``problem`` for what breaks a rule (null if none)."""
    d = {"opacity": 1.0, "angle": 0.0, "flipX": False, "flipY": False, "selectable": True}
    filled = layers.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in d.items()})
    filled = filled.withColumn("fill", F.coalesce(normalise_hex(F.col("fill")), F.col("fill"))).withColumn("asset", F.regexp_replace("asset", r"(?i)\.svg$", ""))
    absent = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUIRED]
    rules = [
        F.when(~F.col("fill").rlike(HEX), F.lit("fill is not a colour")), F.when(~F.col("opacity").between(0, 1), F.lit("opacity is not within 0 and 1")),
        F.when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit("size is not positive")), F.when(F.length("asset") == 0, F.lit("asset is empty")),
    ]
    return filled.withColumn("problem", F.coalesce(*absent, *rules))


def discrete_angle(angle: Column) -> Column:
    """0 or 90: folded to [0, 180), 45 to below 135 is 90."""
    folded = F.pmod(angle, F.lit(180.0))
    return F.when(folded >= 135, 0.0).when(folded >= 45, 90.0).otherwise(0.0)


def nearest_angle(angle: Column, allowed: list[float]) -> Column:
    """The allowed angle nearest around the circle, the first of equals."""
    gap = lambda a: F.abs(F.pmod(angle - a + 180.0, F.lit(360.0)) - 180.0)
    return F.array_min(F.array(*[F.struct(gap(a).alias("d"), F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(allowed)]))["a"]


def canvas_points(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column, angle: Column, flip_x: Column, flip_y: Column) -> Column:
    """struct(x, y): a point of the unit box turned clockwise (y points down) onto the canvas."""
    sx = F.when(flip_x, -x).otherwise(x) * width
    sy = F.when(flip_y, -y).otherwise(y) * height
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.struct((left + c * sx - s * sy).alias("x"), (top + s * sx + c * sy).alias("y"))
