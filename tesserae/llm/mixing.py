"""Mixing sources to target weights.

Every document gets a hash-random key. The keys of a source are cut into equal
ranges, so a hot source is spread over as many ranges as its rows need; word
counts are summed per range, the range sums are accumulated, and a document's
position in its source is its range's offset plus a running sum inside the
range. Each source is cut at its exact budget: whole epochs first, then the
documents up to the rest, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is used this many times at most.
MAX_EPOCHS = 3
#: Documents that one key range of a source holds on average.
RANGE_ROWS = 4096
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources that share the sum of all sizes by weight, none above ``max_epochs`` sizes.

    Input: source, source_size, one row per source. Output adds target. Sources
    go by code point, null last, and take the weights in turn. Resharing the
    excess by weight until none is above ends at one common level: a source
    gets min(cap, weight * level). In the order of cap / weight the level is
    what is left of the total after the caps before, per weight that is left.

    The order needs all sources side by side: one task sorts a row of some 50
    bytes for each of them, ten million sources in half a gigabyte.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    ranked = sizes.withColumn("n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", "n", weight.alias("weight"), cap.alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = capped.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    # the first source that its cap does not bind sets the level of all that follow
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("level")))).over(whole)
    return levelled.select(
        "source", "source_size", "weight",
        F.coalesce(F.least("cap", F.col("weight") * common["level"]), F.col("cap")).alias("target"),
    )


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Output, a row for each row of ``docs``: doc_id, text_hash, copy (numbers
    rows that agree in both), source, size, source_size, target, taken.

    * Null text has size 0 and takes 0. A null source is a source of its own.
    * Repeated rows are documents of their own. Ties of the key go by doc_id
      and text hash, so reruns agree however the input is partitioned.
    * An empty table, or one without words, takes nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialise(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("text_hash"),
            F.xxhash64("doc_id", text, F.lit(seed)).alias("key"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # a source has as many key ranges as its rows need; one row per source, so this side is broadcast if it is small
    targets = source_targets(totals.select("source", "source_size"), weights, max_epochs)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS)).cast("long")
    sources = targets.join(totals.select(F.col("source").alias("s"), ranges.alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", "ranges"
    )
    keyed = sized.join(sources, sized["source"].eqNullSafe(F.col("s"))).drop("s")
    # the key as a fraction of its 2^64 values, from its upper bits
    part = F.floor((F.shiftrightunsigned("key", 33) * F.col("ranges")) / F.lit(float(1 << 31))).cast("long")
    keyed = keyed.withColumn("part", part)
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "text_hash")
    placed = keyed.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    same = Window.partitionBy("source", "part", "key", "doc_id", "text_hash").orderBy("inside")
    placed = placed.withColumn("copy", F.row_number().over(same))
    placed = placed.join(offsets, placed["source"].eqNullSafe(F.col("s")) & (placed["part"] == F.col("p")))
    start = F.coalesce(F.col("inside"), F.lit(0)) + F.col("offset")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id", "text_hash", "copy", "source", "size", "source_size", "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, its last copy cut to the words taken.

    Columns are those of ``docs`` (doc_id, text, source and any others); a cut
    text ends with its last taken word, and n_chars, if there, is its length.
    Documents of which nothing is taken go, null and empty texts among them.
    Columns of any name are kept; an empty table gives no rows.
    """
    plan = mix_plan(docs, weights, max_epochs, seed).where("taken > 0")
    plan = plan.select(
        F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("text_hash").alias("plan_hash"),
        F.col("copy").alias("plan_copy"), "size", "taken",
    )
    names = docs.columns
    text = F.col("row")["text"]
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")
    )
    # rows that agree in doc_id, source and text are numbered alike on both sides, so that they meet one to one
    others = [F.col("row")[c].cast("string") for c in names if c not in ("doc_id", "source", "text")] or [F.lit(0)]
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "from", "hash").orderBy(*others)))
    joined = rows.join(
        plan,
        F.col("id").eqNullSafe(F.col("plan_id")) & F.col("from").eqNullSafe(F.col("plan_source"))
        & (F.col("hash") == F.col("plan_hash")) & (F.col("copy") == F.col("plan_copy")),
    )
    whole, cut = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    pieces = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))
    joined = joined.select("row", "size", F.explode(pieces).alias("words"))
    text = F.when(F.col("words") == F.col("size"), text).otherwise(_first_words(text, F.col("words")))
    out = {c: F.col("row")[c] for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[col.alias(c) for c, col in out.items()])


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, white space between words as it is."""
    spaced = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(spaced, F.lit(1), n), "")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
