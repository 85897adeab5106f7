"""Layer documents as JSON, stamp files as SVG, the stamp feature store as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layers import LAYER, normalise_layers


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), idx (painter order, 0 at the bottom) and the layer's fields; unknown fields are ignored."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    text = raw.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("doc_id"), F.decode("content", "UTF-8").alias("body"))
    return parse_documents(text)


def parse_documents(text: DataFrame) -> DataFrame:
    """doc_id and body (a JSON list of layers) to one row per layer, defaults filled in, with ``problem``."""
    layers = F.from_json("body", T.ArrayType(LAYER))
    rows = text.select("doc_id", F.posexplode(layers).alias("idx", "layer")).select("doc_id", "idx", "layer.*")
    return normalise_layers(rows)


def document_bodies(layers: DataFrame) -> DataFrame:
    """doc_id, body: each document as one JSON list in painter order."""
    fields = [f.name for f in LAYER.fields]
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("layer"))))
    return layers.groupBy("doc_id").agg(F.to_json(F.transform(ordered, lambda s: s["layer"])).alias("body"))


def write_documents(layers: DataFrame, path: str) -> None:
    """One folder per document holding its JSON and a final line feed."""
    document_bodies(layers).write.mode("overwrite").partitionBy("doc_id").text(path)


def stamp_files(spark: SparkSession, path: str) -> DataFrame:
    """asset_id, path, native_w, native_h of the SVG files of a folder: the viewBox, else width and height."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path)
    return svg_sizes(raw.select(F.regexp_extract("path", r"([^/]+)\.svg$", 1).alias("asset_id"), "path", F.decode("content", "UTF-8").alias("svg")))


def svg_sizes(files: DataFrame) -> DataFrame:
    number = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    box = rf"viewBox\s*=\s*[\"']\s*{number}[\s,]+{number}[\s,]+{number}[\s,]+{number}"

    def size(group: int, name: str):
        viewed = F.regexp_extract("svg", box, group)
        plain = F.regexp_extract("svg", rf"<svg[^>]*\s{name}\s*=\s*[\"']\s*{number}(?:px)?\s*[\"']", 1)
        return F.coalesce(F.nullif(viewed, F.lit("")).cast("double"), F.nullif(plain, F.lit("")).cast("double"))

    return files.select("asset_id", "path", size(3, "width").alias("native_w"), size(4, "height").alias("native_h"))


def resolve_assets(layers: DataFrame, stamps: DataFrame) -> DataFrame:
    """``layers`` with asset_id: the stamp of that name, else of that name without regard to case; null if there is none.

    Stamps are a library of some hundreds; the join's side is broadcast by its size.
    """
    exact = stamps.select(F.col("asset_id").alias("_exact"))
    folded = stamps.groupBy(F.lower("asset_id").alias("_lower")).agg(F.min("asset_id").alias("_folded"))
    named = layers.withColumn("_name", F.regexp_replace("asset", r"(?i)\.svg$", ""))
    joined = named.join(exact, F.col("_name") == F.col("_exact"), "left").join(folded, F.lower("_name") == F.col("_lower"), "left")
    return joined.withColumn("asset_id", F.coalesce("_exact", "_folded")).drop("_name", "_exact", "_lower", "_folded")


def build_incrementally(spark: SparkSession, wanted: DataFrame, store: str, compute, key: str = "asset_id") -> DataFrame:
    """Rows of ``wanted`` keys from the Parquet store; those it lacks, or has with a null field, are computed and appended."""
    try:
        kept = spark.read.parquet(store)
        whole = kept.dropna("any").dropDuplicates([key])
    except Exception as e:  # a store that does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        whole = None
    missing = wanted if whole is None else wanted.join(whole.select(key), key, "left_anti")
    if missing.limit(1).count():
        compute(missing).write.mode("append").parquet(store)
        whole = spark.read.parquet(store).dropna("any").dropDuplicates([key])
    return whole.join(wanted.select(key).distinct(), key, "left_semi")
