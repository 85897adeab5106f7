"""Layer documents scored as they arrive in a folder (a Spark bonus; nothing here keeps state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import layer_simplicity
from ..sources.documents import parse_documents


def arriving_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and body of every new JSON file, one file a row."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.json$", 1).alias("doc_id"), F.col("value").alias("body"))


def validate_batch(bodies: DataFrame) -> DataFrame:
    """doc_id, n_layers, problems, simplicity."""
    rows = parse_documents(bodies).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_layers"), F.count("problem").alias("problems"))
    return rows.withColumn("simplicity", layer_simplicity(F.col("n_layers")))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is validated as a batch and appended as Parquet; the file log makes it run once per file."""

    def write(batch: DataFrame, _: int) -> None:
        validate_batch(batch).write.mode("append").parquet(out)

    return arriving_documents(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
