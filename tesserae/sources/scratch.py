"""Frames written to the folder that all executors share, so that lineage ends and rounds do not run again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it, in a folder that goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="tesserae-engine-")
        atexit.register(shutil.rmtree, _folders[app], ignore_errors=True)
    return "file://" + _folders[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/engine-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
