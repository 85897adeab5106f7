"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and normalisation rule here: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same rule as a regular expression for one word (Java and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"

_local_root: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting; it then gets a temporary
    folder that is removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, _local_root[app], ignore_errors=True)
    return "file://" + _local_root[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks that read the files again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tesserae-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialised frames that nothing reads any more.

    The shuffles that made them go with the JVM's references, which Spark's own
    cleaner follows up after a collection of garbage.
    """
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tesserae_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that go to a Python worker at a time; each batch is held whole on both sides of the exchange.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of ``BATCH_BYTES``, unless the session has smaller ones.

    Results do not depend on it. Frames run after the function that makes them
    has ended, so the session keeps the setting.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next task of the same operator: one object, whatever else it kept goes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return to the system what allocators can of the memory that is free; they would hold it as long as the Python worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over batches in a Python worker that first drops what is ``kept``, unless ``run`` itself ``keeps`` something, and last gives memory back."""

    @functools.wraps(run)
    def inner(batches):
        if not keeps:
            _kept.clear()
        yield from run(batches)
        give_back()

    return inner


#: Bits of a bitmap of keys, as a power of two: 1 MB, whatever the number of keys.
BITMAP_BITS = 23


def bitmap_of(keys: DataFrame, name: str) -> Callable[[str], Column]:
    """A test, of a fixed size, that is true for every row whose key is in column ``name`` of ``keys``, and for some others.

    It spares most rows without a partner a shuffle; what it lets through
    wrongly, the join after it drops. With very many keys it lets all through.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    bit = keys.select(slot(name).alias("bit"))
    words = bit.groupBy(F.expr("CAST(bit DIV 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        bitmap[r["word"]] = r["bits"]
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def may_be_in(bits: pd.Series) -> pd.Series:
        b = bits.to_numpy()
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    return lambda c: may_be_in(slot(c))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text under ``WORD`` after lower-casing A-Z; None has none.

    ``bytes.lower`` touches A-Z alone and ``bytes.split`` cuts at exactly the
    six characters of ``ASCII_SPACE``.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
