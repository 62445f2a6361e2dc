"""Helpers that the training-data operators share: session facts, table access and durable scratch tables."""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract of this subpackage defines it: blank, tab, LF, VT, FF, CR.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WS_BYTES = b" \t\n\x0b\x0c\r"
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session whose executors are threads of
    the driver (master local) gets one of its own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path for a table or for files in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this session's operators have left in the shared folder, through Hadoop's file system. Results that
    haven't been written or counted yet still read it, so call it between jobs."""
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: it survives lost executors, is written once and is
    compressed, which checkpoint files are not."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with checkpoint(), whose files Spark removes with the last reference to the result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(spark: SparkSession) -> None:
    """Batches of whole texts for Python: Spark's defaults, 10,000 rows and 64 MB, are more than each of several workers of an
    executor should hold at once, as a frame is held several times over. Settings of the session's own stay."""
    for name, default, own in (("maxRecordsPerBatch", "10000", "1500"), ("maxBytesPerBatch", "67108864b", "4m")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)


_LEAN: list[bool] = []


def lean_memory() -> None:
    """For Python workers, which stay for later tasks: large arrays and Arrow buffers go back to the system when they are
    freed, not to a pool of the worker's own."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            mallopt = ctypes.CDLL(None).mallopt
        except (AttributeError, OSError):  # not the GNU library
            return
        for option, value in ((-3, 1 << 17), (-1, 1 << 20)):  # least size of a mapping of its own; free bytes at the heap's end
            mallopt(option, value)


def pieces(total: float, per_piece: float, least: int = 1) -> int:
    return max(least, math.ceil(total / per_piece))


def words_count(text: str = "text"):
    """Number of maximal runs of characters outside ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
