"""Folders of files as content-addressed snapshots."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..functions import vocabulary as V


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC7: relative_path, content_hash, size_bytes, content of the files below root that count as code."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= V.MOST_FILE_BYTES)
    start = root if "://" in root or root.startswith("file:") else f"file:{root}"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + start.replace("file:///", "file:/").rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), "content", "path", F.col("modificationTime").alias("modified_at"))
    parts = F.split("relative_path", "/")
    skipped = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*V.SKIPPED_DIRS))
    ending = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    return rows.filter(~skipped & ~ending.isin(*V.SKIPPED_EXTENSIONS))


@F.pandas_udf(BinaryType())
def gzipped(content: pd.Series) -> pd.Series:
    return content.map(lambda b: gzip.compress(b, mtime=0))


def new_blobs(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SNK4: contents that aren't stored yet, once each; larger ones compressed."""
    rows = files.dropDuplicates(["content_hash"])
    rows = rows.join(existing.select("content_hash"), "content_hash", "left_anti") if existing is not None else rows
    large = F.col("size_bytes") > V.GZIP_ABOVE
    return rows.select("content_hash", F.when(large, gzipped("content")).otherwise(F.col("content")).alias("content"), large.alias("is_compressed"))


def new_snapshots(snapshots: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK5, FLT17: snapshots not there yet by path, type and (null-safe) session; empty ones are left out."""
    same = [snapshots[c].eqNullSafe(existing[c]) for c in ("source_path", "snapshot_type", "session_id")]
    return snapshots.filter("file_count > 0").join(existing, same, "left_anti")


def trash_folders(files: DataFrame) -> DataFrame:
    """SRC14: files grouped by their top folder, with the project it stands for."""
    top: Column = F.split("relative_path", "/")[0]
    return files.filter(F.instr("relative_path", "/") > 0).withColumns({"folder": top, "project_id": T.trash_project(top)})


def snapshots_of(files: DataFrame, key: list[str]) -> DataFrame:
    """AGG20: one row per snapshot (key columns) with file_count and total_bytes. files: key, size_bytes."""
    return files.groupBy(*key).agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"))


def session_snapshots(sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNP1: snapshots and files of the outputs folders of eligible audit sessions. sessions: session_id, project_id, source,
    source_path, ended_at, eligible; files: path (whole), content_hash, size_bytes. A session without files has none."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    own = files.select(plain("path").alias("path"), "content_hash", "size_bytes")
    folder = lambda n: F.regexp_extract("path", r"^(.*?)/outputs/(.+)$", n)
    own = own.select(folder(1).alias("folder"), folder(2).alias("relative_path"), "content_hash", "size_bytes").filter("relative_path <> ''")
    which = sessions.filter("source = 'cowork' AND eligible").select("session_id", "project_id", plain("source_path").alias("folder"), F.col("ended_at").alias("captured_at"))
    rows = own.join(which, "folder").withColumns({"snapshot_type": F.lit("cowork-outputs"), "source_path": F.concat("folder", F.lit("/outputs"))}).drop("folder")
    return snapshots_of(rows, ["session_id", "project_id", "snapshot_type", "source_path", "captured_at"]), rows.drop("project_id", "captured_at")


def trash_snapshots(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC14, SNP1: snapshots and files of the trash's top folders. files: relative_path, content_hash, size_bytes, modified_at."""
    rows = trash_folders(files).withColumns({
        "session_id": F.lit(None).cast("string"), "snapshot_type": F.lit("trash-snapshot"), "source_path": F.concat(F.lit(root.rstrip("/") + "/"), "folder"),
    }).drop("folder")
    key = ["session_id", "project_id", "snapshot_type", "source_path"]
    made = rows.groupBy(*key).agg(F.max("modified_at").alias("captured_at"))
    return snapshots_of(rows, key).join(made.drop("session_id"), key[1:]), rows.drop("project_id", "modified_at", "content")


def ingest_snapshots(existing: DataFrame, snapshots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK5: what of these is new, with its files."""
    new = new_snapshots(snapshots, existing)
    key = ["source_path", "snapshot_type", "session_id"]
    ids = new.select(*[F.col(c).alias(f"__{c}") for c in key])
    return new, files.join(ids, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_semi")


def file_status(spark: SparkSession, path: str) -> dict:
    """SRC13: whether a path exists, its bytes and time of change in milliseconds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {"exists": False, "size": 0, "modified_ms": None}
    return {"exists": True, "size": fs.getContentSummary(p).getLength(), "modified_ms": fs.getFileStatus(p).getModificationTime()}
