"""A corpus kept as versions of Parquet tables in one folder, and scratch folders that driver and executors share.

Rows once written never change. A version is a manifest that names the folders of each table's parts; it is renamed into
place last. So a write that dies changes nothing, readers keep the version that they opened, and a version that
changes few sessions shares all other parts with the one before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("projects", "sessions", "prompts", "tool_calls", "snapshots", "files", "blobs", "outcomes", "pairs", "failed_pairs", "eval_runs", "eval_cases")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir; only a local session has one of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What deals a table's rows to its parts; tables without one are a single part.
KEYS = {"projects": "project_id", "sessions": "session_id", "prompts": "session_id", "tool_calls": "session_id", "outcomes": "session_id", "pairs": "session_id"}
PARTS = 16
_PART = "__part"


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    """One state of a stored corpus. tables: by name the schema (JSON) and by part the folder of its rows."""

    number: int
    tables: dict[str, dict]


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _hadoop(spark, f"{root}/versions")
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The latest version, or that of a number; an empty one where there is none yet."""
    numbers = version_numbers(spark, root)
    if number is None and not numbers:
        return Version(0, {})
    number = numbers[-1] if number is None else number
    text = spark.read.text(f"{root}/versions/{number:012}.json", wholetext=True).first()["value"]
    return Version(number, json.loads(text))


def commit(spark: SparkSession, root: str, base: Version, tables: dict[str, dict]) -> Version:
    """Makes the version after base: its manifest appears under its name at once and whole, after all rows are written. What
    a writer that fails leaves behind is in no version."""
    new = Version(base.number + 1, base.tables | tables)
    fs, draft = _hadoop(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    _, final = _hadoop(spark, f"{root}/versions/{new.number:012}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(new.tables).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise ConcurrentWrite(f"version {new.number} of {root} is there already")
    return new


def part_of(name: str, columns: list[str]) -> Column:
    key = KEYS.get(name)
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int") if key in columns else F.lit(0)


def write_parts(df: DataFrame, name: str, root: str) -> dict:
    """Writes rows in folders of their own and returns their entry in a manifest."""
    spark, folder = df.sparkSession, f"data/{name}-{uuid.uuid4().hex}"
    df.withColumn(_PART, part_of(name, df.columns)).write.partitionBy(_PART).parquet(f"{root}/{folder}")
    fs, path = _hadoop(spark, f"{root}/{folder}")
    there = [x.getPath().getName() for x in fs.listStatus(path)]
    return {"schema": df.schema.json(), "parts": {n.removeprefix(f"{_PART}="): f"{folder}/{n}" for n in there if n.startswith(f"{_PART}=")}}


def read_parts(spark: SparkSession, root: str, entry: dict, only: list[str] | None = None) -> DataFrame:
    """The rows of a manifest's entry, or of some of its parts."""
    schema = StructType.fromJson(json.loads(entry["schema"]))
    paths = [f"{root}/{p}" for part, p in sorted(entry["parts"].items()) if only is None or part in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def save_corpus(tables: dict[str, DataFrame], root: str) -> None:
    """A new version with these tables; the folder's other tables stay as they are in it."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"no tables of a corpus: {sorted(unknown)}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        base = read_version(spark, root)
        commit(spark, root, base, {name: write_parts(df, name, root) for name, df in tables.items()})


def open_corpus(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """SRC10: the tables of the latest version (or of one) for reading; one that is missing is left out. They stay as they are
    while others write. A folder without versions is read as one of plain tables."""
    version = read_version(spark, root, number)
    if version.number:
        return {t: read_parts(spark, root, version.tables[t]) for t in TABLES if t in version.tables}
    fs, _ = _hadoop(spark, root)
    return {t: spark.read.parquet(f"{root}/{t}") for t in TABLES if fs.exists(_hadoop(spark, f"{root}/{t}")[1])}


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the last versions and the parts that only they have; returns how many parts went. Readers of deleted
    versions fail, and so would a writer that hasn't made its version yet: call it when neither is there."""
    numbers = version_numbers(spark, root)
    used = {p for n in numbers[-keep:] for entry in read_version(spark, root, n).tables.values() for p in entry["parts"].values()}
    for n in numbers[:-keep]:
        fs, path = _hadoop(spark, f"{root}/versions/{n:012}.json")
        fs.delete(path, False)
    fs, data = _hadoop(spark, f"{root}/data")
    folders = [x.getPath() for x in fs.listStatus(data)] if fs.exists(data) else []
    parts = [x.getPath() for f in folders for x in fs.listStatus(f) if x.getPath().getName().startswith(f"{_PART}=")]
    gone = [p for p in parts if f"data/{p.getParent().getName()}/{p.getName()}" not in used]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
