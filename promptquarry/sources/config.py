"""Configuration, environment files and context files of a project."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

FILE_NAME = ".promptquarry.json"
DEFAULTS = {
    "contextFiles": list(V.CONTEXT_ORDER),
    "enabledChecks": list(V.ENABLED_CHECKS),
    "autoInject": True,
    "confirmBeforeSend": True,
    "maxContextTokens": V.MOST_CONTEXT_TOKENS,
    "corpusPath": None,
}


def load_config(folder: str, given: dict | None = None, file_name: str = FILE_NAME) -> dict:
    """SRC9: defaults, then the folder's file, then what is given; an unreadable file counts as empty."""
    try:
        with open(os.path.join(folder, file_name), encoding="utf-8") as f:
            own = json.load(f)
    except (OSError, ValueError):
        own = {}
    return DEFAULTS | (own if isinstance(own, dict) else {}) | (given or {})


def load_env(path: str, env: dict | None = None) -> dict:
    """SRC12: NAME=value lines; a value that is set and not empty wins over the file's."""
    env = dict(os.environ if env is None else env)
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return env
    for line in lines:
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#") and not env.get(m[1]):
            env[m[1]] = re.sub(r"^(['\"])(.*)\1$", r"\2", m[2])
    return env


def load_context(spark: SparkSession, folder: str, names: list[str] | None = None, most: int = 2000) -> DataFrame:
    """SRC8: name, position, content, relevance of the context files that are there, sanitised and cut."""
    names = names or DEFAULTS["contextFiles"]
    there = [n for n in names if os.path.exists(os.path.join(folder, n))]
    if not there:
        return spark.createDataFrame([], "name string, position int, content string, relevance double")
    files = spark.read.text([os.path.join(folder, n) for n in there], wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    rows = files.select(name.alias("name"), T.truncated(T.sanitized(F.col("value")), most).alias("content"))
    order = F.array(*[F.lit(n) for n in names])
    return rows.select("name", (F.array_position(order, F.col("name")) - 1).cast("int").alias("position"), "content", T.relevance(F.col("name")).alias("relevance"))
