"""Tags of texts against the tags' patterns as they are written, on odd texts, and how boundaries are looked for."""

import random
import re

from pyspark.sql import functions as F

from promptquarry.functions import text as T
from promptquarry.functions import vocabulary as V
from promptquarry.functions.regex import _SPACES, _spaced, any_of

FOUND = {"files": V.FILES, "tests": V.TESTS, "criteria": V.CRITERIA, "constraints": V.CONSTRAINTS, "local_env": V.LOCAL_ENV, "shape": (V.SHAPE,), "ui": (V.UI,)}
BITS = (
    "src lib app/ tests test Tests spec should must\u00a0x needs? need to a goal handle 5 handle\u2003 pass don't do not never avoid max without breaking "
    "without\u3000breaking type enum model colour color click file Files path.py x.json *.ts *.é /Users/ab /Users/é /home/x C:\\Users\\z localhost:3000 "
    "localhost:12 my mac my laptops /a/b/c.js /a/b/é.ts /A/bb/ é.json .md _ 9 te\u017ft 中文 \U0001f600 \u0301 \ufeff \u2028 \n \t \x0b - / \\ ' . , s"
).split(" ")


def _python(pattern):
    """The pattern for Python, with ASCII words and wide white space."""
    return re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", _spaced(pattern)), re.ASCII)


def test_tags_of_odd_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) + r.choice(["", "", " ", ".", "/", "é", "\u00a0"]) for _ in range(r.randint(0, 7))) for _ in range(4000)]
    patterns = {f"has_{k}": _python(any_of(*v)) for k, v in FOUND.items()}
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", *[v.alias(k) for k, v in T.prompt_tags(F.col("text")).items()]).collect()
    assert [x for x in rows if any(x[k] != bool(p.search(x["text"])) for k, p in patterns.items())] == []
    assert all(100 < sum(x[k] for x in rows) < len(rows) - 100 for k in patterns) and "\\x{3000}" in _SPACES


def test_boundaries_are_looked_for_on_one_side(spark):
    """A boundary that is either side's is tried at each place of a text that isn't ASCII, once per word of a list."""
    df = spark.createDataFrame([("é",)], "text string").select(*T.prompt_tags(F.col("text")).values())
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan and "(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])" not in plan
