"""Clarifying pairs: what one of the next three user prompts adds to a prompt that lacked it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

LOOKAHEAD = 3
LEAST_LENGTH = 40
RULES = (
    ("file-scope", "files"),
    ("success-criteria", "criteria"),
    ("constraint", "constraints"),
    ("success-criteria", "tests"),
    ("data-shape", "shape"),
    ("ui-detail", "ui"),
)


def eligible_user_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.filter((F.col("role") == "user") & F.col("eligible"))


def lookahead(prompts: DataFrame, steps: int = LOOKAHEAD) -> DataFrame:
    """JN18, WIN4: each prompt beside the next ones of its session. One window, one sort; no join."""
    order = Window.partitionBy("session_id").orderBy("turn_index", "prompt_id")
    fields = [c for c in prompts.columns if c != "session_id"]
    own = F.struct(*fields)
    ahead = prompts.select("session_id", own.alias("orig"), *[F.lead(own, k).over(order).alias(f"next{k}") for k in range(1, steps + 1)])
    each = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"next{k}").alias("clar")) for k in range(1, steps + 1)])
    return ahead.select("session_id", "orig", F.explode(each).alias("n")).filter("n.clar IS NOT NULL").select("session_id", "orig", F.col("n.step").alias("step"), F.col("n.clar").alias("clar"))


def clarifying_pairs(prompts: DataFrame) -> DataFrame:
    """LAB2: session_id, originating_prompt_id, clarifying_prompt_id, clarification_kind, clarification_text, confidence, rule."""
    content = F.col("content")
    tags = T.prompt_tags(content)
    own = eligible_user_prompts(prompts).select(
        "session_id", "prompt_id", "turn_index", "content", T.synthetic_for_labels(content).alias("synthetic"),
        *[tags[f"has_{k}"].alias(k) for k in ("files", "criteria", "constraints", "tests")],
        T.matches(content, V.PAIR_SHAPE).alias("shape"), T.matches(content, V.PAIR_UI).alias("ui"),
    )
    near = lookahead(own).filter(~F.col("orig.synthetic") & ~F.col("clar.synthetic") & (F.length("orig.content") >= LEAST_LENGTH))
    text = F.col("clar.content")
    new_files = F.array_except(T.files_in(text), T.files_in(F.col("orig.content")))
    phrases = {
        "files": F.when(F.size(new_files) > 0, F.concat(F.lit("added file(s): "), F.array_join(F.slice(new_files, 1, 6), ", "))),
        "criteria": T.first_phrase(text, V.CRITERIA_PHRASE),
        "constraints": T.first_phrase(text, V.CONSTRAINT_PHRASE),
        "tests": T.first_phrase(text, V.TESTS_PHRASE),
        "shape": T.first_phrase(text, V.SHAPE_PHRASE),
        "ui": T.first_phrase(text, V.UI_PHRASE),
    }
    found = [
        F.struct(
            F.lit(kind).alias("kind"), F.when(F.col(f"clar.{rule}") & ~F.col(f"orig.{rule}"), phrases[rule]).alias("text"),
            F.lit(V.CONFIDENCE[rule]).alias("confidence"), F.lit(rule).alias("rule"),
        )
        for kind, rule in RULES
    ]
    rows = near.select("session_id", F.col("orig.prompt_id").alias("originating_prompt_id"), F.col("clar.prompt_id").alias("clarifying_prompt_id"), F.explode(F.array(*found)).alias("f"))
    return rows.filter("f.text IS NOT NULL").select(
        "session_id", "originating_prompt_id", "clarifying_prompt_id",
        F.col("f.kind").alias("clarification_kind"), F.col("f.text").alias("clarification_text"), F.col("f.confidence").alias("confidence"), F.col("f.rule").alias("rule"),
    )
