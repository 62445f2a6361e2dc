"""Scores of proposed questions against gold clarifications."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.store import kept


def score_questions(cases: DataFrame, top: int = 3) -> DataFrame:
    """WIN8, SET1: one row per ranked question. cases: case_id, gold_kind, gold_text, questions array<struct<text, kind,
    confidence>>."""
    rows = cases.select("case_id", "gold_kind", T.score_tokens(F.col("gold_text")).alias("gold"), F.posexplode("questions").alias("at", "q"))
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("q.confidence"), "at")
    rows = rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top)
    overlap = T.jaccard(T.score_tokens(F.col("q.text")), F.col("gold"))
    match = F.coalesce(F.col("q.kind") == F.col("gold_kind"), F.lit(False))
    rows = rows.select("case_id", "pos", F.col("q.kind").alias("kind"), overlap.alias("overlap"), match.alias("kind_match"))
    return rows.withColumn("combined", F.when(F.col("kind_match"), F.greatest("overlap", F.lit(V.KIND_FLOOR))).otherwise(F.col("overlap")))


def score_cases(cases: DataFrame) -> DataFrame:
    """EVL1: case_id, gold_kind, proposed, overlap_at_1, overlap_at_3, kind_match_top1, kind_match_any."""
    first = F.col("pos") == 1
    per = score_questions(cases).groupBy("case_id").agg(
        F.max(F.when(first, F.col("combined"))).alias("o1"), F.max("combined").alias("o3"), F.max(F.when(first, F.col("kind_match"))).alias("k1"), F.max("kind_match").alias("k3")
    )
    return cases.select("case_id", "gold_kind", F.coalesce(F.size("questions"), F.lit(0)).cast("long").alias("proposed")).join(per, "case_id", "left").select(
        "case_id", "gold_kind", F.greatest(F.col("proposed"), F.lit(0)).alias("proposed"), F.coalesce("o1", F.lit(0.0)).alias("overlap_at_1"),
        F.coalesce("o3", F.lit(0.0)).alias("overlap_at_3"), F.coalesce("k1", F.lit(False)).alias("kind_match_top1"), F.coalesce("k3", F.lit(False)).alias("kind_match_any"),
    )


def aggregate(scores: DataFrame) -> DataFrame:
    """EVL2, AGG17: one row; a rejected gold (kind null) stays in the denominators; no cases give zeros."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return scores.agg(
        F.count("*").alias("case_count"), mean("overlap_at_1").alias("mean_overlap_at_1"), mean("overlap_at_3").alias("mean_overlap_at_3"),
        mean("kind_match_top1").alias("kind_match_top1_rate"), mean("kind_match_any").alias("kind_match_any_rate"),
    )


def per_kind(scores: DataFrame) -> DataFrame:
    """AGG17: overlap at 3 by gold kind."""
    return scores.filter("gold_kind IS NOT NULL").groupBy("gold_kind").agg(F.count("*").alias("n"), F.avg("overlap_at_3").alias("mean_overlap_at_3"))


def worst_cases(scores: DataFrame, n: int = 3) -> DataFrame:
    """SRT8: the cases of least overlap that are no rejections."""
    return scores.filter("gold_kind IS NOT NULL").orderBy("overlap_at_3", "case_id").limit(n).select("case_id", "overlap_at_3")


#: Cases of a run in one range of their order.
RANGE = 100_000


def within_budget(cases: DataFrame, cap: float, order: str = "case_id", group: str = "run_id") -> DataFrame:
    """WIN10: cases run until the cost so far exceeds the cap, which overshoots by one. A run's cases are cut at quantiles of
    their order (a number); costs are summed per range, then inside each range, so no task sums a whole run."""
    most = cases.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k = -(-most // RANGE)
    if k > 1:
        cuts = cases.groupBy(group).agg(F.percentile_approx(order, [i / k for i in range(1, k)], F.lit(20 * k)).alias("cuts"))
        per_run = _beside(cases, kept(cuts, "run-cuts"), [group])
        rows = per_run.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(order)))).drop("cuts")
    else:
        rows = cases.withColumn("range", F.lit(0))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "range").agg(F.sum("cost_usd").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0))).drop("sum")
    before = Window.partitionBy(group, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0)))
    spent = _beside(rows, kept(sums, "range-sums"), [group, "range"]).withColumn("spent_before", F.col("start") + F.col("inside"))
    return spent.filter(F.round("spent_before", 9) <= cap).drop("range", "start", "inside")


def _beside(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the one row of per_key that has their keys, null ones too. Few rows are broadcast; a run of very many cases is
    split by Spark where they aren't, as per_key is a table."""
    right = per_key.withColumnsRenamed({c: f"__{c}" for c in keys})
    right = F.broadcast(right) if per_key.count() <= BROADCAST_RANGES else right
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(right, reduce(and_, same)).drop(*[f"__{c}" for c in keys])


#: Ranges that are broadcast at most, after they are counted.
BROADCAST_RANGES = 10_000


def instrumented(cases: DataFrame) -> DataFrame:
    """EVL3, SCL26-28, WIN9: case_id, vague_verb, has_disambiguation, live_or_local, correct_skip."""
    texts = F.transform("questions", lambda q: q["text"])
    return cases.select(
        "case_id", T.has_vague_verb(F.col("prompt")).alias("vague_verb"), F.coalesce(F.exists(texts, T.asks_for_meaning), F.lit(False)).alias("has_disambiguation"),
        T.asks_live_or_local(F.try_element_at(texts, F.lit(2))).alias("live_or_local"),
        F.when(F.col("gold_kind").isNull(), F.coalesce(F.size("questions"), F.lit(0)) == 0).alias("correct_skip"),
    )


def instrument_counts(rows: DataFrame) -> DataFrame:
    """AGG18."""
    return rows.agg(
        F.count("*").alias("cases"), F.count_if("vague_verb").alias("vague_verb"), F.count_if(F.col("vague_verb") & F.col("has_disambiguation")).alias("asked_meaning"),
        F.count_if("live_or_local").alias("live_or_local"), F.count_if("correct_skip").alias("correct_skip"),
    )
