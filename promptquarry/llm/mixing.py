"""Mixing sources to target weights.

Every document gets a hash-random key, which orders the documents of its source. The key's leading bits deal the
documents into ranges that stay small whatever the source's share; sums per range and their running totals give
each range its place on the source's axis of tokens (a distributed prefix sum), and only inside the range where the
source's budget ends is the running sum taken document by document. The budget so cuts the axis exactly: whole
epochs first, then the documents before the rest, the last of them in part. What joins the documents is one row
per source, so texts are never shuffled.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and comes last in
the order of weights; documents of equal key are ordered by doc_id (nulls first), size and a hash of the text, so reruns agree; a row
that repeats a doc_id is a row of its own; sources without words have the target 0; an empty table gives an empty
result. Working columns start with two underscores; all other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_count

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2.0
ROWS_PER_RANGE = 4096
#: One row per source is broadcast up to so many sources, counted first; beyond, the join is an ordinary one.
BROADCAST_SOURCES = 20_000
KEY_BITS = 60


def random_key(id_col: str, seed: str):
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """__source, __source_size, __target. What exceeds a source's cap is reshared by weight among the sources below
    theirs; a round reads three sums, so any number of sources will do."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size")).withColumn("__rank", F.row_number().over(order) - 1)
    per = stored(per.select("__source", "__source_size", weight.alias("__w")), "mix-sources")
    total = per.agg(F.sum("__source_size")).first()[0] or 0
    cap = F.col("__source_size") * F.lit(float(most))
    level, capped = 0.0, None
    while True:
        full = F.lit(False) if capped is None else F.col("__w") * F.lit(level) >= cap
        row = per.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("__w"))).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if not row["open"] or row["n"] == capped:
            break
        level, capped = (total * share - row["fixed"]) / row["open"], row["n"]
    return per.select("__source", "__source_size", F.least(cap, F.col("__w") * F.lit(level)).alias("__target"))


def source_cuts(light: DataFrame, targets: DataFrame) -> DataFrame:
    """targets and, per source: __epochs (whole ones), and the document that the rest of the budget ends in
    (__cut_key, __cut_id, __cut_size) with the words taken of it (__cut_words); null where nothing is left over. Of
    __ties rows that share this place, __whole are taken whole before it."""
    n = light.count()
    bits = min(24, max(0, math.ceil(math.log2(max(1, n) / ROWS_PER_RANGE)))) if n else 0
    light = light.withColumn("__range", F.shiftright("__key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    size, target = F.col("__source_size"), F.floor("__target")
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("__epochs", epochs).withColumn("__rest", (target - F.col("__epochs") * size).cast("long"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = light.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    ends = ranges.join(budgets.select(F.col("__source").alias("__s"), "__rest"), F.col("__source").eqNullSafe(F.col("__s")))
    ends = ends.filter("__rest > 0 and __before < __rest and __before + __sum >= __rest").select(
        F.col("__s"), F.col("__range").alias("__r"), "__before", "__rest"
    )
    inside = light.join(ends, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    upto = Window.partitionBy("__source", "__range").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__size").over(upto), F.lit(0)))
    same = Window.partitionBy("__source", "__range", "__key", "__id", "__size")
    inside = inside.withColumns({"__ties": F.count("*").over(same), "__first": F.min("__start").over(same)})
    cut = inside.filter("__start < __rest and __start + __size >= __rest").select(
        F.col("__s"),
        F.col("__key").alias("__cut_key"),
        F.col("__id").alias("__cut_id"),
        F.col("__size").alias("__cut_size"),
        (F.col("__rest") - F.col("__start")).alias("__cut_words"),
        F.col("__ties"),
        F.floor((F.col("__start") - F.col("__first")) / F.col("__size")).cast("long").alias("__whole"),
    )
    return budgets.join(cut, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s", "__rest")


def _at_cut(compare: str):
    place, cut = (F.struct(*[F.col(c) for c in names]) for names in (("__key", "__id", "__size"), ("__cut_key", "__cut_id", "__cut_size")))
    return place < cut if compare == "<" else place == cut


def taken():
    """Words taken of a row that has its source's cut and __nth, its number among the rows of the cut's place: __epochs
    copies and, before the cut, one more."""
    at_cut = F.when(F.col("__nth") <= F.col("__whole"), F.col("__size")).when(F.col("__nth") == F.col("__whole") + 1, F.col("__cut_words")).otherwise(0)
    rest = F.when(F.col("__cut_words").isNull(), 0).when(_at_cut("<"), F.col("__size")).when(_at_cut("="), at_cut).otherwise(0)
    return (F.col("__epochs") * F.col("__size") + rest).cast("long")


def numbered(joined: DataFrame, cuts: DataFrame, text_col: str) -> DataFrame:
    """joined with __nth: 1, but for rows that share a cut's place their number there. Only such rows are shuffled."""
    if cuts.filter("__ties > 1").isEmpty():
        return joined.withColumn("__nth", F.lit(1))
    tied = F.coalesce((F.col("__ties") > 1) & _at_cut("="), F.lit(False))
    order = Window.partitionBy("__source", "__key", "__id", "__size").orderBy(F.xxhash64(F.col(text_col)))
    return joined.filter(~tied).withColumn("__nth", F.lit(1)).unionByName(joined.filter(tied).withColumn("__nth", F.row_number().over(order)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix-1", **targets) -> DataFrame:
    """The input's columns and __size, __source_size, __target, __epochs, __taken."""
    own = {
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
        "__source": F.col(source_col).cast("string"),
        "__size": words_count(text_col),
        "__key": random_key(id_col, seed),
    }
    light = stored(docs.select(*[c.alias(k) for k, c in own.items()]), "mix-sizes")
    cuts = stored(source_cuts(light, source_targets(light, **targets)), "mix-cuts")
    wanted = docs.withColumns(own) if set(docs.columns) - {id_col} else docs
    right = cuts.withColumnRenamed("__source", "__s")
    right = F.broadcast(right) if cuts.count() <= BROADCAST_SOURCES else right
    joined = wanted.join(right, F.col("__source").eqNullSafe(F.col("__s")))
    return numbered(joined, cuts, text_col).withColumn("__taken", taken()).drop("__nth", "__ties", "__whole", "__s", "__source", "__key", "__id", "__cut_key", "__cut_id", "__cut_size", "__cut_words")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row per epoch in which a document is taken, with epoch (from 1) and taken (its words; less
    than all only for the document where a source's budget ends, which then gives its first words)."""
    rows = mix(docs, **how).filter("__taken > 0")
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("__size"), F.col("__taken") - (F.col("epoch") - 1) * F.col("__size"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("epoch", "taken")], "epoch", words.alias("taken"))
