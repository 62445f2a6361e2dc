"""Tool calls and their owning turns; fields of JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owning_turn(events: DataFrame, key: str, order: list[str], is_turn, turn) -> DataFrame:
    """JN24: the latest turn at or before each other event of the same key; events before any turn are dropped.
    One window instead of an as-of join."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = events.withColumn("owner", F.last(F.when(is_turn, turn), ignorenulls=True).over(upto))
    return owned.filter(~is_turn & F.col("owner").isNotNull())


def numbered_turns(events: DataFrame, key: str, order: list[str], is_turn) -> DataFrame:
    """WIN5: turn_index over the events that are turns, from 0."""
    return events.filter(is_turn).withColumn("turn_index", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def json_field(events: DataFrame, column: str, path: str, kind: str, name: str) -> DataFrame:
    """A field of a JSON column; null where the text is no JSON or has no such field."""
    return events.withColumn(name, F.try_variant_get(F.try_parse_json(column), path, kind))
