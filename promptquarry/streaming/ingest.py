"""The ingest as a stream: new transcript files are read as they appear, replays within the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.transcripts import string_at


def stream_lines(spark: SparkSession, root: str, delay: str = "1 hour") -> DataFrame:
    """uuid, at, kind, v per line; a uuid that comes again within the delay is dropped."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    rows = lines.select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    at = F.try_to_timestamp(string_at("v", "$.timestamp"))
    rows = rows.select(string_at("v", "$.uuid").alias("uuid"), at.alias("at"), string_at("v", "$.type").alias("kind"), F.to_json("v").alias("raw"))
    return rows.filter("uuid IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay).dropDuplicatesWithinWatermark(["uuid"])


def events_per_window(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Extra: events by kind in tumbling windows."""
    return events.groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n"))


def run_available(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles everything that is there and ends; write must be repeatable for a batch id."""
    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
