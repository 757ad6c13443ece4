"""Running benchmark means over a stream of registration results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.evaluate import summarize


def running_summary(results: DataFrame) -> DataFrame:
    """Overall and per-sequence means so far; the state is one row per sequence."""
    return summarize(results)


def start(results: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the summary in the in-memory table ``name``, rewritten at each trigger."""
    return (
        running_summary(results).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
