"""Item states folded from event streams by plain aggregates; machine.py has those with guards, retries and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import new_path, save

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
def fold(events: DataFrame) -> DataFrame:
    """user_id, last_type (of the greatest event_id), errors, events."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))


def fold_events(spark: SparkSession, sf_dir: str, checkpoint: str | None = None) -> DataFrame:
    """Reads the events table as a stream until it is exhausted; the state after the last batch is the result.

    State lives in the stream's state store. With a checkpoint folder of its own a query that was stopped goes on where it
    was; without one a new folder beside the shared tables serves this run. Each batch writes its result as a table.
    """
    done: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        done[:] = [save(batch, f"states-{number}")]

    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    running = fold(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return done[0] if done else fold(spark.createDataFrame([], EVENTS))
