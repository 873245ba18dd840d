"""Streams of queries and events: the stateless guardrails, and quota and status as keyed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.rules import attack_types, redact
from lodestrata.functions.text import sanitize_query


def read_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def guardrails(queries: DataFrame) -> DataFrame:
    """query_id, blocked, attack_types, redacted of each query; stateless, for append mode or a batch."""
    clean = queries.withColumn("clean", sanitize_query(F.col("query_text"))).withColumn("found", attack_types(F.col("clean")))
    return clean.select("query_id", (F.size("found") > 0).alias("blocked"), F.array_join(F.array_sort(F.array_distinct("found")), "|").alias("attack_types"), redact(F.col("clean")).alias("redacted"))


def session_usage(events: DataFrame, limit: int = 25) -> DataFrame:
    """Per session the questions used and whether another is allowed; update mode, one row of state a session."""
    used = F.count_if(F.col("event_type") != "error")
    return events.groupBy("user_id").agg(used.alias("used")).withColumn("allowed", F.col("used") < limit)


def job_status(events: DataFrame) -> DataFrame:
    """Per job its last event and number of errors; update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("errors"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value by kind and window; windows close when the watermark has passed, so state stays bounded.

    A time without zone is taken in the session's; a null one belongs to no window.
    """
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def run_available(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Processes what has arrived, in memory, and gives the result as a table; for tests and small looks."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
