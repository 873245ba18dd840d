"""Queries: the batch forms of the streaming guardrails and of windowed activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans.registry import register
from lodestrata.plans.views import load, spark_view
from lodestrata.streaming.jobs import activity, guardrails


@register("stream_guardrails")
def stream_guardrails(spark, sf_dir):
    """The look-behind of the phone rule keeps this out of SQL; tests compare it with Python and with the stream."""
    return guardrails(spark_view(spark, sf_dir, "query_log"))


@register("stream_activity", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_activity(spark, sf_dir):
    """Events by kind and hour; tests compare the stream with it."""
    got = activity(load(spark, sf_dir, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
