import tempfile

from pyspark.sql import functions as F

from lodestrata.plans.views import load, spark_view
from lodestrata.streaming import jobs

D = "/root/testdata/sf0.001"


def parts(df, n):
    folder = tempfile.mkdtemp(prefix="spark-")
    df.repartition(n).write.mode("overwrite").parquet(folder)
    return folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def test_stream_equals_batch(spark):
    log = spark_view(spark, D, "query_log")
    folder, schema = parts(log, 3)
    got = jobs.run_available(jobs.guardrails(jobs.read_stream(spark, folder, schema)), "append", "guarded", tempfile.mkdtemp(prefix="spark-"))
    want = jobs.guardrails(log)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    events = load(spark, D, "events")
    folder, schema = parts(events, 3)
    for build in (jobs.session_usage, jobs.job_status):
        got = jobs.run_available(build(jobs.read_stream(spark, folder, schema)), "complete", build.__name__, tempfile.mkdtemp(prefix="spark-"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(events).collect()))


def test_windows_close_behind_the_watermark(spark):
    folder, schema = parts(load(spark, D, "events"), 2)
    got = jobs.run_available(jobs.activity(jobs.read_stream(spark, folder, schema), late="1000 days"), "append", "active", tempfile.mkdtemp(prefix="spark-"))
    assert got.filter(F.col("n") < 1).isEmpty()


def test_windowed_stream_equals_batch(spark):
    events = load(spark, D, "events")
    folder, schema = parts(events, 3)
    got = jobs.run_available(jobs.activity(jobs.read_stream(spark, folder, schema), late="1000 days"), "complete", "active_all", tempfile.mkdtemp(prefix="spark-"))
    rows = lambda df: sorted((r.start, r.event_type, r.n, round(r["mean"], 6)) for r in df.collect())
    assert rows(got) == rows(jobs.activity(events)) and sum(r.n for r in got.collect()) == events.filter("ts IS NOT NULL").count()
