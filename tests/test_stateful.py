import tempfile
import time

import pytest

from lodestrata.plans import registry
from lodestrata.plans.views import load
from lodestrata.streaming import jobs, stateful

D = "/root/testdata/sf0.001"
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"
new = lambda: tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(autouse=True)
def disk_state(spark):
    stateful.use_disk_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def stream(spark, folder, name, checkpoint, schema=SCHEMA, **options):
    """What has arrived in the folder since the checkpoint's last run, file by file in the order of arrival."""
    return jobs.run_available(stateful.sessions(jobs.read_stream(spark, folder, schema), **options), "append", name, checkpoint).collect()


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def rows(df):
    return sorted(map(tuple, df.collect() if hasattr(df, "collect") else df), key=repr)


def test_stream_in_order_gives_the_batch_queries(spark):
    events = load(spark, D, "events").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts", "event_type").filter("user_id % 4 = 0")
    cut = events.selectExpr("percentile_approx(unix_micros(ts), 0.5)").first()[0]
    folder = new()
    put(events.filter(f"unix_micros(ts) <= {cut}"), folder)
    put(events.filter(f"unix_micros(ts) > {cut}"), folder)
    got = spark.createDataFrame(stream(spark, folder, "in_order", new()), stateful.SCHEMA)
    batch = {q: registry.queries()[q](spark, D).filter("user_id % 4 = 0") for q in ("session_quota", "event_tail", "job_status")}
    assert got.count() == events.count() > 50
    assert rows(stateful.quota(got)) == rows(batch["session_quota"].select("user_id", "event_id", "used", "allowed"))
    assert rows(stateful.tail(got, 3)) == rows(batch["event_tail"].select("user_id", "event_id", "n"))
    assert rows(stateful.status(got)) == rows(batch["job_status"].select("user_id", "status", "errors"))


def test_late_and_repeated_events(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    make = lambda data: spark.createDataFrame(data, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts", "event_type")
    folder = new()
    first = [(1, 7, t(10), "ask"), (2, 7, t(20), "error"), (2, 7, t(20), "error"), (9, 8, None, "ask"), (None, 7, t(1), "ask"), (5, None, t(1), "ask")]
    second = [(1, 7, t(10), "ask"), (3, 7, t(5), "ask"), (4, 8, t(1), "done")]
    put(make(first), folder)
    put(make(second), folder)
    got = stream(spark, folder, "late", new(), limit=1)
    said = [(r.user_id, r.event_id, r.n, r.used, r.allowed, r.status, r.errors) for r in got]
    assert sorted(said) == [(7, 1, 1, 1, True, "ask", 0), (7, 2, 2, 1, False, "error", 1), (7, 3, 3, 2, False, "error", 1), (8, 4, 2, 2, False, "done", 0), (8, 9, 1, 1, True, "ask", 0)]
    # at the end the stream has what the batch forms give for the distinct events
    distinct = make(first + second).dropDuplicates(["event_id"]).filter("user_id is not null and event_id is not null")
    end = spark.createDataFrame(got, stateful.SCHEMA)
    assert rows(stateful.status(end)) == rows(jobs.job_status(distinct).select("user_id", "status", "errors"))
    assert {r.user_id: r.used for r in end.groupBy("user_id").agg({"used": "max"}).toDF("user_id", "used").collect()} == {r.user_id: r.used for r in jobs.session_usage(distinct).collect()}


def test_state_survives_a_restart_and_ends_with_its_time_to_live(spark):
    one = lambda i: spark.createDataFrame([(i, 7, "ask")], "event_id long, user_id long, event_type string").selectExpr("event_id", "user_id", "timestamp'2024-01-01' ts", "event_type")
    for ttl, want in ((3_600_000, [1, 2]), (500, [1, 1])):
        folder, checkpoint, out = new(), new(), new()
        for i in (1, 2):
            put(one(i), folder)
            got = stateful.sessions(jobs.read_stream(spark, folder, SCHEMA), ttl_ms=ttl)
            got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(60)
        assert [r.used for r in spark.read.parquet(out).orderBy("event_id").collect()] == want
