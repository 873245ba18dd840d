import oracle
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, hash long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    assert oracle.same(mixing.op1_mix_sources(spark, d), d, mixing.OP1_SQL) == 200


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("va", 10), ("vb", 1), ("vc", 100), ("w", 1)], "_mix_key string, size long")
    got = {r._mix_key: r.target for r in mixing.source_targets(sizes).collect()}
    # shares of 112 by 1, 2, 3, 1: vb and w stop at 3, the rest by 1 and 3: 26.5 and 79.5
    assert got == {"va": pytest.approx(26.5), "vb": 3.0, "vc": pytest.approx(79.5), "w": 3.0}


def test_edges(spark):
    data = [(1, None, "b", "x", 0), (2, "", None, "x", 0), (3, " a b\tc ", None, None, 1), (3, " a b\tc ", None, None, 1), (None, "d", "b", None, None), (4, "w " * 30000, "b", None, None)]
    got = mixing.mix_report(rows(spark, data)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].size == 0 and by[2].size == 0 and by[3].size == 3 and by[4].size == 30000
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert by[3].target == 18.0 and by[3].source_size == 6 and by[3].taken == 9
    assert mixing.mix_report(rows(spark, [])).collect() == []
    assert mixing.mix(rows(spark, [])).collect() == []


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = rows(spark, [(i, "w " * (1 + i % 7), "ab"[i % 2], str(i), i) for i in range(200)])
    report = mixing.mix_report(df)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = {r.doc_id: r.taken // r.size for r in report.collect() if r.taken}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want
    for r in report.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 2
