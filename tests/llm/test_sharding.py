import zlib

import pandas as pd

from lodestrata.llm import sharding

D = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, lang string, size int, shard string, _x int"


def test_all_documents_in_equal_shards(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet")
    got = sharding.op6_kd_shards(spark, D).toPandas()
    assert len(got) == len(docs) and got.doc_id.is_unique
    m = got.merge(docs, on="doc_id")
    assert (m["size"] == m.text.map(lambda t: len(t.encode()) + 8)).all()
    assert (m.text_crc32 == m.text.map(lambda t: zlib.crc32(t.encode()))).all()
    per = got.groupby("shard")["size"].sum()
    assert per.index.tolist() == list(range(24))
    assert per.max() - per.min() <= 2 * got["size"].max() and per.max() < 1.1 * per.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}


def test_edges(spark):
    data = [(None, None, None, None, 1, "x", 1), (1, "", "a", "en", 1, "x", 1), (1, "", "a", "en", 1, "x", 1), (2, "é" * 5000, "a", None, 1, "x", 1)]
    got = sharding.with_slots(sharding.kd_shards(spark.createDataFrame(data, SCHEMA), shards=4)).toPandas()
    assert len(got) == 4 and got.shard.between(0, 3).all() and sorted(got["size"]) == [8, 8, 8, 10008]
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.with_slots(sharding.kd_shards(empty, shards=4)).collect() == []


def test_copies_of_one_text_are_spread(spark):
    data = [(i, "same text", "a", "en", 1, "x", 1) for i in range(960)]
    got = sharding.kd_shards(spark.createDataFrame(data, SCHEMA), target_bytes=960 * 17 // 24).toPandas()
    assert got.groupby("shard").size().tolist() == [40] * 24


def test_one_doc_id_repeated_often_is_parted(spark):
    data = [(5 if i < 300 else 1000 + i, "same text" if i < 300 else f"text {i:04d}", f"common_crawl/{i % 3}", "en", 1, "x", 1) for i in range(600)]
    got = sharding.with_slots(sharding.kd_shards(spark.createDataFrame(data, SCHEMA), shards=6)).toPandas()
    per = got.groupby("shard").size()
    assert per.index.tolist() == list(range(6)) and per.max() - per.min() <= 2
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sources_with_a_common_beginning_are_told_apart(spark):
    rows = spark.createDataFrame([("common_crawl/b",), ("common_crawl/a",), (None,), ("common_crawl/b",)], "source string")
    assert sorted((r.source or "", r.v) for r in sharding._ranked(rows, "source", "v").collect()) == [("", 0.0), ("common_crawl/a", 1.0), ("common_crawl/b", 2.0), ("common_crawl/b", 2.0)]
