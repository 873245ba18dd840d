import collections
import os

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import pieces
from test_jaccard_join import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.01"
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(tmp_path_factory.mktemp("steps"), name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs.toPandas(), spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def test_stages(spark, steps):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").toxic
    whole = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    for before, after in steps[:-1]:
        assert after.columns == list(whole.columns)
    kept = set(steps[0][1].toPandas().doc_id)
    gone = set(whole.doc_id) - kept
    assert gone and sum(labels.get(i, 1) == 0 for i in gone) <= 2
    assert len(kept & set(labels[labels == 0].index)) >= 0.99 * (labels == 0).sum()
    before, after = steps[1]
    classes = brute(list(zip(before.doc_id.tolist(), before.text)))
    assert sorted(after.toPandas().doc_id) == sorted({c for c, _, _ in classes.values()})
    before, after = steps[2]
    n = collections.Counter(after.toPandas().doc_id)
    assert set(n) <= set(before.doc_id) and max(n.values()) <= 3
    model = pieces.piece_model(pieces.model_path())
    before, after = steps[3]
    text = before.drop_duplicates("doc_id").set_index("doc_id").text
    rows = after.toPandas()
    assert sorted(rows.doc_id) == sorted(before.doc_id) and rows.exact.all()
    for r in rows.head(30).itertuples():
        assert model.decode(list(r.ids)) == text[r.doc_id] and r.score == model.n_best(text[r.doc_id], 1)[0][0]


def test_run_and_edges(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "text" not in got.columns
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "a b", "en", "a", 0), (3, "word " * 30000, "en", "a", 1), (3, "word " * 30000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    for some in (docs, docs.limit(0)):
        now = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == docs.columns
        assert now.agg(F.count("*")).first()[0] >= 0
        last = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
        assert last.count() == now.count() and last.filter("NOT exact").isEmpty()


def test_last_stage_takes_long_runs_without_spaces(spark):
    texts = ["\U0001f600" * 10_000, "一" * 10_000, "\x01" * 10_000, "qzx" * 350_000, "=" * 200_000]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert len(got) == len(texts) and all(r.exact and r.n_pieces == len(r.ids) for r in got.values())
