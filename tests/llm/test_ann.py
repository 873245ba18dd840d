import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestrata.llm import ann


def brute(pdf, every, k=10):
    ids, v = pdf.vec_id.to_numpy(), np.array(list(pdf.embedding), dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def recall(spark, path):
    want = brute(pd.read_parquet(path), 100)
    rows = ann.nearest_rows(spark.read.parquet(path), "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas()
    hit = total = 0
    for q, near in want.items():
        got = rows[rows.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, len(near) + 1))
        assert got.score.is_monotonic_increasing
        hit += len(set(got.vec_id) & {i for i, _ in near})
        total += len(near)
        exact = dict(near)
        assert all(math.isclose(s, exact[i], abs_tol=1e-12) for i, s in zip(got.vec_id, got.score) if i in exact)
    return hit / total


def test_recall(spark):
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet") >= 0.9


def test_copies_nulls_and_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, rng.normal(size=3).tolist()) for i in range(50)]
    bad = [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 1.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.nearest_rows(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, share=1.0).toPandas()
    want = brute(pd.DataFrame(rows, columns=["vec_id", "embedding"]), 100)
    assert set(got.query_id) == set(want)
    for q, near in want.items():
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i, _ in near]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest_rows(few, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, math.sqrt(2))]
    assert ann.nearest_rows(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect() == []


def test_lengths_are_searched_among_themselves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6 if i % 7 == 0 else 3 if i % 10 == 9 else 5 if i == 300 else 4).tolist()) for i in range(800)] + [(200, [9.0] * 6), (100, [-9.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {}
    for i, v in rows:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = {}
    for q, v in asked.items():
        far = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
        if far:
            want[q] = [i for _, i in far[:10]]
    assert {len(v) for v in asked.values()} == {3, 4, 5, 6} and 300 not in want
    # all but the most common length in blocks; lists for every length; cells of a few rows and queries
    for least, cell, ask in ((200, 32 << 20, 8 << 20), (2, 32 << 20, 8 << 20), (2, 6000, 64), (200, 600, 48)):
        for name, value in (("FIT_LEAST", least), ("CELL_BYTES", cell), ("ASK_BYTES", ask)):
            monkeypatch.setattr(ann, name, value)
        got = ann.nearest_rows(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, share=1.0).toPandas().sort_values(["query_id", "rank"])
        found = got.groupby("query_id").vec_id.agg(list).to_dict()
        assert set(found) == set(want)
        assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.97 * sum(map(len, want.values()))
        if least == 200:
            assert all(found[q] == want[q] for q in want if len(asked[q]) != 4)


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(5000, 64)) @ ann.rotation(64)
    missed = 0
    for _ in range(20):
        q = rng.normal(size=64)
        kept = ann.scan(q, rows, 10)
        missed += len(set(np.argsort(((rows - q) ** 2).sum(1))[:10]) - set(kept))
        assert len(kept) < 4000
    assert missed <= 4


def test_large_components_clashing_columns_and_clusters(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) + 20 * (i % 7)).tolist()) for i in range(700)] + [(700, [1e16, 1.0, 0.0, 0.0]), (800, [1e200, 0.0, 0.0, 0.0]), (801, [1e200, 1e199, 0.0, 0.0]), (900, [-1e300, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, list int, id int, grp string, bound double")
    got = ann.nearest_rows(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas()
    want = brute(pd.DataFrame(rows, columns=["vec_id", "embedding"]), 100)
    assert set(got.query_id) == set(want)
    same = sum(len(set(got[got.query_id == q].vec_id) & {i for i, _ in near}) for q, near in want.items())
    assert same >= 0.9 * sum(len(near) for near in want.values())
    for q in (800, 900):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i, _ in want[q]]
    # of 1e16 all the small ones are about equally far
    assert np.allclose(got[got.query_id == 700].sort_values("rank").score, [d for _, d in want[700]], rtol=1e-12)


def test_clusters_need_few_lists():
    rng = np.random.default_rng(2)
    sample = (rng.normal(size=(40, 16)) * 30)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    centres = ann.fit_centres(sample, 60)
    assert ann.probes_needed(sample, centres, 10, 0.96) <= 15
    flat = rng.normal(size=(4000, 64))
    assert ann.probes_needed(flat, ann.fit_centres(flat, 60), 10, 0.96) > 15
