import time

import numpy as np
import pandas as pd
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import shingles, toxicity


def brute_segments(scores):
    """Recursively: the best segment (the shortest, then the first among equals), then left and right of it."""
    best = None
    for a in range(len(scores)):
        for z in range(a + 1, len(scores) + 1):
            s = sum(scores[a:z])
            if s > 0 and (best is None or (s, a - z) > (best[2], best[0] - best[1])):
                best = (a, z, s)
    if best is None:
        return []
    a, z, s = best
    return brute_segments(scores[:a]) + [best] + [(z + x, z + y, t) for x, y, t in brute_segments(scores[z:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(scores)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in brute_segments(scores))
    assert all(sum(scores[a:z]) == s for a, z, s in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_long_sequences_take_linear_time():
    rng = np.random.default_rng(4)
    for kinds in ([1, -2], [3, -1, -1, -1], [5, -2, -2, 1]):
        small = rng.choice(kinds, 300).tolist()
        got, want = toxicity.maximal_segments(small), brute_segments_by_sums(small)
        assert sorted(s for _, _, s in got) == sorted(s for _, _, s in want)
    took = {}
    for n in (100_000, 400_000):
        began = time.process_time()
        assert len(toxicity.maximal_segments([1, -2] * (n // 2))) == n // 2
        took[n] = time.process_time() - began
    assert took[400_000] < 12 * took[100_000] + 0.5


def brute_segments_by_sums(scores):
    """As ``brute_segments``, by running sums."""
    best, low, at = (0, 0, 0), 0, 0
    total = 0
    for i, s in enumerate(scores):
        total += s
        if total - low > best[2]:
            best = (at, i + 1, total - low)
        if total <= low:
            low, at = total, i + 1
    if best[2] <= 0:
        return []
    a, z, _ = best
    return brute_segments_by_sums(scores[:a]) + [best] + brute_segments_by_sums(scores[z:])


def test_lambda_is_the_root():
    scores, share = np.array([3.0, 1.0, -0.2]), np.array([0.01, 0.03, 0.96])
    rate = toxicity._lambda(scores, share)
    assert abs((share * np.exp(rate * scores)).sum() - 1) < 1e-9 and rate > 0
    assert toxicity._lambda(np.array([-0.2]), np.array([1.0])) == 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t,", max_size=30), min_size=1, max_size=6))
def test_word_hashes(texts):
    h, at = shingles.word_hashes(pa.array(texts))
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[w for w in t.translate(table).replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts]
    flat = [w for ws in want for w in ws]
    assert np.diff(at).tolist() == [len(ws) for ws in want]
    by = {}
    for w, x in zip(flat, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    sets = list(shingles.shingle_hashes(pa.array(texts)))
    for ws, got in zip(want, sets):
        expect = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
        assert len(got) == len(expect)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op2_toxicity(spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.75
    assert hit.sum() / (got.predicted == 1).sum() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_edges(spark):
    docs = [(i, ("you scum and trash " if i % 4 == 0 else "good calm words ") + f"t{i} u{i} v{i} w{i} x{i}", "s", 1.0) for i in range(120)]
    docs += [(900, None, "s", 0.0), (901, "", "s", 0.0), (None, "trash scum", "s", 0.0), (902, "calm " * 20000 + "you scum and trash " * 8 + "calm " * 20000, "s", 0.0), (4, docs[4][1], "s", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(900, 1, None), (None, 0, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training(df, labels))
    got = toxicity.scored(df, model, ["doc_id", "source"]).toPandas()
    assert len(got) == len(docs)
    by = got.set_index("doc_id").score
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in by.items() if i < 120 and i == i)
    assert by[900] == by[901] < 0.3 and got[got.doc_id.isna()].score.iloc[0] >= 0.7 and by[902] >= 0.7
    where = toxicity.passages_of(df.filter("doc_id = 902"), model).collect()
    assert where and all(20000 <= r.first_word <= r.last_word < 20032 for r in where)
    none = toxicity.fit(toxicity.training(df, labels.limit(0)))
    assert toxicity.scored(df, none, ["doc_id"]).filter("score > 0.5").count() == 0
    assert toxicity.scored(df.limit(0), model, ["doc_id"]).collect() == []


def _word(i):
    return "".join(chr(97 + int(d)) for d in f"{i:03d}")


def test_rows_that_share_a_passage_all_count(spark):
    shared = " ".join(f"p{_word(i)}" for i in range(150))
    rows = [(f"{shared} {'vermin' if i < 30 else 'filth'} z{_word(i)}", 1) for i in range(60)] + [(f"{shared} calm y{_word(i)}", 0) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    for word in ("vermin", "filth"):
        assert abs(model.odds[word] - np.log((30.5 / 61) / (0.5 / 61))) < 1e-9


def test_a_rare_feature_with_a_high_z_score_is_kept(spark):
    text = F.when(F.col("id") < 8, "vermin").when(F.col("id") < 900, F.lit("filth")).otherwise(F.lit("calm"))
    rows = spark.range(20900).select(text.alias("text"), (F.col("id") < 900).cast("int").alias("toxic"))
    assert "vermin" in toxicity.fit(rows).odds


def test_lexicon_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES_A_FILE", 7)
    kept = spark.createDataFrame([(f"é{i}*", i + 0.5) for i in range(60)], "feature string, odds double")
    got = toxicity._lexicon(kept)
    assert len(got.paths) > 4 and got.many([f"é{i}*" for i in range(60)] + ["none", ""]).tolist() == [i + 0.5 for i in range(60)] + [0.0, 0.0]
    assert toxicity._lexicon(kept.limit(0)).many(["a"]).tolist() == [0.0]


def test_labels_other_than_0_and_1_say_nothing(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string")
    marks = [(i, [0, 1, 2, -1, None][i % 5]) for i in range(40)]
    got = toxicity.training(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    seen = {r.doc_id: r.toxic for r in got}
    assert set(seen.values()) == {0, 1} and all(dict(marks)[i] == t for i, t in seen.items())
    toxicity.fit(toxicity.training(docs, spark.createDataFrame(marks, "doc_id long, toxic int")))
