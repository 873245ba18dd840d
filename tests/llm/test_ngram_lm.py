import collections
import math
import os
import resource
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import ngram_lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, least=2, discount=0.75):
    """The same model in dictionaries, without codes; without ``discount`` it is estimated from the counts of all n-grams."""
    train = [words(t) + ["</s>"] for i, t in rows if not out(i)]
    c1 = collections.Counter(w for ws in train for w in ws)
    c2 = collections.Counter(x for ws in train for x in zip(["</s>", *ws[:-1]], ws))
    c3 = collections.Counter(x for ws in train for x in zip(["</s>", *ws[:-2]], ws[:-1], ws[1:]))
    n, v = sum(c1.values()), len(c1)
    k2, k3 = {k: c for k, c in c2.items() if c >= least}, {k: c for k, c in c3.items() if c >= least}
    d2, d3 = (dict(zip((1, 2, 3), [discount] * 3 if discount else estimated(k))) for k in (k2, k3))
    left2, left3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, _), c in k2.items():
        left2[a] -= (c - d2[min(c, 3)]) / c1[a]
    for (a, b, _), c in k3.items():
        left3[a, b] -= (c - d3[min(c, 3)]) / k2[a, b]
    got = {}
    for i, t in rows:
        ws = words(t) + ["</s>"]
        base = [math.log10((c1[w] + 1) / (n + v + 1)) for w in ws]
        score = 0.0
        for j, w in enumerate(ws):
            b = ws[j - 1] if j else "</s>"
            p = (c1[w] + 1) / (n + v + 1)
            c = k2.get((b, w), 0)
            p = (c - d2[min(c, 3)] if c else 0) / max(c1[b], 1) + left2[b] * p
            a = (ws[j - 2] if j > 1 else "</s>") if j else None
            if a is not None and (a, b) in k2:
                c = k3.get((a, b, w), 0)
                p = (c - d3[min(c, 3)] if c else 0) / k2[a, b] + left3[a, b] * p
            score += math.log10(min(p, 1.0))
        got[i] = (out(i), len(ws), sum(c1[w] > 0 for w in ws), n, sum(base), score)
    return got


def estimated(counts):
    n = collections.Counter(counts.values())
    if not (n[1] and n[2] and n[3]):
        return [0.75] * 3
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.1) for i in (1, 2, 3)]


def check(got, want, tokens=0.003):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert abs(r.score - w[5]) <= tokens * r.n_tokens, (r, w)


def test_matches_dictionaries(spark):
    d = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    check(ngram_lm.score_texts(spark.read.parquet(f"{d}/documents.parquet"), least_count=2, discount=0.75).collect(), brute(rows))
    got = ngram_lm.op10_ngram_lm(spark, d).collect()
    check(got, brute(rows, least=1, discount=None))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges_and_many_segments(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "TOKENS_AT_ONCE", 40)
    rows = [(1, None), (2, ""), (3, "A a A a b a b c"), (4, "a b c"), (5, "a b c d e"), (None, "a b"), (6, "x " * 20000), (7, " \n\t")] + [(i, "the cat sat on the mat the dog") for i in range(10, 30)]
    df = spark.createDataFrame([(i, t, "s", 0.0) for i, t in rows], "doc_id long, text string, source string, score double")
    check(ngram_lm.score_texts(df, least_count=2, discount=0.75).collect(), brute(rows))
    check(ngram_lm.score_texts(df).collect(), brute(rows, least=1, discount=None))
    assert ngram_lm.score_texts(df.limit(0)).collect() == []
    only = next(i for i in range(1000) if out(i))
    alone = ngram_lm.score_texts(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(3, 0, 0, 0.0, 0.0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=80), st.integers(3001, 2**50))
def test_elias_fano(values, universe):
    v = np.unique(np.array(values, dtype=np.uint64))
    ef = ngram_lm.EliasFano.of(v, universe)
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()
    ask = np.arange(0, 3001, 7, dtype=np.uint64)
    at = {x: i for i, x in enumerate(v.tolist())}
    assert ef.find(ask).tolist() == [at.get(x, -1) for x in ask.tolist()]


def test_pointers_may_repeat():
    values = np.array([0, 0, 0, 5, 5, 9, 9, 9])
    assert ngram_lm.EliasFano.of(values, 10).get(np.arange(8)).tolist() == values.tolist()


def test_pairs_seen_once_count(spark):
    train, ask = ([i for i in range(1000) if out(i) == held] for held in (False, True))
    rows = [(train[0], "the red fox sleeps"), (train[1], "a blue bird sings"), (train[2], "the cat"), (train[3], "a cat")]
    df = spark.createDataFrame([*rows, (ask[0], "red fox"), (ask[1], "red bird")], "doc_id long, text string")
    seen, unseen = (r.score for r in ngram_lm.score_texts(df).filter("held_out").orderBy("doc_id").collect())
    assert seen > unseen + 0.3


def test_many_segments_under_a_limit_of_descriptors(tmp_path, monkeypatch):
    """3,000 segments of a level are read with 256 open at once and no descriptor each."""
    vocabulary, rows = 1000, []
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 3000 * vocabulary, 30_000))
    for part in range(3000):
        mine = keys[part * len(keys) // 3000 : (part + 1) * len(keys) // 3000]
        ctx, ids = mine // vocabulary, mine % vocabulary
        some, back = np.unique(ctx, return_inverse=True)
        last = np.flatnonzero(np.append(ctx[1:] != ctx[:-1], True))
        up = (np.cumsum(ids[last] + 1) - ids[last] - 1)[back] + ids + 1
        pointers = np.concatenate([[0], np.cumsum(np.bincount(ctx - ctx[0]))])
        arrays = {f"p_{k}": a for k, a in ngram_lm.EliasFano.of(pointers, len(mine) + 1).arrays().items()}
        arrays |= {f"i_{k}": a for k, a in ngram_lm.EliasFano.of(up, int(up[-1]) + vocabulary + 2).arrays().items()}
        arrays |= {"alpha": ngram_lm.code(np.full(len(mine), 0.25)), "left": ngram_lm.code(np.full(len(pointers) - 1, 0.5)), "counts": (mine % 251).astype(np.uint8)}
        rows.append((ngram_lm.write_arrays(f"file:{tmp_path}", arrays).encode(), len(mine), mine[0], ctx[0], ctx[-1]))
    path, n, first, c0, c1 = (np.array(x) for x in zip(*rows))
    columns = {"path": path, "n": n, "first": np.cumsum(n) - n, "first_key": first, "first_ctx": c0, "last_ctx": c1, "first_sum": np.full(3000, 0.1), "last_sum": np.full(3000, 0.1)}
    directory = ngram_lm.write_arrays(f"file:{tmp_path}", columns)
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(1024, before[0]), before[1]))
    try:
        open_ = len(os.listdir("/proc/self/fd"))
        level = ngram_lm.Level(directory, vocabulary, False)
        ask = np.unique(np.concatenate([keys, rng.integers(0, 3000 * vocabulary, 30_000)]))
        rank, alpha = level.find(ask // vocabulary, ask % vocabulary)
        at = {int(k): i for i, k in enumerate(keys)}
        assert rank.tolist() == [at.get(int(k), -1) for k in ask]
        assert np.allclose(alpha, np.where(rank >= 0, 0.25, 0.0), atol=1e-3)
        assert level.counts(np.arange(len(keys))).tolist() == (keys % 251).tolist()
        assert len(level.segments.held) == 256 and len(os.listdir("/proc/self/fd")) <= open_ + 2
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
