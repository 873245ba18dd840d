import oracle
from pyspark.sql import functions as F

from lodestrata.llm import exact_topk


def brute(rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and abs(x) < 2**52 for x in v)]
    for q, a in {i: v for i, v in good if i % 3 == 0}.items():
        got = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return sorted(out)


def run(spark, rows, k=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.filter(exact_topk.usable(F.col("embedding")))
    return sorted(tuple(r) for r in exact_topk.exact_topk(df, "vec_id", "embedding", F.col("vec_id") % 3 == 0, k).collect())


def test_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    assert oracle.same(exact_topk.op9_exact_topk(spark, d), d, exact_topk.OP9_SQL) == 50


def test_ties_nulls_and_mixed_lengths(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROWS_A_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "QUERIES_A_BLOCK", 2)
    rows = [(i, [float(i % 2), float(-(i % 5)), 1.0]) for i in range(40)] + [(50 + i, [1.0, 2.0, 3.0]) for i in range(12)]
    rows += [(90, None), (93, []), (96, [1.0, None, 2.0]), (99, [float("nan"), 1.0, 1.0]), (102, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [2.0]), (107, [3.0])]
    assert run(spark, rows) == brute(rows, 4)


def test_large_numbers_and_empty(spark):
    rows = [(i, [float(2**29 + i), float(-(2**29) + 3 * i)]) for i in range(9)]
    assert run(spark, rows) == brute(rows, 4)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == [] and run(spark, [(3, [1.0])]) == []


def test_large_finite_components_and_clashing_columns(spark):
    rows = [(0, [1e16, 1.0]), (1, [2.0, 3.0]), (2, [-1e300, 5.0]), (3, [float(2**31), float(-(2**31))]), (4, [float(2**31), 7.0]), (6, [1.0, 1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, id int, block string, dim int")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(df.filter(exact_topk.usable(F.col("embedding"))), "vec_id", "embedding", F.col("vec_id") % 3 == 0, 4).collect())
    want = []
    for q, a in rows:
        if q % 3 == 0:
            far = sorted((-min(max(sum(int(x) * int(y) for x, y in zip(a, b)), exact_topk.LEAST), exact_topk.MOST), i) for i, b in rows if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(far)]
    assert got == sorted(want)
