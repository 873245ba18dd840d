"""Exact top-k by inner product: distributed histogram selection.

Every query is scored against every row, cell by cell. To find a query's kth score, the scores
are counted by their leading bits; the count is summed over all cells, the interval that holds
the kth is chosen, and the next round counts only inside it, until one value is left. A cell
counts only intervals from that of its own kth upwards: k rows of this cell lie there already.
A last pass keeps the scores above the kth, and of those equal to it the smallest ids.

Scores come from matrix products in double precision where all sums stay below 2**53, and from whole
numbers of any size in the rows and columns of a cell where they may not. A score outside the range of a long is given as its nearest end.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite
component take no part, neither do rows with a null id; vectors are compared with those of the
same length; a row is no candidate of a query with its own id; repeated rows count each as candidates,
and a repeated query is asked once (of different vectors under one id, the smallest); fewer
than k candidates give fewer rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import default_parallelism, settle, table
from lodestrata.llm.vectors import packed, unpack, usable

DIGIT = 12
LEAST, MOST = -(2**63), 2**63 - 1
QUERIES_A_BLOCK, ROWS_A_BLOCK = 256, 4096


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def _whole(m: np.ndarray) -> list[list[int]]:
    return [[int(x) for x in row] for row in m.tolist()]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as longs, exactly; beyond a long's range its nearest end."""
    a, b = _norms(q), _norms(c)
    most_a, most_b = a.max(initial=0.0), b.max(initial=0.0)
    large_a, large_b = a * most_b >= 2.0**52, b * most_a >= 2.0**52
    if not large_a.any():
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), dtype=np.int64)
    small_a, small_b = np.flatnonzero(~large_a), np.flatnonzero(~large_b)
    out[np.ix_(small_a, small_b)] = (q[small_a] @ c[small_b].T).astype(np.int64)
    exact = lambda x, y: min(max(sum(i * j for i, j in zip(x, y)), LEAST), MOST)
    ask, rows = _whole(q), _whole(c)
    for i in np.flatnonzero(large_a).tolist():
        # a row of small components against a large query is exact in doubles too
        fits = a[i] * b < 2.0**52
        out[i, fits] = (c[fits] @ q[i]).astype(np.int64)
        for j in np.flatnonzero(~fits).tolist():
            out[i, j] = exact(ask[i], rows[j])
    for j in np.flatnonzero(large_b).tolist():
        for i in small_a.tolist():
            out[i, j] = int(c[j] @ q[i]) if a[i] * b[j] < 2.0**52 else exact(ask[i], rows[j])
    return out


def _cells(frames):
    """Of each cell: query ids, candidate ids, the scores, and which candidates count."""
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            qid, q = unpack(r.q_ids, r.q_mat, r.dim)
            cid, c = unpack(r.c_ids, r.c_mat, r.dim)
            yield r, qid, cid, _scores(q, c), qid[:, None] != cid[None, :]


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def exact_topk(rows: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products. vec_col holds whole numbers as double."""
    spark = rows.sparkSession
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).alias("vec"), is_query.alias("q")).filter(F.col("id").isNotNull())
    cand = packed(found, ROWS_A_BLOCK, "topk-rows")
    asked = found.filter("q").groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.dim", "v.vec")
    quer = packed(asked, QUERIES_A_BLOCK, "topk-queries")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    top, n_blocks = found.agg(F.max(norm)).first()[0], cand.count()
    if top is None or not quer.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = int(min(top, 2.0**62)) * 2 + 1  # scores lie between -reach and reach
    bits = -(-(2 * reach).bit_length() // DIGIT) * DIGIT
    groups = max(1, min(n_blocks, 4 * default_parallelism(spark)))
    left = quer.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = cand.select("dim", F.col("ids").alias("c_ids"), F.col("mat").alias("c_mat"), ((F.shiftright("block", 33) + F.col("block").bitwiseAND(2**33 - 1)) % groups).cast("int").alias("g"))

    def cells(state: DataFrame | None) -> DataFrame:
        got = left if state is None else left.join(state.hint("merge"), "q_block", "left")
        return got.hint("merge").join(right, ["g", "dim"])

    def count(shift):
        def run(frames):
            for r, qid, cid, score, counts in _cells(frames):
                known = dict(zip(r.s_ids, zip(r.s_prefix, r.s_need))) if shift + DIGIT < bits and r.s_ids is not None else {}
                out = []
                for i, x in enumerate(qid):
                    s = score[i][counts[i]]
                    prefix, need = known.get(x, (0, k))
                    if shift + DIGIT < bits:
                        if x not in known:
                            continue
                        s = s[(s >> min(shift + DIGIT, 63)) == prefix]
                    if not len(s):
                        continue
                    d = s >> min(shift, 63)
                    if len(d) > need:
                        d = d[d >= np.partition(d, len(d) - need)[len(d) - need]]
                    u, n = np.unique(d, return_counts=True)
                    out.append(pd.DataFrame({"q_block": r.q_block, "query_id": x, "bucket": u, "n": n}))
                if out:
                    yield pd.concat(out, ignore_index=True)

        return run

    down = W.partitionBy("q_block", "query_id").orderBy(F.col("bucket").desc())
    state = None
    for shift in range(bits - DIGIT, -1, -DIGIT):
        hist = cells(state).mapInPandas(count(shift), "q_block long, query_id long, bucket long, n long").groupBy("q_block", "query_id", "bucket").agg(F.sum("n").alias("n"))
        if state is None:
            need = hist.withColumn("need", F.lit(k))
        else:
            flat = state.select("q_block", F.explode(F.arrays_zip("s_ids", "s_need")).alias("s")).select("q_block", F.col("s.s_ids").alias("query_id"), F.col("s.s_need").alias("need"))
            need = hist.join(flat.hint("merge"), ["q_block", "query_id"])
        upto = need.withColumn("upto", F.sum("n").over(down))
        hit = upto.filter("upto >= need").groupBy("q_block", "query_id").agg(F.max_by(F.struct("bucket", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need")), "bucket").alias("h"))
        flat = hit.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "h.bucket", "h.need")).alias("s"))
        state = settle(flat.select("q_block", F.col("s.query_id").alias("s_ids"), F.col("s.bucket").alias("s_prefix"), F.col("s.need").cast("array<int>").alias("s_need")), "topk-state")

    def pick(frames):
        for r, qid, cid, score, counts in _cells(frames):
            known = dict(zip(r.s_ids, zip(r.s_prefix, r.s_need))) if r.s_ids is not None else {}
            out = []
            for i, x in enumerate(qid):
                s, ids = score[i][counts[i]], cid[counts[i]]
                kth, need = known.get(x, (0, k))
                if x in known:
                    above, tied = np.flatnonzero(s > kth), np.flatnonzero(s == kth)
                    if len(tied) > need:
                        tied = tied[np.argsort(ids[tied], kind="stable")[:need]]
                    at = np.concatenate([above, tied])
                else:
                    at = _top(s, ids, k)
                if len(at):
                    out.append(pd.DataFrame({"query_id": x, "vec_id": ids[at], "score": s[at]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    kept = cells(state).mapInPandas(pick, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    # beyond 2**52 a double has no fraction, and floor would cut it to a long; products over the largest double count as that
    scaled = lambda x: F.greatest(F.least(x.cast("double") * 1024, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    floor = lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    whole = rows.select("vec_id", F.transform("embedding", floor).alias("whole"))
    return exact_topk(whole, "vec_id", "whole", F.col("vec_id") % 100 == 0)


OP9_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
