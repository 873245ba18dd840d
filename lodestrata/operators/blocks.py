"""Rows packed into blocks, and cells of (query block, corpus block).

A search over a stated set of queries compares them with all rows. Both sides are packed, some
hundred or thousand rows to a block, and every query block meets every corpus block once: query blocks are copied to each of a
number of groups, corpus blocks are dealt to one group. A task works on one pair of blocks at a time, so its memory is
bounded whatever the tables are, nothing passes through the driver, and the corpus moves once. Where all query blocks together are
small (``FEW_BYTES``), a search may leave the corpus where it is and have the query blocks broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.cut import settled

#: Query blocks of up to so many bytes in all may be broadcast.
FEW_BYTES = 32 << 20


def squeezed(what) -> bytes:
    """``what`` pickled and compressed, after its size in eight bytes."""
    data = pickle.dumps(what)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes):
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"))


def packed(rows: DataFrame, size: int, pack: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """block long, data binary: ``pack`` makes the bytes of up to ``size`` rows."""

    def run(batches: Iterator[pd.DataFrame]):
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= size:
                every = pd.concat(held, ignore_index=True)
                full = len(every) // size * size
                yield pd.DataFrame({"data": [pack(every.iloc[at : at + size]) for at in range(0, full, size)]})
                held, n = [every.iloc[full:]], len(every) - full
        if n:
            yield pd.DataFrame({"data": [pack(pd.concat(held, ignore_index=True))]})

    made = rows.mapInPandas(run, "data binary")
    return settled(made.select(F.monotonically_increasing_id().alias("block"), "data"))


def cells(queries: DataFrame, corpus: DataFrame, stay: bool = False) -> DataFrame:
    """q, c (binary): every pair of a query block and a corpus block. ``stay``: the corpus is in many partitions and is not moved if
    the query blocks can be broadcast."""
    if stay and (queries.agg(F.sum(F.length("data"))).first()[0] or 0) <= FEW_BYTES:
        return corpus.select(F.col("data").alias("c")).crossJoin(F.broadcast(queries.select(F.col("data").alias("q")))).select("q", "c")
    parallel = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, min(8 * parallel, corpus.count()))
    left = queries.select(F.col("data").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = corpus.select(F.col("data").alias("c"), F.pmod(F.xxhash64("block"), groups).cast("int").alias("g"))
    # the side given second is the one that the join holds for a group: the query blocks, not the corpus
    # a stated number of partitions, as groups of few bytes but much work are not to be put together
    return right.repartition(groups, "g").hint("merge").join(left.repartition(groups, "g"), "g").select("q", "c")


def best_of_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores of each row, ties to the smaller id."""
    n = score.shape[1]
    if n > k:
        kth = np.partition(score, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
    else:
        row, col = np.nonzero(np.isfinite(score))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]
