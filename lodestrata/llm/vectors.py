"""Vectors packed into blocks, and cells of (query block, candidate block).

A nearest-neighbour search compares a stated set of queries with all rows. Both sides are
packed: a block is one row that holds the ids and the matrix of up to some thousand vectors.
Each query block is sent to each group of candidate blocks, so a cell's work is one matrix
product, and no task holds more than two blocks, whatever the vectors are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import settle

def usable(vec: Column, nonzero: bool = False) -> Column:
    """Not null, not empty, every component finite (and any of them not zero). NaN is above infinity in comparisons."""
    ok = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False)) if nonzero else F.coalesce(ok, F.lit(False))


def packed(rows: DataFrame, size: int, what: str) -> DataFrame:
    """rows: id long, dim int, vec array<double> -> written blocks: block long, dim int, n int, ids binary, mat binary."""

    def pack(batches):
        held: dict[int, list] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                got = held.setdefault(int(dim), [])
                got.extend(zip(part["id"], part["vec"]))
                while len(got) >= size:
                    yield block(int(dim), got[:size])
                    del got[:size]
        for dim, got in held.items():
            if got:
                yield block(dim, got)

    def block(dim, got):
        ids = np.array([x for x, _ in got], dtype=np.int64)
        mat = np.array([v for _, v in got], dtype=np.float64).reshape(len(got), dim)
        return pd.DataFrame({"dim": [dim], "n": [len(got)], "ids": [ids.tobytes()], "mat": [mat.tobytes()]})

    found = rows.select("id", "dim", "vec").mapInPandas(pack, "dim int, n int, ids binary, mat binary")
    return settle(found, what).withColumn("block", F.monotonically_increasing_id())


def unpack(ids: bytes, mat: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(mat, dtype=np.float64).reshape(-1, dim)
