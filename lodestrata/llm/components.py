"""Connected components of a graph in DataFrames, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import settle

FEW_EDGES = 1_000_000


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long -> node, comp (its component's smallest node), for the nodes that have an edge to another one.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; a
    star for each component is left after some log(n) rounds. A node's minimum is aggregated before rows move and, beyond FEW_EDGES edges, written, so both
    joins read plain exchanges, of which Spark may split that of a hub with very many neighbours. It ends when a round changes nothing.
    """
    e = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    stamp = _stamp(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        parted = (lambda df, what: settle(df, what)) if stamp[0] > FEW_EDGES else (lambda df, what: df)
        least = parted(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = parted(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        hung = large.join(low.hint("merge"), "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        e = settle(hung.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "edges")
        new = _stamp(e)
        if new == stamp:
            break
        stamp = new
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(e.select("lo", "lo").distinct())
