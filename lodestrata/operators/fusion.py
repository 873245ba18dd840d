"""Facts of several sources: normalisation, overlaps, conflicts, ranking, fusion.

One wide table of facts: fact_id, source_type, sub_query_id, fact_type, summary, entities (array), section, parent_id, scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import plain_key

#: The order of sources in an answer.
SOURCE_ORDER = {"sql_structured": 0, "graph_relationships": 1, "vector_document": 2}
TITLE = r"\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9&.-]+){0,5}|AI)\b"


def title_entities(text: Column, most: int = 8) -> Column:
    """Capitalised phrases, the first eight (part of the definition), each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TITLE), F.lit(0)), lambda x: F.regexp_replace(x, r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", ""))
    return F.array_distinct(F.slice(F.filter(found, lambda x: F.length(x) >= 2), 1, most))


def fact(rows: DataFrame, prefix: str, source: str, kind: str, ident: Column, summary: Column, cut: int, entities: Column, section: Column, parent: Column, score: Column) -> DataFrame:
    return rows.select(
        F.concat(F.lit(f"{prefix}::"), ident).alias("fact_id"), F.lit(source).alias("source_type"), "sub_query_id", F.lit(kind).alias("fact_type"), F.substring(summary, 1, cut).alias("summary"),
        entities.alias("entities"), section.cast("string").alias("section"), parent.cast("string").alias("parent_id"), score.cast("double").alias("score"),
    )


def fact_keys(facts: DataFrame) -> DataFrame:
    """key_kind, key, source_type, fact_id, sub_query_id for the entities, parent and section of every fact, normalised."""
    kinds = [("entity", facts.select("*", F.explode("entities").alias("raw"))), ("parent", facts.withColumn("raw", F.col("parent_id"))), ("section", facts.withColumn("raw", F.col("section")))]
    out = None
    for kind, rows in kinds:
        one = rows.select(F.lit(kind).alias("key_kind"), plain_key(F.col("raw")).alias("key"), "source_type", "fact_id", "sub_query_id").filter("key <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def overlap_signals(facts: DataFrame) -> DataFrame:
    """Keys that facts of more than one source have: sources and the number of facts.

    A frequent key may belong to a large share of all facts: facts are counted for each source first, so a key's group has a row a source.
    """
    per = fact_keys(facts).groupBy("key_kind", "key", "source_type").agg(F.count_distinct("fact_id").alias("n"), F.min("fact_id").alias("first_fact"))
    got = per.groupBy("key_kind", "key").agg(F.count("*").alias("sources_n"), F.concat_ws("|", F.array_sort(F.collect_list("source_type"))).alias("sources"), F.sum("n").alias("fact_count"), F.min("first_fact").alias("first_fact"))
    return got.filter("sources_n > 1").drop("sources_n")


def value_conflicts(rows: DataFrame, keys: list[str], order: list[str], value: str, ident: str) -> DataFrame:
    """Rows whose value differs from the first seen of their keys, with the last earlier row that agreed with it."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.filter(F.col(value).isNotNull()).withColumn("first_value", first)
    held = F.last(F.when(F.col(value) == F.col("first_value"), F.col(ident)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("against", held).filter(F.col(value) != F.col("first_value"))


def fact_rank(facts: DataFrame) -> DataFrame:
    """answer_rank within a sub-query: by source, kind, score, id."""
    place = F.coalesce(*[F.when(F.col("source_type") == s, F.lit(n)) for s, n in SOURCE_ORDER.items()], F.lit(9))
    kind = F.when(F.col("fact_type") == "sql_row", 0).when(F.col("fact_type") == "graph_edge", 1).when(F.col("fact_type") == "graph_node", 2).otherwise(3)
    order = W.partitionBy("sub_query_id").orderBy(place, kind, F.col("score").desc(), "fact_id")
    return facts.withColumn("answer_rank", F.row_number().over(order))


def answer_line(source: Column, summary: Column) -> Column:
    mark = F.when(source == "sql_structured", "[SQL] ").when(source == "graph_relationships", "[Graph] ").otherwise("[Vector] ")
    return F.concat(mark, summary)


def sub_query_fusion(ranked: DataFrame, lines: int = 8) -> DataFrame:
    """Per sub-query its sources, number of facts and the text of its first lines. The sums come first; only the first lines are gathered."""
    sums = ranked.groupBy("sub_query_id", "source_type").agg(F.count("*").alias("n")).groupBy("sub_query_id").agg(F.sum("n").alias("fact_count"), F.concat_ws("|", F.array_sort(F.collect_list("source_type"))).alias("active_sources"))
    some = ranked.filter(F.col("answer_rank") <= lines).select("sub_query_id", F.struct("answer_rank", answer_line(F.col("source_type"), F.col("summary")).alias("l")).alias("x"))
    text = some.groupBy("sub_query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))
    return sums.join(text.hint("merge"), "sub_query_id")


def compression_gate(facts: DataFrame, least: tuple[int, int, int] = (30, 2, 8)) -> DataFrame:
    got = facts.agg(F.count("*").alias("fact_count"), F.count_distinct("sub_query_id").alias("sub_query_count"), F.count_if(F.col("source_type") == "vector_document").alias("vector_count"))
    return got.withColumn("compress", (F.col("fact_count") >= least[0]) & (F.col("sub_query_count") >= least[1]) & (F.col("vector_count") >= least[2]))
