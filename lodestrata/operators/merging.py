"""Merging, coverage, retries, diversification and context of retrieved matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import coverage_tokens
from lodestrata.operators.retrieval import cosine, top_k


def _ordered(what: Column) -> Column:
    """Values in the order of arrival (ord)."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", what.alias("x")))), lambda p: p["x"])


def merge_dedup(matches: DataFrame) -> DataFrame:
    """matches: sub_query_id, chunk_no, ord (arrival), score, variant -> a row for each chunk of a sub-query.

    best_score is the highest, best_ord the first arrival with it; variants are in order of arrival, each once.
    """
    return matches.groupBy("sub_query_id", "chunk_no").agg(
        F.max("score").alias("best_score"),
        F.max_by("ord", F.struct("score", (-F.col("ord")).alias("o"))).alias("best_ord"),
        F.count("*").alias("match_count"),
        F.array_distinct(_ordered(F.col("variant"))).alias("variants"),
        F.min("ord").alias("first_ord"),
    )


def ranked(merged: DataFrame) -> DataFrame:
    order = W.partitionBy("sub_query_id").orderBy(F.col("best_score").desc(), F.col("match_count").desc(), "first_ord")
    return merged.withColumn("rk", F.row_number().over(order))


def retry_merge(merged: DataFrame, more: DataFrame) -> DataFrame:
    """Merges the matches of a retry into a merged set under the same rules; theirs arrive later."""
    both = merged.unionByName(merge_dedup(more))
    return both.groupBy("sub_query_id", "chunk_no").agg(
        F.max("best_score").alias("best_score"),
        F.max_by("best_ord", F.struct("best_score", (-F.col("best_ord")).alias("o"))).alias("best_ord"),
        F.sum("match_count").alias("match_count"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "variants"))), lambda p: p["variants"]))).alias("variants"),
        F.min("first_ord").alias("first_ord"),
    )


def overlap_ratio(query: Column, evidence: Column) -> Column:
    """Share of the query's distinct tokens that the evidence has."""
    asked = F.array_distinct(coverage_tokens(query))
    shared = F.size(F.array_intersect(asked, coverage_tokens(evidence)))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked))


def coverage_scores(rows: DataFrame) -> DataFrame:
    """rows: sub_query_id, rk, best_score, match_count, chunk_no, query_text, evidence -> the signals, score and label of a sub-query."""
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", "evidence")))), lambda x: x["evidence"])
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", "chunk_no")))), lambda x: x["chunk_no"])
    got = rows.groupBy("sub_query_id").agg(
        F.max(F.when(F.col("rk") == 1, F.col("best_score"))).alias("top_score"),
        overlap_ratio(F.first("query_text"), F.array_join(top, " ")).alias("overlap"),
        F.least(F.count_if((F.col("rk") <= 5) & (F.col("match_count") >= 2)) / 3.0, F.lit(1.0)).alias("reinforced"),
        F.least(F.count("*") / 5.0, F.lit(1.0)).alias("depth"),
        F.concat_ws("|", ids).alias("top_match_ids"),
    )
    strength = F.when(F.col("top_score") <= 0, F.lit(0.0)).otherwise(F.least(F.col("top_score") / 3.0, F.lit(1.0)))
    got = got.withColumn("strength", strength).withColumn("coverage_score", F.round(0.45 * F.col("strength") + 0.35 * F.col("overlap") + 0.10 * F.col("reinforced") + 0.10 * F.col("depth"), 4))
    label = F.when(F.col("coverage_score") >= 0.72, "strong").when(F.col("coverage_score") >= 0.48, "moderate").otherwise("weak")
    return got.withColumn("coverage_label", label)


def coverage_summary(scores: DataFrame) -> DataFrame:
    weak = F.col("coverage_label") == "weak"
    ids = F.array_sort(F.collect_list(F.when(weak, F.col("sub_query_id"))))
    return scores.agg(F.count("*").alias("sub_query_count"), F.round(F.avg("coverage_score"), 4).alias("average_coverage_score"), F.count_if(weak).alias("weak_sub_query_count"), F.concat_ws("|", ids).alias("weak_sub_query_ids"))


def hyde_reasons() -> Column:
    """Why a sub-query is retried, over the columns of ``coverage_scores``."""
    r = lambda c: F.round(F.col(c), 4)
    rules = [
        (F.col("coverage_label") == "weak", "coverage_label_weak"),
        ((r("overlap") < 0.2) & (r("top_score") < 2.2), "very_low_overlap_and_unconvincing_score"),
        ((r("overlap") < 0.12) & (r("reinforced") < 0.34), "low_overlap_and_low_reinforcement"),
        ((r("strength") < 0.35) & (r("depth") < 0.4), "shallow_low_score_result_set"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def mmr_select(candidates: DataFrame, keys: list[str], m: int = 4, weight: float = 0.75) -> DataFrame:
    """candidates: keys, chunk_no, rank, relevance, vec (a few for each key) -> those chosen, with their place and MMR score.

    The first is the most relevant; each next one has the highest weight * relevance - (1 - weight) * greatest cosine
    to one chosen before; ties go to the better rank. One pass for each place: the greatest cosine of the rest is
    carried along, and only the newest choice is compared.
    """
    left = candidates.withColumn("near", F.lit(None).cast("double"))
    out = None
    for place in range(1, m + 1):
        score = F.col("relevance") if place == 1 else F.round(weight * F.col("relevance") - (1 - weight) * F.col("near"), 6)
        order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "rank")
        picked = left.withColumn("score", score).withColumn("_n", F.row_number().over(order))
        best = picked.filter("_n = 1")
        one = best.select(*keys, "chunk_no", F.lit(place).alias("place"), F.col("score").alias("mmr_score"))
        out = one if out is None else out.unionByName(one)
        if place < m:
            newest = F.first("vec").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            picked = picked.withColumn("near", F.greatest("near", cosine(F.col("vec"), newest)))
            left = picked.filter("_n > 1").drop("_n", "score")
    return out


def parent_context(hits: DataFrame, parents: int = 4, children: int = 2) -> DataFrame:
    """hits: query_id, rk, score, child_id, parent_id -> a query's best parents: best rank and score, their first children, how many."""
    ids = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rk", "child_id"))), lambda x: x["child_id"]), 1, children)
    rows = hits.groupBy("query_id", "parent_id").agg(F.min("rk").alias("best_rank"), F.max("score").alias("best_score"), F.concat_ws("|", ids).alias("children"), F.count("*").alias("hit_count"))
    return top_k(rows, ["query_id"], [F.col("best_rank"), F.col("best_score").desc()], parents, "parent_rank")


#: What the average coverage must reach for a cheaper profile to stand, and how many matches it then gives.
PROFILES = {"fast": (0.62, 3), "balanced": (0.70, 4)}
PROFILE_NAMES = ["skip", "fast", "balanced", "full", "fast_escalated", "balanced_escalated"]


def decided_profiles(plan: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """plan: key, planned (skip, fast, balanced or full); scores: key, coverage_score, coverage_label -> plan with average, weak and profile: the planned
    one if it stands, else full, or ``_escalated`` where a cheaper one was planned. Without scores a cheaper profile does not stand."""
    got = scores.groupBy(key).agg(F.round(F.avg("coverage_score"), 4).alias("average"), F.count_if(F.col("coverage_label") == "weak").alias("weak"))
    stands = F.lit(False)
    for name, (least, _) in PROFILES.items():
        stands = stands | ((F.col("planned") == name) & (F.col("average") >= least) & (F.col("weak") == 0))
    stands = F.coalesce(stands, F.lit(False)) | F.col("planned").isin("skip", "full")
    return plan.join(got.hint("merge"), key, "left").withColumn("profile", F.when(stands, F.col("planned")).otherwise(F.concat("planned", F.lit("_escalated"))))


def execute_profiles(decided: DataFrame, ranked_matches: DataFrame, full, key: str) -> DataFrame:
    """key, profile, place, chunk_no, score: the first matches where a cheaper profile stood, and what ``full`` (a function from matches to
    key, place, chunk_no, score) gives for the others; only their matches go through it."""
    first = F.coalesce(*[F.when(F.col("profile") == name, n) for name, (_, n) in PROFILES.items()], F.lit(0))
    some = ranked_matches.join(decided.select(key, "profile").hint("merge"), key)
    cheap = some.filter(F.col("rk") <= first).select(key, "profile", F.col("rk").alias("place"), "chunk_no", F.col("best_score").alias("score"))
    again = decided.filter((F.col("profile") == "full") | F.col("profile").endswith("_escalated")).select(key, "profile")
    dear = full(ranked_matches.join(again.hint("merge"), key, "left_semi")).join(again.hint("merge"), key)
    return cheap.unionByName(dear.select(key, "profile", "place", "chunk_no", "score"))


def zero_filled(counts: DataFrame, key: str, values: list[str], count: str) -> DataFrame:
    """Counts for a fixed list of values, 0 where there are none: a zero for each value is added to the counts of those."""
    zeros = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key), F.lit(0).cast("long").alias(count))
    return counts.filter(F.col(key).isin(values)).select(key, F.col(count).cast("long").alias(count)).unionByName(zeros).groupBy(key).agg(F.sum(count).alias(count))
