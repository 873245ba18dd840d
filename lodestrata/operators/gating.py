"""The quality gate of an answer: a first-match ladder, and its rounds as a state fold.

A round is what the critique and the judge said of one version of an answer. The gate looks at a round
and at the state so far (budgets spent, actions taken, the last score) and accepts, stops, or asks for one
of four retries. ``gate_rounds`` carries the state through a question's rounds in their order; as a
question has at most ``max_total_rounds`` + 1 of them, it folds a short array, and questions are independent.

Defined results: metrics that are null count as 0, flags that are null as false, and the verdict as none of the known ones; of
repeated rounds the least is taken; a question whose next round is missing stays with
the action that was asked for and is not finished.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "citation_grounding")
FLAGS = ("needs_correction", "coverage_gap", "missing_inline", "inline_not_declared", "unknown_used", "unanswered")
COUNTERS = ("total_rounds_used", "pipeline_reruns_used", "answer_regenerations_used", "repairs_used")
STOPS = ("stop_accept", "stop_best_effort")


@dataclass(frozen=True)
class Budgets:
    total_rounds: int = 2
    pipeline_reruns: int = 1
    answer_regenerations: int = 1
    repairs: int = 1


def average_score(r: Column) -> Column:
    return F.round(sum((F.coalesce(r[m].cast("double"), F.lit(0.0)) for m in METRICS), F.lit(0.0)) / 4, 3)


def decide(r: Column, s: Column, b: Budgets = Budgets()) -> Column:
    """struct<action, reason> for a round (METRICS, FLAGS, overall_verdict) and a state (COUNTERS, actions_taken: how many, last_score)."""
    metric = lambda m: F.coalesce(r[m].cast("int"), F.lit(0))
    flag = lambda f: F.coalesce(r[f], F.lit(False))
    verdict, score = F.coalesce(r["overall_verdict"], F.lit("")), average_score(r)
    citations = flag("missing_inline") | flag("inline_not_declared")
    integrity, coverage, wrong = citations | flag("unknown_used"), flag("unanswered"), flag("needs_correction")
    good = (metric("faithfulness") >= 4) & (metric("answer_relevancy") >= 4) & (metric("citation_grounding") >= 4)
    left = {c: s[f"{c}_used"] < getattr(b, c) for c in ("total_rounds", "pipeline_reruns", "answer_regenerations", "repairs")}
    stuck = F.coalesce(score <= s["last_score"], F.lit(False)) & (s["actions_taken"] > 0)
    # The actions and their reasons.
    ladder = [
        (~wrong & (verdict == "pass"), "stop_accept", "Critique and judge both accept the answer."),
        ((verdict == "pass") & ~wrong & ~integrity & good, "stop_accept", "Judge passed the answer and citation integrity is intact."),
        (~integrity & ~coverage & ~wrong & verdict.isin("pass", "borderline") & (score >= 3.75) & good, "stop_accept", "Answer is grounded enough to return without an expensive retry."),
        (~left["total_rounds"], "stop_best_effort", "Total retry budget exhausted."),
        (stuck, "stop_best_effort", "Quality did not improve after the previous retry."),
        (citations & left["repairs"], "citation_strict_repair", "Citation integrity failed deterministic checks."),
        (wrong & flag("coverage_gap") & coverage & (verdict != "pass") & left["repairs"], "targeted_answer_repair", "Coverage gap detected by critique."),
        (verdict.isin("fail", "borderline") & (metric("answer_relevancy") <= 3) & left["answer_regenerations"], "answer_regeneration_only", "Answer relevancy is too low."),
        ((verdict == "fail") & ((metric("faithfulness") <= 2) | (metric("context_precision") <= 2)) & left["pipeline_reruns"], "full_pipeline_rerun_once", "Judge indicates low faithfulness or noisy context."),
        (wrong & left["repairs"], "targeted_answer_repair", "Critique still requests correction."),
        ((verdict == "borderline") & (metric("citation_grounding") <= 3) & left["repairs"], "citation_strict_repair", "Citation grounding is borderline and repair budget remains."),
        (F.lit(True), "stop_best_effort", "No safe retry action remains within budget."),
    ]
    out = F.lit(None).cast("struct<action:string,reason:string>")
    for rule, action, reason in reversed(ladder):
        out = F.when(rule, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def runtime_gate(rows: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """Adds action and reason to rows that have a round's columns and a state's."""
    r = F.struct(*METRICS, *FLAGS, "overall_verdict")
    s = F.struct(*COUNTERS, "actions_taken", "last_score")
    return rows.withColumns({"_r": r, "_s": s}).withColumn("_d", decide(F.col("_r"), F.col("_s"), budgets)).withColumns({"action": F.col("_d.action"), "reason": F.col("_d.reason")}).drop("_r", "_s", "_d")


_STATE = (
    "struct<total_rounds_used:int,pipeline_reruns_used:int,answer_regenerations_used:int,repairs_used:int,actions_taken:int,last_score:double,"
    "action:string,reason:string,stopped:boolean,actions:array<string>,history:array<struct<round:int,action:string,score:double,verdict:string>>>"
)


def gate_rounds(rounds: DataFrame, key: str, budgets: Budgets = Budgets()) -> DataFrame:
    """rounds: key, round (from 0) and a round's columns -> a row for each key: the counters, action, reason, stopped, actions, history.

    A round's score is the last score before the gate looks at the round, as the loop that the gate stands in sets it when
    an answer was made: after a retry an answer that is not accepted is thus at the end of its rounds.
    """
    body = F.struct("round", *METRICS, *FLAGS, "overall_verdict")
    some = rounds.filter(F.col("round").between(0, budgets.total_rounds)).groupBy(key, "round").agg(F.min(body).alias("r"))
    folded = some.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rounds"))
    first = F.struct(*[F.lit(0).alias(c) for c in (*COUNTERS, "actions_taken")], F.lit(None).cast("double").alias("last_score"), F.lit("initial_generation").alias("action"), F.lit("").alias("reason"), F.lit(False).alias("stopped"), F.array().cast("array<string>").alias("actions"), F.array().cast("array<struct<round:int,action:string,score:double,verdict:string>>").alias("history"))

    def step(s: Column, r: Column) -> Column:
        score = average_score(r)
        d = decide(r, s.withField("last_score", score), budgets)
        retry = ~d["action"].isin(*STOPS)
        used = lambda name, *actions: (s[name] + F.when(d["action"].isin(*actions), 1).otherwise(0)).alias(name)
        seen = F.struct(s["total_rounds_used"].alias("round"), s["action"].alias("action"), score.alias("score"), r["overall_verdict"].alias("verdict"))
        made = F.struct(
            (s["total_rounds_used"] + retry.cast("int")).alias("total_rounds_used"), used("pipeline_reruns_used", "full_pipeline_rerun_once"), used("answer_regenerations_used", "answer_regeneration_only"),
            used("repairs_used", "targeted_answer_repair", "citation_strict_repair"), (s["actions_taken"] + retry.cast("int")).alias("actions_taken"), score.alias("last_score"), d["action"].alias("action"), d["reason"].alias("reason"),
            (~retry).alias("stopped"), F.when(retry, F.concat(s["actions"], F.array(d["action"]))).otherwise(s["actions"]).alias("actions"), F.concat(s["history"], F.array(seen)).alias("history"),
        )
        # a round counts only if it is the next one
        return F.when(s["stopped"] | (r["round"] != s["total_rounds_used"]), s).otherwise(made.cast(_STATE))

    end = folded.withColumn("end", F.aggregate("rounds", first.cast(_STATE), step))
    return end.select(key, *[F.col(f"end.{c}").alias(c) for c in (*COUNTERS, "last_score", "action", "reason", "stopped", "actions", "history")])
