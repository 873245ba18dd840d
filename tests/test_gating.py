import pytest
from pyspark.sql import functions as F

from lodestrata.operators import gating

ROUND = dict(faithfulness=5, answer_relevancy=5, context_precision=5, citation_grounding=5, needs_correction=False, coverage_gap=False, missing_inline=False, inline_not_declared=False, unknown_used=False, unanswered=False, overall_verdict="pass")
STATE = dict(total_rounds_used=0, pipeline_reruns_used=0, answer_regenerations_used=0, repairs_used=0, actions_taken=0, last_score=None)
SCHEMA = ", ".join(f"{c} int" for c in gating.METRICS) + ", " + ", ".join(f"{c} boolean" for c in gating.FLAGS) + ", overall_verdict string"
LOW = dict(faithfulness=2, answer_relevancy=2, context_precision=2, citation_grounding=2, overall_verdict="fail", needs_correction=True)
CASES = [
    ({}, {}, "stop_accept", "Critique and judge"),
    (LOW | dict(coverage_gap=True), dict(total_rounds_used=2), "stop_best_effort", "Total retry"),
    (dict(needs_correction=True, missing_inline=True, overall_verdict="borderline", faithfulness=4, answer_relevancy=4, context_precision=4, citation_grounding=2), {}, "citation_strict_repair", "Citation integrity"),
    (dict(overall_verdict="borderline", faithfulness=4, answer_relevancy=2, context_precision=4, citation_grounding=4), {}, "answer_regeneration_only", "Answer relevancy"),
    (dict(overall_verdict="fail", faithfulness=1, answer_relevancy=4, context_precision=2, citation_grounding=4), {}, "full_pipeline_rerun_once", "Judge indicates"),
    (LOW | dict(coverage_gap=True), dict(actions_taken=1, last_score=2.5), "stop_best_effort", "Quality did not"),
    (dict(overall_verdict="borderline", faithfulness=4, answer_relevancy=4, citation_grounding=4, context_precision=3), {}, "stop_accept", "Answer is grounded"),
    (dict(overall_verdict="borderline", faithfulness=4, answer_relevancy=4, citation_grounding=4, context_precision=3, unanswered=True), {}, "stop_best_effort", "No safe"),
    (LOW | dict(coverage_gap=True, unanswered=True), {}, "targeted_answer_repair", "Coverage gap"),
    (LOW | dict(answer_relevancy=4, faithfulness=3, context_precision=3), {}, "targeted_answer_repair", "Critique still"),
    (dict(overall_verdict="borderline", answer_relevancy=4, citation_grounding=3), {}, "citation_strict_repair", "Citation grounding"),
    (dict(overall_verdict="borderline", answer_relevancy=4, citation_grounding=3), dict(repairs_used=1), "stop_best_effort", "No safe"),
    (LOW, dict(last_score=1.9, actions_taken=1, repairs_used=1, answer_regenerations_used=1), "full_pipeline_rerun_once", "Judge indicates"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_ladder(spark, case):
    r, s, action, reason = CASES[case]
    row = ROUND | STATE | r | s
    schema = SCHEMA + ", " + ", ".join(f"{c} int" for c in (*gating.COUNTERS, "actions_taken")) + ", last_score double"
    got = gating.runtime_gate(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)).first()
    assert got.action == action and got.reason.startswith(reason)


def rounds_of(spark, questions):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [(q, n, *[(ROUND | r)[c] for c in names]) for q, rs in questions.items() for n, r in rs]
    return spark.createDataFrame(rows, "query_id string, round int, " + SCHEMA)


def test_rounds(spark):
    cites = dict(needs_correction=True, missing_inline=True, overall_verdict="fail")
    got = {r.query_id: r for r in gating.gate_rounds(rounds_of(spark, {
        "accepted": [(0, {}), (1, LOW)],
        "repaired": [(1, {}), (0, cites)],  # rounds come in any order
        "stuck": [(0, LOW), (1, LOW | dict(faithfulness=4))],
        "open": [(0, LOW)],
        "gap": [(0, LOW), (2, {})],
        "late": [(1, {}), (2, {})],
        "twice": [(0, LOW), (0, LOW), (1, {}), (1, {})],
        "beyond": [(0, cites), (1, {}), (7, LOW)],
    }), "query_id").collect()}
    said = {q: (r.stopped, r.action, list(r.actions), r.total_rounds_used, r.repairs_used, r.answer_regenerations_used, len(r.history)) for q, r in got.items()}
    assert said == {
        "accepted": (True, "stop_accept", [], 0, 0, 0, 1),
        "repaired": (True, "stop_accept", ["citation_strict_repair"], 1, 1, 0, 2),
        "stuck": (True, "stop_best_effort", ["answer_regeneration_only"], 1, 0, 1, 2),
        "open": (False, "answer_regeneration_only", ["answer_regeneration_only"], 1, 0, 1, 1),
        "gap": (False, "answer_regeneration_only", ["answer_regeneration_only"], 1, 0, 1, 1),
        "late": (False, "initial_generation", [], 0, 0, 0, 0),
        "twice": (True, "stop_accept", ["answer_regeneration_only"], 1, 0, 1, 2),
        "beyond": (True, "stop_accept", ["citation_strict_repair"], 1, 1, 0, 2),
    }
    assert got["stuck"].reason.startswith("Quality did not") and [h.action for h in got["repaired"].history] == ["initial_generation", "citation_strict_repair"]


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([("x", 0, *[None] * len(SCHEMA.split(", ")))], "query_id string, round int, " + SCHEMA)
    assert gating.gate_rounds(none, "query_id").first().action == "stop_best_effort"
    assert gating.gate_rounds(none.filter(F.lit(False)), "query_id").collect() == []
