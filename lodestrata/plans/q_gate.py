"""Queries: the runtime gate and its rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import gating
from lodestrata.plans.registry import register
from lodestrata.plans.views import spark_view, with_views

_SCORE = "CAST(round((r.faithfulness + r.answer_relevancy + r.context_precision + r.citation_grounding) / 4.0, 3) AS DOUBLE)"
_GOOD = "r.faithfulness >= 4 AND r.answer_relevancy >= 4 AND r.citation_grounding >= 4"
_CITES = "(r.missing_inline OR r.inline_not_declared)"
_REPAIRS, _REGENERATIONS, _RERUNS = "{s}.repairs_used < 1", "{s}.answer_regenerations_used < 1", "{s}.pipeline_reruns_used < 1"
#: (rule, action, reason), the first that holds counts.
_LADDER = [
    ("NOT r.needs_correction AND r.overall_verdict = 'pass'", "stop_accept", "Critique and judge both accept the answer."),
    (f"r.overall_verdict = 'pass' AND NOT r.needs_correction AND NOT ({_CITES} OR r.unknown_used) AND {_GOOD}", "stop_accept", "Judge passed the answer and citation integrity is intact."),
    (f"NOT ({_CITES} OR r.unknown_used) AND NOT r.unanswered AND NOT r.needs_correction AND r.overall_verdict IN ('pass', 'borderline') AND {_SCORE} >= 3.75 AND {_GOOD}", "stop_accept", "Answer is grounded enough to return without an expensive retry."),
    ("{s}.total_rounds_used >= 2", "stop_best_effort", "Total retry budget exhausted."),
    (f"{_SCORE} <= {{last}} AND {{s}}.actions_taken > 0", "stop_best_effort", "Quality did not improve after the previous retry."),
    (f"{_CITES} AND {_REPAIRS}", "citation_strict_repair", "Citation integrity failed deterministic checks."),
    (f"r.needs_correction AND r.coverage_gap AND r.unanswered AND r.overall_verdict <> 'pass' AND {_REPAIRS}", "targeted_answer_repair", "Coverage gap detected by critique."),
    (f"r.overall_verdict IN ('fail', 'borderline') AND r.answer_relevancy <= 3 AND {_REGENERATIONS}", "answer_regeneration_only", "Answer relevancy is too low."),
    (f"r.overall_verdict = 'fail' AND (r.faithfulness <= 2 OR r.context_precision <= 2) AND {_RERUNS}", "full_pipeline_rerun_once", "Judge indicates low faithfulness or noisy context."),
    (f"r.needs_correction AND {_REPAIRS}", "targeted_answer_repair", "Critique still requests correction."),
    (f"r.overall_verdict = 'borderline' AND r.citation_grounding <= 3 AND {_REPAIRS}", "citation_strict_repair", "Citation grounding is borderline and repair budget remains."),
]


def _pick(place: int, otherwise: str, s: str, last: str) -> str:
    return ("CASE " + " ".join(f"WHEN {rule[0]} THEN '{rule[place]}'" for rule in _LADDER) + f" ELSE '{otherwise}' END").format(s=s, last=last)


def _decision(s: str, last: str) -> str:
    return f"{_pick(1, 'stop_best_effort', s, last)} AS action, {_pick(2, 'No safe retry action remains within budget.', s, last)} AS reason"


@register("runtime_gate", with_views(f"SELECT query_id, turn, {_decision('r', 'r.last_score')} FROM gate_input r", "gate_input"))
def runtime_gate(spark, sf_dir):
    return gating.runtime_gate(spark_view(spark, sf_dir, "gate_input")).select("query_id", "turn", "action", "reason")


_ZERO = "SELECT 0 AS total_rounds_used, 0 AS pipeline_reruns_used, 0 AS answer_regenerations_used, 0 AS repairs_used, 0 AS actions_taken"


def _more(actions: str) -> str:
    return f"CAST(f.action IN ({actions}) AS INTEGER)"


@register(
    "gate_rounds",
    with_views(
        f"""WITH RECURSIVE fold AS (
          SELECT r.query_id, s.*, {_SCORE} AS last_score, '' AS actions, '0:initial_generation:' || {_SCORE} || ':' || r.overall_verdict AS history, {_decision('s', _SCORE)} FROM gate_rounds_input r, ({_ZERO}) s WHERE r.round = 0
          UNION ALL
          SELECT r.query_id, s.total_rounds_used, s.pipeline_reruns_used, s.answer_regenerations_used, s.repairs_used, s.actions_taken, {_SCORE}, s.actions, s.history || '|' || s.total_rounds_used || ':' || s.action || ':' || {_SCORE} || ':' || r.overall_verdict, {_decision('s', _SCORE)}
          FROM (SELECT f.query_id, f.action, f.history, f.total_rounds_used + 1 AS total_rounds_used, f.actions_taken + 1 AS actions_taken, f.pipeline_reruns_used + {_more("'full_pipeline_rerun_once'")} AS pipeline_reruns_used,
            f.answer_regenerations_used + {_more("'answer_regeneration_only'")} AS answer_regenerations_used, f.repairs_used + {_more("'targeted_answer_repair', 'citation_strict_repair'")} AS repairs_used,
            CASE f.actions WHEN '' THEN f.action ELSE f.actions || '|' || f.action END AS actions FROM fold f WHERE f.action NOT IN ('stop_accept', 'stop_best_effort')) s
          JOIN gate_rounds_input r ON r.query_id = s.query_id AND r.round = s.total_rounds_used),
        e AS (SELECT *, action NOT IN ('stop_accept', 'stop_best_effort') AS open FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total_rounds_used DESC) = 1)
        SELECT query_id, total_rounds_used + CAST(open AS INTEGER) AS total_rounds_used, pipeline_reruns_used + CAST(action = 'full_pipeline_rerun_once' AS INTEGER) AS pipeline_reruns_used, answer_regenerations_used + CAST(action = 'answer_regeneration_only' AS INTEGER) AS answer_regenerations_used,
          repairs_used + CAST(action IN ('targeted_answer_repair', 'citation_strict_repair') AS INTEGER) AS repairs_used, last_score, action, reason, NOT open AS stopped, CASE WHEN NOT open THEN actions WHEN actions = '' THEN action ELSE actions || '|' || action END AS actions, history FROM e""",
        "gate_rounds_input",
    ),
)
def gate_rounds(spark, sf_dir):
    rows = gating.gate_rounds(spark_view(spark, sf_dir, "gate_rounds_input"), "query_id")
    line = lambda h: F.concat_ws(":", h["round"].cast("string"), h["action"], h["score"].cast("string"), h["verdict"])
    return rows.withColumns({"actions": F.array_join("actions", "|"), "history": F.array_join(F.transform("history", line), "|")})
