"""Imports every module that registers queries."""

from lodestrata.plans import q_decompose, q_evaluation, q_fusion, q_gate, q_gold, q_graph, q_more, q_retrieval, q_rules, q_streaming, q_text  # noqa: F401
