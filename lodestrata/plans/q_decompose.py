"""Queries: decomposition of the query log and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import decompose as D
from lodestrata.plans import q_rules
from lodestrata.plans.registry import register
from lodestrata.plans.views import with_views


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^[ .?]+|[ .?]+$', '', 'g')"


def _clauses(parts: str) -> str:
    return rf"list_filter(list_transform({parts}, lambda x: {_bare('x')}), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 3)"


def _question(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '?') THEN {x} ELSE regexp_replace({x}, '\\.+$', '') || '?' END"


_HAS = "regexp_matches({0}, '{1}')"
_SPLIT = f"""{q_rules._LOG}, c AS (SELECT query_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS q FROM l),
    s1 AS (SELECT query_id, q, {_HAS.format('q', D.COMPARES)} AS compares, {_clauses(chr(39).join(["regexp_split_to_array(replace(q, '?', '? '), ", r"\?\s+", ")"]))} AS questions, {_clauses(f"regexp_split_to_array(q, '{D.SPLITS[0]}')")} AS a1 FROM c),
    s2 AS (SELECT *, CASE WHEN NOT compares AND len(a1) > 1 THEN a1 ELSE [{_bare('q')}] END AS a2 FROM s1),
    s3 AS (SELECT *, CASE WHEN compares THEN a2 ELSE flatten(list_transform(a2, lambda z: CASE WHEN len({_clauses(f"regexp_split_to_array(z, '{D.SPLITS[1]}')")}) > 1 THEN {_clauses(f"regexp_split_to_array(z, '{D.SPLITS[1]}')")} ELSE [z] END)) END AS a3 FROM s2),
    s4 AS (SELECT *, list_transform(a3, lambda x: lower(x)) AS lows FROM s3),
    s5 AS (SELECT *, list_transform(list_filter(a3, lambda x, i: list_position(lows, lower(x)) = i AND len(list_filter(string_split(x, ' '), lambda y: y <> '')) >= 3), lambda x: {_question('x')}) AS parts FROM s4),
    s6 AS (SELECT query_id, q, CASE WHEN q = '' THEN 'empty' WHEN len(questions) > 1 THEN 'multi_question' WHEN len(parts) > 1 AND {_HAS.format('q', D.INTENTS)} THEN 'multi_intent' ELSE 'single_intent' END AS reasoning_type, questions, parts FROM s5),
    dec AS (SELECT query_id, q, reasoning_type, CASE reasoning_type WHEN 'empty' THEN [] WHEN 'multi_question' THEN questions WHEN 'multi_intent' THEN parts ELSE [{_question('q')}] END AS sub_queries FROM s6)"""


def _decomposed(spark, sf_dir):
    """The log's texts name no metrics, so the SQL twin leaves lists of them out; a golden test has them."""
    return D.decompose(q_rules._log(spark, sf_dir), "t")


@register("query_decompose", with_views(f"WITH {_SPLIT} SELECT query_id, reasoning_type, len(sub_queries) AS n, array_to_string(sub_queries, '|') AS sub_queries FROM dec", "query_log"))
def query_decompose(spark, sf_dir):
    return _decomposed(spark, sf_dir).select("query_id", "reasoning_type", F.size("sub_queries").cast("long").alias("n"), F.array_join("sub_queries", "|").alias("sub_queries"))


def _some(p: str) -> str:
    return f"len(list_filter(sub_queries, lambda x: {_HAS.format('x', p)})) > 0"


_COMPARE = "(contains(lower(q), 'compare') OR contains(lower(q), 'versus') OR contains(lower(q), ' vs '))"
_WHY = q_rules._list([
    ("len(sub_queries) = 0", "empty_sub_queries"),
    ("len(list_distinct(list_transform(sub_queries, lambda x: trim(lower(x))))) < len(sub_queries)", "duplicate_sub_queries"),
    (f"reasoning_type IN ('single_intent', 'empty') AND {_HAS.format('q', D.SPLIT_CUE)} AND NOT {_COMPARE}", "possible_under_split"),
    (f"len(list_filter(sub_queries, lambda x: {_HAS.format('lower(x)', D.UNRESOLVED)} AND NOT {_HAS.format('lower(x)', D.RESOLVED.replace(chr(39), chr(39) * 2))})) > 0", "unresolved_reference"),
    (f"{_some(D.GENERIC)} AND NOT {_COMPARE}", "generic_retrieval_form"),
    (f"{_some(D.SPLIT_CUE)} AND NOT {_COMPARE}", "multi_intent_subquery"),
])


@register("decomposition_check", with_views(f"WITH {_SPLIT}, w AS (SELECT query_id, {_WHY} AS why FROM dec) SELECT query_id, len(why) > 0 AS should_repair, array_to_string(list_sort(why), '|') AS reasons FROM w", "query_log"))
def decomposition_check(spark, sf_dir):
    rows = _decomposed(spark, sf_dir)
    why = D.repair_reasons(F.col("clean"), F.col("sub_queries"), ~F.col("reasoning_type").isin("single_intent", "empty"))
    return rows.select("query_id", why.alias("why")).select("query_id", (F.size("why") > 0).alias("should_repair"), F.array_join("why", "|").alias("reasons"))
