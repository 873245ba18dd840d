"""Splitting a query into sub-queries, and checking a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.rules import flags
from lodestrata.functions.text import words

#: Cues of comparison, of several intents, of lists, and the metrics that a list may name.
COMPARES = r"(?i)\b(compare|versus|vs\.?|difference between)\b"
INTENTS = r"(?i)\b(compare|explain|summarize|list|identify|show|describe|tell me|who is|what is|how much)\b"
LIST = r"(?i)^(list|show|identify|summarize|describe)\s+(.+?)\.?$"
METRICS = r"(?i)\b(revenue growth|operating income|net income|gross margin|operating margin|revenue|azure growth|capital expenditures|cash flow)\b"
UNRESOLVED = r"\b(the company|company|they|them|their|it|its|those|these|same periods|relevant periods|the ceo|the cfo|the segment|the business segment)\b"
RESOLVED = r"\bthe (?:ceo|cfo|business segment|segment) of [a-z0-9& ,.'-]+\b"
SPLIT_CUE = r"(?i)\b(and|also|plus|along with|as well as)\b"
GENERIC = r"(?i)\b(what is the|what are the|which segment has|what did they say)\b"
SPLITS = [r"(?i)\s+(?:and|as well as)\s+", r"(?i)\s*,\s*(?:and\s+)?"]


def bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ .?]+|[ .?]+$", "")


def _clauses(parts: Column) -> Column:
    """Bare parts of three words or more."""
    return F.filter(F.transform(parts, bare), lambda x: F.size(words(x)) >= 3)


def _once(items: Column) -> Column:
    """Each item once whatever its case, at its first place."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)


def _question(x: Column) -> Column:
    return F.when(x.endswith("?"), x).otherwise(F.concat(F.regexp_replace(x, r"\.+$", ""), F.lit("?")))


def decompose(rows: DataFrame, query: str) -> DataFrame:
    """Adds clean, sub_queries and reasoning_type. Questions are parted first, then lists of metrics, then conjunctions; a comparison stays whole.
    Each kind of split is a column of its own, so that it is made once."""
    rows = rows.withColumn("clean", F.trim(F.regexp_replace(F.translate(query, "​﻿", "  "), r"\s+", " ")))
    q = F.col("clean")
    body = F.regexp_extract(q, LIST, 2)
    prefix = F.regexp_replace(F.regexp_extract(body, r"^(.*?)" + METRICS.removeprefix("(?i)"), 1), r"^[ ,]+|[ ,]+$", "")
    rows = rows.withColumns({
        "questions": _clauses(F.split(F.replace(q, F.lit("?"), F.lit("? ")), r"\?\s+")),
        "metrics": F.transform(F.regexp_extract_all(body, F.lit(METRICS), F.lit(0)), lambda m: F.trim(F.concat(F.regexp_extract(q, LIST, 1), F.lit(" "), prefix, F.lit(" "), m))),
        "first_split": F.when(q.rlike(COMPARES), F.array(bare(q))).otherwise(_clauses(F.split(q, SPLITS[0]))),
    })
    rows = rows.withColumn("first_split", F.when(F.size("first_split") > 1, F.col("first_split")).otherwise(F.array(bare(q))))
    again = F.flatten(F.transform("first_split", lambda c: F.when(F.size(_clauses(F.split(c, SPLITS[1]))) > 1, _clauses(F.split(c, SPLITS[1]))).otherwise(F.array(c))))
    rows = rows.withColumn("second_split", F.when(q.rlike(COMPARES), F.col("first_split")).otherwise(again))
    rows = rows.withColumns({"metrics": F.filter(_once(F.col("metrics")), lambda x: F.size(words(x)) >= 3), "parts": F.transform(F.filter(_once(F.col("second_split")), lambda x: F.size(words(x)) >= 3), _question)})
    kind = F.when(q == "", "empty").when(F.size("questions") > 1, "multi_question").when(F.size("metrics") > 1, "list_intent").when((F.size("parts") > 1) & q.rlike(INTENTS), "multi_intent").otherwise("single_intent")
    rows = rows.withColumn("reasoning_type", kind)
    subs = F.when(kind == "empty", F.array().cast("array<string>")).when(kind == "multi_question", F.col("questions")).when(kind == "list_intent", F.transform("metrics", _question)).when(kind == "multi_intent", F.col("parts")).otherwise(F.array(_question(q)))
    return rows.withColumn("sub_queries", subs).drop("questions", "metrics", "first_split", "second_split", "parts")


def repair_reasons(query: Column, sub_queries: Column, split: Column) -> Column:
    """Why a split should be repaired, sorted."""
    low = F.lower(query)
    compares = low.contains("compare") | low.contains("versus") | low.contains(" vs ")
    some = lambda p: F.exists(sub_queries, lambda x: x.rlike(p))
    rules = [
        (F.size(sub_queries) == 0, "empty_sub_queries"),
        (F.size(F.array_distinct(F.transform(sub_queries, lambda x: F.trim(F.lower(x))))) < F.size(sub_queries), "duplicate_sub_queries"),
        (~split & query.rlike(SPLIT_CUE) & ~compares, "possible_under_split"),
        (F.exists(sub_queries, lambda x: F.lower(x).rlike(UNRESOLVED) & ~F.lower(x).rlike(RESOLVED)), "unresolved_reference"),
        (some(GENERIC) & ~compares, "generic_retrieval_form"),
        (some(SPLIT_CUE) & ~compares, "multi_intent_subquery"),
    ]
    return F.array_sort(flags(rules))


#: What a sub-query asks for, by the first pattern that it has.
SIGNATURES = [
    (r"((who is|identify|tell me).*(ceo).*(microsoft|microsoft's))|((who is|identify|tell me).*(microsoft|microsoft's).*(ceo))|((who is|identify|tell me).*(ceo))", "microsoft_ceo"),
    (r"(revenue growth).*(fy2025)|fy2025.*revenue growth", "microsoft_fy2025_revenue_growth"),
    (r"(revenue).*(fy2025)|fy2025.*revenue", "microsoft_fy2025_revenue"),
    (r"(operating income).*(fy2025)|fy2025.*operating income", "microsoft_fy2025_operating_income"),
    (r"(net income).*(fy2025)|fy2025.*net income", "microsoft_fy2025_net_income"),
    (r"(cash flow).*(fy2025)|fy2025.*cash flow", "microsoft_fy2025_cash_flow"),
    (r"cybersecurity risks", "microsoft_fy2025_cybersecurity_risks"),
    (r"azure growth", "azure_growth"),
    (r"ai demand", "ai_demand"),
    (r"compare.*azure.*microsoft 365.*revenue drivers|compare.*revenue drivers.*azure.*microsoft 365", "compare_azure_m365_revenue_drivers"),
]
#: Terms that mean the same.
SAME_TERMS = [("fiscal year 2025", "fy2025"), ("fiscal 2025", "fy2025"), ("microsoft azure", "azure")]


def plain_query(x: Column) -> Column:
    """A sub-query as it is compared with another."""
    x = F.regexp_replace(F.regexp_replace(F.lower(x), r"^\s+|\s+$", ""), r"[?.!,;:]+$", "")
    for term, meant in SAME_TERMS:
        x = F.replace(x, F.lit(term), F.lit(meant))
    return F.regexp_replace(x, r"\s+", " ")


def signature(x: Column) -> Column:
    """What a sub-query asks for; its plain form where no pattern says."""
    plain = plain_query(x)
    out = plain
    for pattern, name in reversed(SIGNATURES):
        out = F.when(plain.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def decomposition_eval(rows: DataFrame, actual: str, expected: str, needs: str, gold_needs: str) -> DataFrame:
    """Adds missing and extra sub-queries in plain form, semantic_missing and semantic_extra by signature, passed (by signature) and exact_passed."""
    from lodestrata.operators.evaluation import list_checks

    plain = {"_a": F.transform(actual, plain_query), "_e": F.transform(expected, plain_query)}
    rows = rows.withColumns(plain).withColumns({"_sa": F.transform(actual, signature), "_se": F.transform(expected, signature)})
    rows = list_checks(list_checks(rows, "_a", "_e", ""), "_sa", "_se", "_s").withColumnsRenamed({"missing_s": "semantic_missing", "extra_s": "semantic_extra"})
    same = F.col(needs).eqNullSafe(F.col(gold_needs))
    none = lambda *cs: (F.size(cs[0]) == 0) & (F.size(cs[1]) == 0)
    return rows.withColumns({"passed": same & none("semantic_missing", "semantic_extra"), "exact_passed": same & none("missing", "extra")}).drop("_a", "_e", "_sa", "_se")
