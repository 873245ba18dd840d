"""Queries: query-log features, guardrails, planning rules, conversations.

The texts are in several languages; Java's word boundary knows their letters and RE2's does not, so both sides
read a text with its other letters mapped to ``x``: ``ascii`` below, part of these queries' definition.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import rules as R
from lodestrata.functions.text import sanitize_query
from lodestrata.plans.q_text import _SANITIZED
from lodestrata.plans.registry import register
from lodestrata.plans.views import load, spark_view, with_views

_LOG = "l AS (SELECT query_id, regexp_replace(query_text, '[^\\x00-\\x7F]', 'x', 'g') AS t FROM query_log)"


def _log(spark, sf_dir):
    return spark_view(spark, sf_dir, "query_log").select("query_id", F.regexp_replace("query_text", r"[^\x00-\x7F]", "x").alias("t"))


def _has(p: str, x: str = "t") -> str:
    return f"regexp_matches({x}, '{p}')"


def _list(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{label}' END" for r, label in rules) + "], lambda x: x IS NOT NULL)"


_ATTACK = _list([(_has(f"(?is){p}", "s"), c) for c, p in R.ATTACKS])


@register("attack_flags", with_views(f"WITH {_LOG}, s AS (SELECT query_id, {_SANITIZED.replace('text', 't')} AS s FROM l), a AS (SELECT query_id, {_ATTACK} AS a FROM s) SELECT query_id, array_to_string(list_sort(list_distinct(a)), '|') AS attack_types, len(a) > 0 AS blocked, coalesce(a[1], '') AS reason, CASE WHEN len(a) > 0 THEN 'high' ELSE 'low' END AS risk_level FROM a", "query_log"))
def attack_flags(spark, sf_dir):
    a = _log(spark, sf_dir).select("query_id", R.attack_types(sanitize_query(F.col("t"))).alias("a"))
    blocked = F.size("a") > 0
    return a.select("query_id", F.array_join(F.array_sort(F.array_distinct("a")), "|").alias("attack_types"), blocked.alias("blocked"), F.coalesce(F.get("a", F.lit(0)), F.lit("")).alias("reason"), F.when(blocked, "high").otherwise("low").alias("risk_level"))


@register("pii_redact")
def pii_redact(spark, sf_dir):
    """The phone rule looks behind, which the SQL engine's patterns cannot; tests compare it with Python."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(R.redact(sanitize_query(F.col("text")))).alias("redacted_md5"))


@register("history_redact")
def history_redact(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", R.redact(sanitize_query(F.col("text"))).alias("text"))


_DIGITS = r"regexp_replace(c, '[^0-9]', '', 'g')"


@register(
    "luhn_check",
    rf"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '[0-9][0-9 -]{{11,22}}[0-9]'))) AS c FROM documents),
    d AS (SELECT doc_id, c, {_DIGITS} AS d FROM c)
    SELECT doc_id, c AS candidate, length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT) ELSE CAST(substr(d, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS is_card FROM d""",
)
def luhn_check(spark, sf_dir):
    c = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), F.lit(r"[0-9][0-9 -]{11,22}[0-9]"), F.lit(0)))).alias("candidate"))
    return c.select("doc_id", "candidate", R.luhn(F.col("candidate")).alias("is_card"))


_PARTS = "len(list_filter(regexp_split_to_array(t, '[?,]'), lambda x: trim(translate(x, '.?', '  ')) <> ''))"
_CLAUSES = r"len(list_filter(regexp_split_to_array(t, '(?i)\band\b|\balso\b|\bplus\b|\bas well as\b'), lambda x: trim(translate(x, '.?', '  ')) <> ''))"
_COUNT = f"CASE WHEN {_has(R.COMPARISON)} THEN 1 WHEN {_PARTS} > 1 THEN least({_PARTS}, 3) WHEN {_has(R.MULTI_INTENT)} THEN least(greatest({_CLAUSES}, 1), 3) ELSE 1 END"
_FEATURES = f"""{_LOG}, f AS (SELECT query_id, t, {_has(R.COMPARISON)} AS is_comparison, {_has(R.EXPLANATION)} AS is_explanatory, {_has(R.AMBIGUOUS)} AS has_ambiguous_refs, {_has(R.SHORT)} AS is_short, {_has(R.SPARSE)} AND {_has(R.SHORT)} AS is_sparse, CAST({_COUNT} AS INT) AS estimated_sub_queries FROM l),
    g AS (SELECT *, {_list([('has_ambiguous_refs', 'ambiguous_reference'), ('estimated_sub_queries > 1 AND is_short', 'short_but_multi_intent'), ('is_explanatory AND estimated_sub_queries > 1', 'mixed_explanatory_multi_intent'), (f'estimated_sub_queries <= 1 AND {_has(R.MULTI_INTENT)} AND NOT is_comparison', 'possible_hidden_multi_intent')])} AS a FROM f)"""


@register("query_features", with_views(f"WITH {_FEATURES} SELECT query_id, is_comparison, is_explanatory, has_ambiguous_refs, is_short, is_sparse, estimated_sub_queries, array_to_string(a, '|') AS ambiguity_signals FROM g", "query_log"))
def query_features(spark, sf_dir):
    f = R.query_features(F.col("t"))
    return _log(spark, sf_dir).select("query_id", *[(F.array_join(c, "|") if n == "ambiguity_signals" else c).alias(n) for n, c in f.items()])


_GATE = [("estimated_sub_queries > 1", "compound_or_multi_intent"), ("is_short OR is_sparse OR is_comparison", "needs_retrieval_variation"), ("is_explanatory OR is_comparison", "needs_broader_context"), ("is_sparse OR (is_short AND NOT is_comparison)", "sparse_query_support")]


@register("transform_gate", with_views(f"WITH {_FEATURES} SELECT query_id, {_GATE[0][0]} AS run_decomposition, {_GATE[1][0]} AS run_multi_query, {_GATE[2][0]} AS run_step_back, {_GATE[3][0]} AS run_hyde, array_to_string(list_sort({_list(_GATE)}), '|') AS reasons FROM g", "query_log"))
def transform_gate(spark, sf_dir):
    g = R.transform_gate(R.query_features(F.col("t")))
    return _log(spark, sf_dir).select("query_id", *[(F.array_join(c, "|") if n == "reasons" else c).alias(n) for n, c in g.items()])


@register(
    "gate_override",
    with_views(f"WITH {_FEATURES} SELECT query_id, CASE WHEN len(a) > 0 THEN least(greatest(length(t) % 5, 1), 3) ELSE estimated_sub_queries END AS sub_queries, len(a) > 0 AS overridden FROM g", "query_log"),
)
def gate_override(spark, sf_dir):
    """A model's count (here the text's length modulo 5) replaces the rule's for ambiguous queries, held between 1 and 3."""
    f = R.query_features(F.col("t"))
    unsure = F.size(f["ambiguity_signals"]) > 0
    model = F.least(F.greatest(F.length("t") % 5, F.lit(1)), F.lit(3))
    return _log(spark, sf_dir).select("query_id", F.when(unsure, model).otherwise(f["estimated_sub_queries"]).cast("long").alias("sub_queries"), unsure.alias("overridden"))


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@register("hyde_recommend", with_views(f"WITH {_LOG} SELECT query_id, ({_WORDS.format('t')} <= 5 AND {_has(R.SPARSE)}) OR ({_WORDS.format('t')} <= 7 AND {_has(R.AMBIGUOUS)}) AS recommend FROM l", "query_log"))
def hyde_recommend(spark, sf_dir):
    n = F.size(R.words(F.col("t")))
    return _log(spark, sf_dir).select("query_id", (((n <= 5) & F.col("t").rlike(R.SPARSE)) | ((n <= 7) & F.col("t").rlike(R.AMBIGUOUS))).alias("recommend"))


@register("reference_detect", with_views(f"WITH {_LOG} SELECT query_id, {_has(R.REFERENCE)} AS has_reference FROM l", "query_log"))
def reference_detect(spark, sf_dir):
    return _log(spark, sf_dir).select("query_id", F.col("t").rlike(R.REFERENCE).alias("has_reference"))


_HITS = {k: " + ".join(f"CASE WHEN {_has(p, 'n')} THEN 1 ELSE 0 END" for p in ps) for k, ps in R.ROUTING.items()}
_CLAUSE_N = r"len(list_filter(regexp_split_to_array({0}, '\b(?:and|or)\b|[?;,]'), lambda x: trim(x) <> ''))"
_ROUTE = f"""{_LOG}, n AS (SELECT query_id, t, lower(trim(t)) AS n FROM l), h AS (SELECT *, {', '.join(f'{v} AS {k}_signal_count' for k, v in _HITS.items())}, {_WORDS.format('n')} AS word_count, {_CLAUSE_N.format('n')} AS clause_count FROM n),
    r AS (SELECT *, {_has(r'\b(segment|reporting segment)\b', 'n')} AND relationship_signal_count > 0 AS membership, CAST(numeric_signal_count > 0 AS INT) + CAST(relationship_signal_count > 0 AS INT) + CAST(narrative_signal_count > 0 AS INT) >= 2 AS looks_multi_source FROM h)"""
_ROUTE_COLUMNS = ", ".join(f"{k}_signal_count" for k in R.ROUTING) + ", word_count, clause_count, membership, looks_multi_source"


@register("routing_signals", with_views(f"WITH {_ROUTE} SELECT query_id, {_ROUTE_COLUMNS} FROM r", "query_log"))
def routing_signals(spark, sf_dir):
    return R.with_routing_signals(_log(spark, sf_dir), "t").drop("t")


_PICKED = "CASE length(t) % 4 WHEN 0 THEN ['sql_structured'] WHEN 1 THEN ['graph_relationships'] WHEN 2 THEN ['sql_structured', 'graph_relationships'] ELSE [] END"
_RULED = f"""{_ROUTE}, p AS (SELECT *, {_PICKED} AS p0, executive_role_signal_count > 0 AS role FROM r),
    p1 AS (SELECT *, CASE WHEN role THEN list_concat(['vector_document'], list_filter(p0, lambda x: x <> 'graph_relationships')) ELSE p0 END AS s1 FROM p),
    p2 AS (SELECT *, CASE WHEN NOT list_contains(s1, 'vector_document') AND (list_contains(s1, 'graph_relationships') OR narrative_signal_count > 0 OR membership OR (looks_multi_source AND coalesce(p0[1], '') = 'sql_structured')) THEN list_append(s1, 'vector_document') ELSE s1 END AS s2 FROM p1),
    p3 AS (SELECT *, CASE WHEN len(s2) = 0 THEN ['vector_document'] ELSE s2 END AS s3 FROM p2),
    ruled AS (SELECT query_id, t, s3 AS sources, CASE WHEN role THEN 'vector_document' ELSE s3[1] END AS primary_source FROM p3)"""


def _ruled(spark, sf_dir):
    """A router's choice (here by the text's length modulo 4) under the routing rules."""
    sql, graph, vector = F.lit("sql_structured"), F.lit("graph_relationships"), F.lit("vector_document")
    k = F.length("t") % 4
    picked = F.when(k == 0, F.array(sql)).when(k == 1, F.array(graph)).when(k == 2, F.array(sql, graph)).otherwise(F.array().cast("array<string>"))
    rows = R.with_routing_signals(_log(spark, sf_dir), "t").withColumn("p0", picked).withColumn("role", F.col("executive_role_signal_count") > 0)
    rows = rows.withColumn("s1", F.when(F.col("role"), F.concat(F.array(vector), F.array_remove("p0", graph))).otherwise(F.col("p0")))
    more = F.array_contains("s1", graph) | (F.col("narrative_signal_count") > 0) | F.col("membership") | (F.col("looks_multi_source") & (F.coalesce(F.get("p0", F.lit(0)), F.lit("")) == "sql_structured"))
    rows = rows.withColumn("s2", F.when(~F.array_contains("s1", vector) & more, F.array_append("s1", vector)).otherwise(F.col("s1")))
    rows = rows.withColumn("sources", F.when(F.size("s2") == 0, F.array(vector)).otherwise(F.col("s2")))
    return rows.withColumn("primary_source", F.when(F.col("role"), vector).otherwise(F.get("sources", F.lit(0)))).select("query_id", "t", "sources", "primary_source")


@register("route_rules", with_views(f"WITH {_RULED} SELECT query_id, primary_source, array_to_string(list_slice(sources, 1, 3), '|') AS sources FROM ruled", "query_log"))
def route_rules(spark, sf_dir):
    return _ruled(spark, sf_dir).select("query_id", "primary_source", F.array_join(F.slice("sources", 1, 3), "|").alias("sources"))


@register("source_usage", with_views(f"WITH {_RULED}, u AS (SELECT unnest(sources) AS source FROM ruled) SELECT s AS source, count(u.source) AS n FROM (SELECT unnest(['graph_relationships', 'sql_structured', 'vector_document', 'web_search']) AS s) LEFT JOIN u ON u.source = s GROUP BY s", "query_log"))
def source_usage(spark, sf_dir):
    from lodestrata.operators.merging import zero_filled

    counts = _ruled(spark, sf_dir).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return zero_filled(counts, "source", ["graph_relationships", "sql_structured", "vector_document", "web_search"], "n")


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(n, '{x}')" for x in terms) + ")"


_POLICY = f"""{_LOG}, n AS (SELECT query_id, t, lower(trim(t)) AS n FROM l), p AS (SELECT query_id, t, {_WORDS.format('n')} AS word_count, {_has(R.REFERENCE)} AS has_reference, {_any(R.EXPLAIN_TERMS)} AS asks_for_explanation, {_any(R.QUOTE_TERMS)} AS asks_for_quote, {_any(R.ROLE_TERMS)} AS asks_for_role,
    contains(n, 'segment') AND {_any(R.MEMBER_TERMS)} AS asks_membership, {_CLAUSE_N.format('n')} > 1 AS is_multi_clause FROM n)"""


@register("policy_signals", with_views(f"WITH {_POLICY} SELECT query_id, word_count, has_reference, asks_for_explanation, asks_for_quote, asks_for_role, asks_membership, is_multi_clause FROM p", "query_log"))
def policy_signals(spark, sf_dir):
    return _log(spark, sf_dir).select("query_id", *[c.alias(n) for n, c in R.policy_signals(F.col("t")).items()])


_PROFILE = "CASE WHEN NOT has_vector THEN 'skip' WHEN asks_for_role THEN 'balanced' WHEN asks_for_explanation OR asks_for_quote OR asks_membership OR is_multi_clause THEN 'balanced' ELSE 'fast' END"
_POLICED = f"{_POLICY}, w AS (SELECT *, length(t) % 3 <> 0 AS has_vector FROM p), pol AS (SELECT query_id, {_PROFILE} AS vector_profile, has_vector AND NOT has_reference AS parallel_safe FROM w)"


def _policed(spark, sf_dir):
    """The vector profile of a query whose router proposed none; two of three use the vector source, beside the graph."""
    s = R.policy_signals(F.col("t"))
    vector = F.length("t") % 3 != 0
    wide = s["asks_for_role"] | s["asks_for_explanation"] | s["asks_for_quote"] | s["asks_membership"] | s["is_multi_clause"]
    return _log(spark, sf_dir).select("query_id", F.when(~vector, "skip").when(wide, "balanced").otherwise("fast").alias("vector_profile"), (vector & ~s["has_reference"]).alias("parallel_safe"))


@register("policy_rules", with_views(f"WITH {_POLICED} SELECT * FROM pol", "query_log"))
def policy_rules(spark, sf_dir):
    return _policed(spark, sf_dir)


@register("policy_summary", with_views(f"WITH {_POLICED} SELECT s AS vector_profile, count(query_id) AS n, count(*) FILTER (parallel_safe) AS parallel_safe FROM (SELECT unnest(['skip', 'fast', 'balanced', 'full']) AS s) LEFT JOIN pol ON vector_profile = s GROUP BY s", "query_log"))
def policy_summary(spark, sf_dir):
    """A row of each kind, none of which counts, stands beside the queries, so kinds without queries are there."""
    kinds = ["skip", "fast", "balanced", "full"]
    rows = _policed(spark, sf_dir).filter(F.col("vector_profile").isin(kinds)).select("vector_profile", F.lit(1).alias("one"), "parallel_safe")
    none = spark.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("vector_profile"), F.lit(0).alias("one"), F.lit(False).alias("parallel_safe"))
    return rows.unionByName(none).groupBy("vector_profile").agg(F.sum("one").alias("n"), F.count_if("parallel_safe").alias("parallel_safe"))


@register(
    "sub_query_cap",
    with_views(r"""WITH p AS (SELECT query_id, i, trim(x) AS x FROM (SELECT query_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM (SELECT query_id, regexp_split_to_array(query_text, '[.\n]') AS s FROM queries)) WHERE trim(x) <> ''),
    d AS (SELECT query_id, min(i) AS i, arg_min(x, i) AS x FROM p GROUP BY query_id, lower(x)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n, count(*) OVER (PARTITION BY query_id) AS total FROM d)
    SELECT query_id, n, x AS sub_query, total > 3 AS truncated FROM r WHERE n <= 3""", "queries"),
)
def sub_query_cap(spark, sf_dir):
    """Sub-queries, each once whatever its case; the first three are the feature."""
    p = spark_view(spark, sf_dir, "queries").select("query_id", F.posexplode(F.split("query_text", r"[.\n]")).alias("i", "x")).withColumn("x", F.trim("x")).filter("x <> ''")
    d = p.groupBy("query_id", F.lower("x").alias("k")).agg(F.min("i").alias("i"), F.min_by("x", "i").alias("x"))
    w = W.partitionBy("query_id")
    r = d.select("query_id", "x", F.row_number().over(w.orderBy("i")).alias("n"), F.count("*").over(w).alias("total"))
    return r.filter("n <= 3").select("query_id", "n", F.col("x").alias("sub_query"), (F.col("total") > 3).alias("truncated"))


_META = [("previous_question", r"(?i)\b(previous|last) question\b|what did i (just )?ask"), ("previous_answer", r"(?i)\b(previous|last) answer\b|what did you (just )?say"), ("conversation_summary", r"(?i)\b(summari[sz]e|recap)\b.{0,30}\b(conversation|chat|discussion)\b")]


@register("meta_intent", with_views(f"WITH {_LOG} SELECT query_id, CASE {' '.join(f'WHEN {_has(p)} THEN {chr(39)}{n}{chr(39)}' for n, p in _META)} ELSE 'none' END AS intent FROM l", "query_log"))
def meta_intent(spark, sf_dir):
    out = F.when(F.lit(False), F.lit(""))
    for n, p in _META:
        out = out.when(F.col("t").rlike(p), n)
    return _log(spark, sf_dir).select("query_id", out.otherwise("none").alias("intent"))


@register("meta_answer", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b AS previous_user, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER b AS previous_assistant, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS recap_roles FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def meta_answer(spark, sf_dir):
    """The last turn of each role before a turn, and the roles of the last five."""
    w = W.partitionBy("conv_id").orderBy("turn")
    said = lambda r: F.last(F.when(F.col("role") == r, F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", said("user").alias("previous_user"), said("assistant").alias("previous_assistant"), F.concat_ws(",", F.collect_list("role").over(w.rowsBetween(-5, -1))).alias("recap_roles"))


@register("recent_turns", "SELECT conv_id, turn, role, trim(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def recent_turns(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return load(spark, sf_dir, "conversations").withColumn("n", n).filter("n <= 10").select("conv_id", "turn", "role", F.trim("text").alias("text"))


_PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id, turn AS user_turn, role, text AS user_query, lead(turn) OVER w AS turn_id, lead(role) OVER w AS next_role, left(lead(text) OVER w, 500) AS answer_summary FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


@register("turn_pairs", f"WITH {_PAIRS} SELECT conv_id, turn_id, user_query, answer_summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS n FROM pairs) WHERE n <= 10")
def turn_pairs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = lambda c: F.lead(c).over(w)
    rows = load(spark, sf_dir, "conversations").select("conv_id", "role", F.col("text").alias("user_query"), nxt("turn").alias("turn_id"), nxt("role").alias("next_role"), F.substring(nxt("text"), 1, 500).alias("answer_summary"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn_id").desc()))
    return rows.filter("role = 'user' AND next_role = 'assistant'").withColumn("n", n).filter("n <= 10").select("conv_id", "turn_id", "user_query", "answer_summary")


@register(
    "resolution_validate",
    "WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, list_filter([conv_id % 3, conv_id % 11, 2], lambda x: list_contains(turns, x)) AS ok FROM t) SELECT conv_id, array_to_string(ok, '|') AS referenced, len(ok) > 0 AS used_history FROM r",
)
def resolution_validate(spark, sf_dir):
    """Turn ids that a resolver names count only where the conversation has them. One row a reference, joined to the turns."""
    c = load(spark, sf_dir, "conversations")
    ids = c.select("conv_id").distinct()
    named = ids.select("conv_id", F.posexplode(F.array(F.col("conv_id") % 3, F.col("conv_id") % 11, F.lit(2).cast("long"))).alias("i", "turn"))
    ok = named.join(c.select("conv_id", "turn").distinct().hint("merge"), ["conv_id", "turn"]).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "turn"))), lambda x: x["turn"]).alias("ok"))
    got = ids.join(ok.hint("merge"), "conv_id", "left")
    return got.select("conv_id", F.coalesce(F.concat_ws("|", "ok"), F.lit("")).alias("referenced"), F.coalesce(F.size("ok") > 0, F.lit(False)).alias("used_history"))


@register("event_tail", "SELECT user_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n > 3")
def event_tail(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").withColumn("n", n).filter("n > 3").select("user_id", "event_id", "n")


@register("session_quota", "SELECT user_id, event_id, CAST(used AS BIGINT) AS used, used <= 25 AND event_type <> 'error' AS allowed FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)")
def session_quota(spark, sf_dir):
    """25 questions a session; blocked ones use up nothing."""
    used = F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return load(spark, sf_dir, "events").withColumn("used", used).select("user_id", "event_id", "used", ((F.col("used") <= 25) & (F.col("event_type") != "error")).alias("allowed"))


@register("job_status", "SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS status, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def job_status(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("errors"))
