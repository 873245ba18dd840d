"""Queries: answer checks and evaluation against gold tables.

Gold tables come from the given ones: terms of a benchmark text are what its retrieval should find, the
conversations' roles and turns are expectations and outcomes of the planning steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import evaluation as E
from lodestrata.plans import q_fusion, q_graph, q_retrieval, q_rules
from lodestrata.plans.registry import register
from lodestrata.plans.views import load, spark_view, with_views


@register("ordered_distinct", "WITH w AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations)), d AS (SELECT conv_id, turn, x, min(i) AS i FROM w GROUP BY ALL) SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS words FROM d GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


_PROFILED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, column_name, n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n)" for t in ("supplier", "part", "nation"))


@register("schema_package", f"SELECT c.table_name, c.column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type, column_index AS position, row_count, row_count - n AS null_count FROM duckdb_columns() c JOIN ({_PROFILED}) p ON c.table_name = p.table_name AND c.column_name = p.column_name")
def schema_package(spark, sf_dir):
    """Columns with their types, and how many rows and nulls they have."""
    from lodestrata.sources.tables import schema_profile

    return schema_profile({n: load(spark, sf_dir, n) for n in ("supplier", "part", "nation")})


@register("rewrite_dedupe", with_views(r"WITH p AS (SELECT query_id, i, trim(x) AS x FROM (SELECT query_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM (SELECT query_id, string_split(query_text, chr(10)) AS s FROM queries)) WHERE trim(x) <> ''), d AS (SELECT query_id, min(i) AS i, arg_min(x, i) AS x FROM p GROUP BY query_id, lower(x)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM d) SELECT query_id, n, x AS rewrite FROM r WHERE n <= 3", "queries"))
def rewrite_dedupe(spark, sf_dir):
    lines = spark_view(spark, sf_dir, "queries").select("query_id", F.posexplode(F.split("query_text", "\n")).alias("i", "x"))
    return E.first_distinct(lines, ["query_id"], "x", "i", 3).withColumnRenamed("x", "rewrite")


_IDS = q_fusion._IDS


@register("answer_sanitize", with_views(f"SELECT query_id, turn, array_to_string(list_filter({_IDS}, lambda x: NOT ends_with(x, 'e3')), '|') AS used_fact_ids FROM answers", "answers"))
def answer_sanitize(spark, sf_dir):
    """Of an answer's ids those that are allowed (here all but edge e3), each once, in order."""
    ids = F.array_distinct(F.filter(q_fusion._ids(), lambda x: ~x.endswith("e3")))
    return spark_view(spark, sf_dir, "answers").select("query_id", "turn", F.array_join(ids, "|").alias("used_fact_ids"))


_CHECKS = f"c AS (SELECT query_id, turn, {_IDS} AS inline, list_concat(list_filter({_IDS}, lambda x: starts_with(x, 'sql')), ['vector::' || CAST(turn AS VARCHAR)]) AS used FROM answers), k AS (SELECT query_id, turn, len(list_filter(used, lambda x: NOT list_contains(inline, x))) AS missing_inline, len(list_filter(inline, lambda x: NOT list_contains(used, x))) AS inline_not_declared, len(list_filter(used, lambda x: starts_with(x, 'vector::') AND turn % 2 = 1)) AS unknown_used FROM c)"


def _checks(spark, sf_dir):
    rows = spark_view(spark, sf_dir, "answers").withColumn("inline", F.array_distinct(q_fusion._ids()))
    rows = rows.withColumn("used", F.concat(F.filter("inline", lambda x: x.startswith("sql")), F.array(F.concat(F.lit("vector::"), F.col("turn").cast("string")))))
    known = F.when(F.col("turn") % 2 == 1, F.filter("used", lambda x: ~x.startswith("vector::"))).otherwise(F.col("used"))
    return E.reflection_checks(rows.withColumn("known", known))


@register("reflection_checks", with_views(f"WITH {_CHECKS} SELECT *, missing_inline > 0 OR inline_not_declared > 0 OR unknown_used > 0 AS needs_correction FROM k", "answers"))
def reflection_checks(spark, sf_dir):
    return _checks(spark, sf_dir).select("query_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("missing_inline", "inline_not_declared", "unknown_used")], "needs_correction")


@register("critique_override", with_views(f"WITH {_CHECKS} SELECT query_id, turn, array_to_string(list_filter([CASE WHEN missing_inline > 0 THEN 'missing_inline_citations' END, CASE WHEN inline_not_declared > 0 THEN 'citation_fact_mismatch' END, CASE WHEN unknown_used > 0 THEN 'unknown_fact' END], lambda x: x IS NOT NULL), '|') AS issues FROM k", "answers"))
def critique_override(spark, sf_dir):
    return _checks(spark, sf_dir).select("query_id", "turn", F.array_join(E.critique_issues(), "|").alias("issues"))


@register("judge_used_facts", with_views(f"WITH i AS (SELECT query_id, turn, unnest(range(1, len(f) + 1)) AS place, unnest(f) AS fact_id FROM (SELECT query_id, turn, {_IDS} AS f FROM answers)) SELECT query_id, turn, place, fact_id FROM i WHERE place <= 12 AND starts_with(fact_id, 'sql::')", "answers"))
def judge_used_facts(spark, sf_dir):
    """The first twelve used facts that the catalog (here the SQL facts) has, in order."""
    ids = spark_view(spark, sf_dir, "answers").select("query_id", "turn", F.posexplode(F.slice(q_fusion._ids(), 1, 12)).alias("p", "fact_id"))
    catalog = ids.select("fact_id").filter(F.col("fact_id").startswith("sql::")).distinct()
    return ids.join(catalog.hint("merge"), "fact_id").select("query_id", "turn", (F.col("p") + 1).alias("place"), "fact_id")


@register("payload_defaults", "SELECT event_id, coalesce(nullif(trim(event_type), ''), 'none') AS kind, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.verdict'), 'fail') AS verdict FROM events")
def payload_defaults(spark, sf_dir):
    got = F.from_json("props", "k string, verdict string")
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("none")).alias("kind"), F.coalesce(got["k"].try_cast("int"), F.lit(0)).alias("k"), F.coalesce(got["verdict"], F.lit("fail")).alias("verdict"))


@register(
    "prior_context",
    with_views(
        f"""WITH {q_fusion._RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY sub_query_id, source_type ORDER BY answer_rank) AS n FROM ranked),
        e AS (SELECT sub_query_id, source_type, CASE source_type WHEN 'sql_structured' THEN string_agg(CASE WHEN n <= 3 THEN fact_id END, ';' ORDER BY n) WHEN 'graph_relationships' THEN string_agg(CASE WHEN n <= 5 THEN fact_id END, ';' ORDER BY n)
          ELSE left(string_agg(summary, ';' ORDER BY n), 800) END AS s FROM n GROUP BY sub_query_id, source_type),
        o AS (SELECT sub_query_id, string_agg(source_type || '=' || s, ' / ' ORDER BY source_type) AS found FROM e GROUP BY sub_query_id)
        SELECT sub_query_id, coalesce(string_agg(found, '|') OVER (PARTITION BY sub_query_id // 5 ORDER BY sub_query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM o""",
        *q_fusion._FV,
    ),
)
def prior_context(spark, sf_dir):
    """Five sub-queries make a question."""
    from lodestrata.operators import fusion

    return E.prior_context(fusion.fact_rank(q_fusion._facts(spark, sf_dir)), F.floor(F.col("sub_query_id") / 5))


@register("graph_evidence", with_views(f"WITH {q_graph._SCORED} SELECT query_id, count(*) AS node_count, string_agg('[' || CAST(rk AS VARCHAR) || '] ' || canonical_name, chr(10) ORDER BY rk) AS blocks FROM top GROUP BY query_id", *q_graph._BOTH, "queries"))
def graph_evidence(spark, sf_dir):
    block = F.struct("rk", F.concat(F.lit("["), F.col("rk").cast("string"), F.lit("] "), "canonical_name").alias("b"))
    return q_graph.node_score_topk(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("node_count"), F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("blocks"))


@register("retrieval_eval", with_views(f"WITH {q_retrieval._BM25}, e AS (SELECT query_id, {q_retrieval._TERMS.format('query_text')} AS terms FROM queries), h AS (SELECT query_id, count(*) AS hits, count(*) - count(DISTINCT child_id) AS duplicates, lower(string_agg(child_text, ' ')) AS found FROM hits JOIN chunks USING (child_id) GROUP BY query_id) SELECT query_id, hits, duplicates, len(list_filter(list_slice(terms, 1, 5), lambda t: contains(found, t))) AS terms_found FROM e JOIN h USING (query_id)", "chunks", "queries"))
def retrieval_eval(spark, sf_dir):
    """Of the first five terms of a query (its expected terms) how many its matches have."""
    hits = q_retrieval._hits(spark, sf_dir)
    texts = q_retrieval._chunks(spark, sf_dir).select("child_id", "child_text").join(hits.hint("merge"), "child_id")
    want = spark_view(spark, sf_dir, "queries").select("query_id", F.slice(T.index_terms(F.col("query_text")), 1, 5).alias("terms"))
    return E.retrieval_eval(texts, want)


_RESULTS = """a AS (SELECT o_custkey, round(sum(o_totalprice), 4) AS t, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey, round(sum(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_totalprice END), 4) AS t FROM orders GROUP BY ALL),
    e AS (SELECT o_custkey, t FROM a), up AS (SELECT row_number() OVER (ORDER BY o_custkey) AS p, * FROM e), down AS (SELECT row_number() OVER (ORDER BY o_custkey DESC) AS p, * FROM e)"""


def _compared_sql(case: str, same: bool, missing: str, extra: str, actual: str | None, expected: str | None) -> str:
    rows = "CAST(NULL AS BIGINT)" if actual is None else "(SELECT count(*) FROM (SELECT * FROM {0} EXCEPT ALL SELECT * FROM {1}))"
    ok = "false" if actual is None else f"{rows.format(expected, actual)} = 0 AND {rows.format(actual, expected)} = 0"
    return f"""SELECT '{case}' AS compared, {same} AS same_columns, '{missing}' AS missing_columns, '{extra}' AS extra_columns, {rows.format(expected, actual)} AS missing_rows, {rows.format(actual, expected)} AS extra_rows,
      {ok} AS projected_rows_match, {same} AND {ok} AS strict_passed, {ok} AS answer_passed, (SELECT count(*) FROM a) AS actual_row_count, (SELECT count(*) FROM a) AS expected_row_count"""


@register(
    "result_compare",
    f"WITH {_RESULTS} "
    + " UNION ALL ".join([
        _compared_sql("same", True, "", "", "e", "e"), _compared_sql("altered", True, "", "", "b", "e"), _compared_sql("same_order", True, "", "", "up", "up"), _compared_sql("other_order", True, "", "", "down", "up"),
        _compared_sql("more_columns", False, "", "n", "e", "e"), _compared_sql("fewer_columns", False, "t", "", None, None),
    ]),
)
def result_compare(spark, sf_dir):
    """An expected result (sums by customer) against the same, an altered one, the same in the same and in another order, one with another column, and one without a column."""
    o = load(spark, sf_dir, "orders")
    a = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("n"))
    b = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderkey") % 97 == 0, 0.0).otherwise(F.col("o_totalprice"))).alias("t"))
    e, up = a.drop("n"), ["o_custkey"]
    cases = {"same": (e, None), "altered": (b, None), "same_order": (e, (up, up)), "other_order": (e, (["o_custkey desc"], up)), "more_columns": (a, None), "fewer_columns": (e.drop("t"), None)}
    out = [E.result_compare(actual, e, order).select(F.lit(case).alias("compared"), "*") for case, (actual, order) in cases.items()]
    return reduce(DataFrame.unionByName, out)


@register("routing_eval", with_views(f"WITH {q_rules._RULED} SELECT query_id, len(list_filter(['vector_document'], lambda x: NOT list_contains(sources, x))) AS missing, len(list_filter(sources, lambda x: x = 'sql_structured')) AS forbidden, list_contains(sources, 'vector_document') AND NOT list_contains(sources, 'sql_structured') AS passed FROM ruled", "query_log"))
def routing_eval(spark, sf_dir):
    return E.routing_eval(q_rules._ruled(spark, sf_dir), ["vector_document"], ["sql_structured"])


@register("answer_eval", with_views(f"SELECT query_id, turn, len({_IDS}) >= 2 AS enough_citations, contains(lower(answer_markdown), 'the') AS phrase_present, len({_IDS}) >= 2 AND contains(lower(answer_markdown), 'the') AS passed FROM answers", "answers"))
def answer_eval(spark, sf_dir):
    enough, phrase = F.size(q_fusion._ids()) >= 2, F.lower("answer_markdown").contains("the")
    return spark_view(spark, sf_dir, "answers").select("query_id", "turn", enough.alias("enough_citations"), phrase.alias("phrase_present"), (enough & phrase).alias("passed"))


@register("compression_bench", with_views("SELECT overall_verdict AS model, round(avg(faithfulness), 6) AS avg_score, round(count(*) FILTER (citation_grounding >= 3) / count(*), 4) AS integrity_rate, round(avg(total_rounds_used), 6) AS avg_rounds FROM gate_input GROUP BY overall_verdict", "gate_input"))
def compression_bench(spark, sf_dir):
    return spark_view(spark, sf_dir, "gate_input").groupBy(F.col("overall_verdict").alias("model")).agg(F.round(F.avg("faithfulness"), 6).alias("avg_score"), F.round(F.count_if(F.col("citation_grounding") >= 3) / F.count("*"), 4).alias("integrity_rate"), F.round(F.avg("total_rounds_used"), 6).alias("avg_rounds"))


@register("passage_eval", r"SELECT conv_id, turn, n, n BETWEEN 2 AND 4 AS passed FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x) <> '')) AS n FROM conversations)")
def passage_eval(spark, sf_dir):
    n = F.size(F.filter(F.split("text", "[.!?]"), lambda x: F.trim(x) != ""))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("long").alias("n"), n.between(2, 4).alias("passed"))


@register("stepback_eval", f"WITH {q_rules._PAIRS} SELECT conv_id, turn_id, length(answer_summary) < length(user_query) AS broader FROM pairs")
def stepback_eval(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = lambda c: F.lead(c).over(w)
    rows = load(spark, sf_dir, "conversations").select("conv_id", "role", "text", nxt("turn").alias("turn_id"), nxt("role").alias("next_role"), F.substring(nxt("text"), 1, 500).alias("answer_summary"))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn_id", (F.length("answer_summary") < F.length("text")).alias("broader"))
