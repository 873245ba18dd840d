"""Queries: checks of model outputs and the remaining evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import rules as R
from lodestrata.operators import merging
from lodestrata.operators import sqlsource as S
from lodestrata.plans import q_fusion, q_graph, q_retrieval, q_rules
from lodestrata.plans.registry import register
from lodestrata.plans.views import load, spark_view, with_views

#: Words that a generated statement may not have (the executor's list has two more).
_GENERATED = [w for w in S.FORBIDDEN if w not in ("replace", "truncate")]
_STATEMENT = "CASE conv_id % 3 WHEN 0 THEN 'select * from orders where x = ''' || t || ''';' WHEN 1 THEN 'select c_name from customer' ELSE t END"


@register(
    "sql_generation_check",
    rf"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS t FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(trim({_STATEMENT}), ';+$', '') AS s FROM a)
    SELECT conv_id, turn, starts_with(lower(s), 'select') AND NOT ({' OR '.join(f"regexp_matches(lower(s), '{chr(92)}b{w}{chr(92)}b')" for w in _GENERATED)}) AS accepted,
      array_to_string(list_filter(['customer', 'orders', 'part'], lambda x: contains(lower(s), x)), '|') AS target_tables FROM s""",
)
def sql_generation_check(spark, sf_dir):
    """A generated statement must begin with select and have no forbidden word; of its target tables the known ones stay."""
    t, k = F.regexp_replace("text", r"[^\x00-\x7F]", "x"), F.col("conv_id") % 3
    sql = F.when(k == 0, F.concat(F.lit("select * from orders where x = '"), t, F.lit("';"))).when(k == 1, "select c_name from customer").otherwise(t)
    low = F.lower(F.regexp_replace(F.trim(sql), ";+$", ""))
    bad = F.exists(F.array(*[low.rlike(rf"\b{w}\b") for w in _GENERATED]), lambda x: x)
    known = F.filter(F.array(*[F.lit(x) for x in ("customer", "orders", "part")]), lambda x: low.contains(x))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (low.startswith("select") & ~bad).alias("accepted"), F.array_join(known, "|").alias("target_tables"))


@register("fact_node", with_views(f"WITH {q_graph._NODES} SELECT 'graph_node::' || key AS fact_id, 'graph_relationships' AS source_type, left(canonical_name || ' (' || entity_type || '): ' || evidence, 240) AS summary, mention_count FROM nodes", "entity_mentions"))
def fact_node(spark, sf_dir):
    n = q_graph._nodes(spark, sf_dir)
    text = F.concat("canonical_name", F.lit(" ("), "entity_type", F.lit("): "), "evidence")
    return n.select(F.concat(F.lit("graph_node::"), "key").alias("fact_id"), F.lit("graph_relationships").alias("source_type"), F.substring(text, 1, 240).alias("summary"), "mention_count")


@register(
    "compression_sanitize",
    with_views(f"WITH {q_fusion._RANKED}, u AS (SELECT sub_query_id, answer_rank, fact_id FROM ranked WHERE answer_rank <= 8), ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_query_id ORDER BY answer_rank) AS n FROM u WHERE starts_with(fact_id, 'vector')) WHERE n <= 4), fb AS (SELECT sub_query_id, answer_rank, fact_id, answer_rank AS n FROM u WHERE answer_rank <= 4 AND sub_query_id NOT IN (SELECT sub_query_id FROM ok)) SELECT sub_query_id, n, fact_id, 'unit' AS kind FROM ok UNION ALL SELECT sub_query_id, n, fact_id, 'extract' FROM fb", *q_fusion._FV),
)
def compression_sanitize(spark, sf_dir):
    """Units whose facts are allowed (here those from documents), four a sub-query; a sub-query without any gets its first four facts."""
    from lodestrata.operators import fusion, retrieval

    some = fusion.fact_rank(q_fusion._facts(spark, sf_dir)).filter("answer_rank <= 8").select("sub_query_id", "answer_rank", "fact_id")
    ok = retrieval.top_k(some.filter(F.col("fact_id").startswith("vector")), ["sub_query_id"], [F.col("answer_rank")], 4, "n")
    rest = some.filter("answer_rank <= 4").join(ok.select("sub_query_id").distinct().hint("merge"), "sub_query_id", "left_anti").withColumn("n", F.col("answer_rank"))
    return ok.withColumn("kind", F.lit("unit")).unionByName(rest.withColumn("kind", F.lit("extract"))).select("sub_query_id", "n", "fact_id", "kind")


@register("guardrail_merge", with_views(f"WITH {q_rules._LOG}, s AS (SELECT query_id, t, {q_rules._SANITIZED.replace('text', 't')} AS s FROM l), a AS (SELECT query_id, t, {q_rules._ATTACK} AS a FROM s), m AS (SELECT query_id, a, CASE WHEN length(t) % 7 = 0 THEN ['model_flag'] ELSE [] END AS b FROM a) SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS attack_types, len(a) > 0 OR len(b) > 0 AS blocked, CASE WHEN len(a) > 0 THEN 'high' WHEN len(b) > 0 THEN 'medium' ELSE 'low' END AS risk_level FROM m", "query_log"))
def guardrail_merge(spark, sf_dir):
    """The rules' findings together with a model's (here: texts whose length is divisible by 7); the rules' block wins."""
    from lodestrata.functions.text import sanitize_query

    rows = q_rules._log(spark, sf_dir).select("query_id", R.attack_types(sanitize_query(F.col("t"))).alias("a"), F.when(F.length("t") % 7 == 0, F.array(F.lit("model_flag"))).otherwise(F.array().cast("array<string>")).alias("b"))
    risk = F.when(F.size("a") > 0, "high").when(F.size("b") > 0, "medium").otherwise("low")
    return rows.select("query_id", F.array_join(F.array_sort(F.array_union("a", "b")), "|").alias("attack_types"), ((F.size("a") > 0) | (F.size("b") > 0)).alias("blocked"), risk.alias("risk_level"))


@register(
    "corrective_retry",
    with_views(f"WITH {q_retrieval._COVER}, t AS (SELECT sub_query_id FROM coverage WHERE {q_retrieval._HYDE} <> '') SELECT sub_query_id, chunk_no, sub_query_id IN (SELECT sub_query_id FROM t) AS retried, max(score) AS best_score, count(*) AS match_count FROM arrived WHERE variant_ord < 2 OR sub_query_id IN (SELECT sub_query_id FROM t) GROUP BY ALL", "matches", "chunks"),
)
def corrective_retry(spark, sf_dir):
    """Only the triggered sub-queries get the matches of the extra variant; the others pass unchanged."""
    a = q_retrieval._arrived(spark, sf_dir)
    hit = q_retrieval._coverage(spark, sf_dir).filter(F.size(merging.hyde_reasons()) > 0).select("sub_query_id", F.lit(True).alias("retried"))
    first = merging.merge_dedup(a.filter("variant_ord < 2"))
    more = a.filter("variant_ord = 2").join(hit.hint("merge"), "sub_query_id", "left_semi")
    merged = merging.retry_merge(first, more).join(hit.hint("merge"), "sub_query_id", "left")
    return merged.select("sub_query_id", "chunk_no", F.coalesce("retried", F.lit(False)).alias("retried"), "best_score", "match_count")


@register("rewrite_eval", with_views("SELECT query_id, count(*) AS rewrites, count(*) BETWEEN 2 AND 4 AS in_range, count(*) = count(DISTINCT lower(trim(query_text))) AS no_duplicates FROM variant_rows GROUP BY query_id", "variant_rows"))
def rewrite_eval(spark, sf_dir):
    n = F.count("*")
    return spark_view(spark, sf_dir, "variant_rows").groupBy("query_id").agg(n.alias("rewrites"), n.between(2, 4).alias("in_range"), (n == F.count_distinct(F.lower(F.trim("query_text")))).alias("no_duplicates"))


@register("keyword_eval", with_views(f"WITH {q_fusion._FACTS} SELECT sub_query_id, source_type, count(*) FILTER (contains(lower(summary), 'the')) AS with_keyword, count(*) AS facts FROM facts GROUP BY ALL", *q_fusion._FV))
def keyword_eval(spark, sf_dir):
    return q_fusion._facts(spark, sf_dir).groupBy("sub_query_id", "source_type").agg(F.count_if(F.lower("summary").contains("the")).alias("with_keyword"), F.count("*").alias("facts"))


@register("parallel_eval", with_views(f"WITH {q_rules._POLICED} SELECT query_id, parallel_safe, vector_profile <> 'skip' AS uses_vector, parallel_safe = (vector_profile <> 'skip') AS as_expected FROM pol", "query_log"))
def parallel_eval(spark, sf_dir):
    used = F.col("vector_profile") != "skip"
    return q_rules._policed(spark, sf_dir).select("query_id", "parallel_safe", used.alias("uses_vector"), (F.col("parallel_safe") == used).alias("as_expected"))


@register("case_enrich", "SELECT item_id, lang, count(*) AS sections, CAST(sum(length(d.text)) AS BIGINT) AS section_chars FROM benchmark JOIN documents d ON lang = CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END GROUP BY ALL")
def case_enrich(spark, sf_dir):
    """Gold cases with the text of the section that they name (here a language), whose sums are made before the join."""
    per = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("section_chars"))
    k = F.col("item_id") % 4
    cases = load(spark, sf_dir, "benchmark").select("item_id", F.when(k == 0, "en").when(k == 1, "de").when(k == 2, "fr").otherwise("es").alias("lang"))
    return cases.join(per.hint("merge"), "lang").select("item_id", "lang", "sections", "section_chars")
