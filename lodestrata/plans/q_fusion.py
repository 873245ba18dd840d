"""Queries: the SQL source, evidence fusion, answer quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import fusion as X
from lodestrata.operators import sqlsource as S
from lodestrata.plans.registry import register
from lodestrata.plans.views import load, spark_view, with_views


def _year(sql: str) -> str:
    return with_views(sql, "segment_year")


def _rows(spark, sf_dir):
    return spark_view(spark, sf_dir, "segment_year")


@register("q_max_entity", _year("SELECT fiscal_year, segment_name, revenue FROM segment_year s WHERE revenue = (SELECT max(revenue) FROM segment_year t WHERE t.fiscal_year = s.fiscal_year)"))
def q_max_entity(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.withColumn("m", F.max("revenue").over(W.partitionBy("fiscal_year"))).filter("revenue = m").select("fiscal_year", "segment_name", "revenue")


@register("q_negative_growth", _year("SELECT * FROM (SELECT segment_name, fiscal_year, round(revenue - lag(revenue) OVER (PARTITION BY segment_name ORDER BY fiscal_year), 2) AS growth FROM segment_year) WHERE growth < 0 ORDER BY growth"))
def q_negative_growth(spark, sf_dir):
    before = F.lag("revenue").over(W.partitionBy("segment_name").orderBy("fiscal_year"))
    return _rows(spark, sf_dir).select("segment_name", "fiscal_year", F.round(F.col("revenue") - before, 2).alias("growth")).filter("growth < 0").orderBy("growth")


@register("q_mix_by_group", _year("SELECT fiscal_year, segment_name, round(revenue / sum(revenue) OVER (PARTITION BY fiscal_year), 6) AS share FROM segment_year"))
def q_mix_by_group(spark, sf_dir):
    return _rows(spark, sf_dir).select("fiscal_year", "segment_name", F.round(F.col("revenue") / F.sum("revenue").over(W.partitionBy("fiscal_year")), 6).alias("share"))


@register("q_filtered_list_desc", _year("SELECT fiscal_year, segment_name, revenue FROM segment_year WHERE segment_name LIKE '%1%' ORDER BY revenue DESC"))
def q_filtered_list_desc(spark, sf_dir):
    return _rows(spark, sf_dir).filter("segment_name LIKE '%1%'").select("fiscal_year", "segment_name", "revenue").orderBy(F.col("revenue").desc())


@register("q_multi_predicate", _year("SELECT fiscal_year, segment_name, revenue, order_count FROM segment_year WHERE segment_name LIKE '%1%' AND order_count > 3"))
def q_multi_predicate(spark, sf_dir):
    return _rows(spark, sf_dir).filter("segment_name LIKE '%1%' AND order_count > 3").select("fiscal_year", "segment_name", "revenue", "order_count")


@register("q_avg_metric", _year("SELECT segment_name, round(avg(order_count), 4) AS average FROM segment_year GROUP BY segment_name"))
def q_avg_metric(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("segment_name").agg(F.round(F.avg("order_count"), 4).alias("average"))


@register("q_rank_by_metric", _year("SELECT fiscal_year, segment_name, rank() OVER (PARTITION BY fiscal_year ORDER BY revenue DESC) AS rk FROM segment_year"))
def q_rank_by_metric(spark, sf_dir):
    return _rows(spark, sf_dir).select("fiscal_year", "segment_name", F.rank().over(W.partitionBy("fiscal_year").orderBy(F.col("revenue").desc())).alias("rk"))


@register("sql_execute_limited", _year("SELECT fiscal_year, CAST(sum(order_count) AS BIGINT) AS orders FROM segment_year GROUP BY fiscal_year ORDER BY fiscal_year LIMIT 50"))
def sql_execute_limited(spark, sf_dir):
    return S.execute_limited(spark, "SELECT fiscal_year, CAST(sum(order_count) AS BIGINT) AS orders FROM segment_year GROUP BY fiscal_year ORDER BY fiscal_year", {"segment_year": _rows(spark, sf_dir)})


_TEXTS = "CASE conv_id % 4 WHEN 0 THEN 'select * from t where x = ''' || replace(t, ';', ',') || '''' WHEN 1 THEN 'select 1; ' || t WHEN 2 THEN t ELSE 'with a as (select 1) select * from a where update_ts > 1;' END"
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
_REASON = "CASE WHEN s = '' THEN 'empty' WHEN len(list_filter(string_split(s, ';'), lambda x: trim(x) <> '')) <> 1 THEN 'not_single' WHEN NOT (starts_with(lower(s), 'select') OR starts_with(lower(s), 'with')) THEN 'not_select' " + " ".join(f"WHEN regexp_matches(lower(s), '\\b{w}\\b') THEN 'forbidden_{w}'" for w in S.FORBIDDEN) + " ELSE '' END"


@register("sql_guard", rf"WITH a AS (SELECT conv_id, turn, {_ASCII} AS t FROM conversations), s AS (SELECT conv_id, turn, regexp_replace({_TEXTS}, '^\s+|\s+$', '', 'g') AS s FROM a) SELECT conv_id, turn, {_REASON} AS reason FROM s")
def sql_guard(spark, sf_dir):
    """Texts of the conversations put into statements, by conversation."""
    t, k = F.regexp_replace("text", r"[^\x00-\x7F]", "x"), F.col("conv_id") % 4
    sql = F.when(k == 0, F.concat(F.lit("select * from t where x = '"), F.replace(t, F.lit(";"), F.lit(",")), F.lit("'"))).when(k == 1, F.concat(F.lit("select 1; "), t)).when(k == 2, t).otherwise("with a as (select 1) select * from a where update_ts > 1;")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", S.guard_reason(sql).alias("reason"))


_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("customer", "orders", "supplier"))


@register("sql_capability", f"SELECT c.table_name, string_agg(column_name, ',' ORDER BY column_index) AS columns, max(row_count) AS row_count FROM duckdb_columns() c JOIN ({_SIZES}) s ON c.table_name = s.table_name GROUP BY c.table_name")
def sql_capability(spark, sf_dir):
    """What can be asked: the columns of each table, and its rows."""
    from lodestrata.sources.tables import schema_profile

    df = schema_profile({t: load(spark, sf_dir, t) for t in ("customer", "orders", "supplier")})
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"])
    return df.groupBy("table_name").agg(F.concat_ws(",", names).alias("columns"), F.max("row_count").alias("row_count"))


@register("sql_evidence", _year("SELECT fiscal_year, count(*) AS row_count, string_agg(CASE WHEN n <= 10 THEN segment_name || '=' || CAST(order_count AS VARCHAR) END, '; ' ORDER BY n) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY segment_name) AS n FROM segment_year) GROUP BY fiscal_year"))
def sql_evidence(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("fiscal_year").orderBy("segment_name"))
    cell = F.when(F.col("n") <= 10, F.struct("n", F.concat("segment_name", F.lit("="), F.col("order_count").cast("string")).alias("c")))
    return _rows(spark, sf_dir).withColumn("n", n).groupBy("fiscal_year").agg(F.count("*").alias("row_count"), F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["c"])).alias("evidence"))


# ---------------------------------------------------------------- facts

_TITLE = X.TITLE.replace("\\s", "[ \\t\\n\\r]")
_ENT = r"list_slice(list_filter(list_transform(regexp_extract_all(t, '\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9&.-]+){0,5}|AI)\b'), lambda x: regexp_replace(x, '^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$', '', 'g')), lambda x: length(x) >= 2), 1, 8)"
_FACTS = """m AS (SELECT *, CAST(sub_query_id AS VARCHAR) || '_' || CAST(variant_ord AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS i FROM matches),
    fv AS (SELECT 'vector::' || i AS fact_id, 'vector_document' AS source_type, sub_query_id, 'vector_chunk' AS fact_type, left(coalesce(text, ''), 280) AS summary, [coalesce(lang, ''), coalesce(source, '')] AS entities, lang AS section, CAST(chunk_no AS VARCHAR) AS parent_id, score FROM m LEFT JOIN documents ON doc_id = chunk_no),
    fs AS (SELECT 'sql::' || CAST(fiscal_year AS VARCHAR) || '_' || segment_name AS fact_id, 'sql_structured' AS source_type, CAST(fiscal_year % 5 AS BIGINT) AS sub_query_id, 'sql_row' AS fact_type, left('fiscal_year=' || CAST(fiscal_year AS VARCHAR) || ', segment_name=' || segment_name, 220) AS summary, [segment_name] AS entities, CAST(NULL AS VARCHAR) AS section, CAST(fiscal_year AS VARCHAR) AS parent_id, CAST(order_count AS DOUBLE) AS score FROM segment_year),
    fg AS (SELECT 'graph_edge::' || n_name || '_' || r_name AS fact_id, 'graph_relationships' AS source_type, CAST(n_nationkey % 5 AS BIGINT) AS sub_query_id, 'graph_edge' AS fact_type, left(r_name || ' includes ' || n_name, 240) AS summary, [n_name, r_name] AS entities, 'en' AS section, CAST(n_regionkey AS VARCHAR) AS parent_id, 1.0::DOUBLE AS score FROM nation JOIN region ON n_regionkey = r_regionkey),
    facts AS (SELECT * FROM fv UNION ALL SELECT * FROM fs UNION ALL SELECT * FROM fg)"""
_FV = ("matches", "segment_year")


def _facts(spark, sf_dir):
    none = F.lit(None)
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_no"), "text", "lang", "source")
    m = spark_view(spark, sf_dir, "matches").join(d.hint("merge"), "chunk_no", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    v = X.fact(m, "vector", "vector_document", "vector_chunk", F.concat_ws("_", "sub_query_id", "variant_ord", "chunk_no"), blank("text"), 280, F.array(blank("lang"), blank("source")), F.col("lang"), F.col("chunk_no"), F.col("score"))
    y = _rows(spark, sf_dir).withColumn("sub_query_id", (F.col("fiscal_year") % 5).cast("long"))
    s = X.fact(y, "sql", "sql_structured", "sql_row", F.concat_ws("_", "fiscal_year", "segment_name"), F.concat(F.lit("fiscal_year="), F.col("fiscal_year").cast("string"), F.lit(", segment_name="), "segment_name"), 220, F.array("segment_name"), none, F.col("fiscal_year"), F.col("order_count"))
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region").hint("merge"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("sub_query_id", (F.col("n_nationkey") % 5).cast("long"))
    g = X.fact(n, "graph_edge", "graph_relationships", "graph_edge", F.concat_ws("_", "n_name", "r_name"), F.concat("r_name", F.lit(" includes "), "n_name"), 240, F.array("n_name", "r_name"), F.lit("en"), F.col("n_regionkey"), F.lit(1.0))
    return v.unionByName(s).unionByName(g)


@register("title_entities", rf"SELECT doc_id, len(list_distinct(e)) AS n, e[1] AS first FROM (SELECT doc_id, {_ENT} AS e FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS t FROM documents))")
def title_entities(spark, sf_dir):
    e = X.title_entities(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return load(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.size("e").alias("n"), F.get("e", F.lit(0)).alias("first"))


def _kind(name: str, prefix: str) -> None:
    sql = with_views(f"WITH {_FACTS} SELECT fact_id, source_type, sub_query_id, fact_type, summary, array_to_string(entities, '|') AS entities, section, parent_id FROM facts WHERE starts_with(fact_id, '{prefix}')", *_FV)

    @register(name, sql)
    def one(spark, sf_dir):
        return _facts(spark, sf_dir).filter(F.col("fact_id").startswith(prefix)).select("fact_id", "source_type", "sub_query_id", "fact_type", "summary", F.array_join("entities", "|").alias("entities"), "section", "parent_id")


for _n, _p in (("fact_vector", "vector::"), ("fact_sql_row", "sql::"), ("fact_edge", "graph_edge::")):
    _kind(_n, _p)


@register("facts_union", with_views(f"WITH {_FACTS} SELECT source_type, sub_query_id, count(*) AS n FROM facts GROUP BY ALL", *_FV))
def facts_union(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("source_type", "sub_query_id").agg(F.count("*").alias("n"))


_PK = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_OVER = f"""{_FACTS}, k AS (SELECT 'entity' AS key_kind, {_PK.format('raw')} AS key, source_type, fact_id FROM (SELECT *, unnest(entities) AS raw FROM facts) UNION ALL SELECT 'parent', {_PK.format('parent_id')}, source_type, fact_id FROM facts UNION ALL SELECT 'section', {_PK.format('section')}, source_type, fact_id FROM facts),
    o AS (SELECT key_kind, key, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS sources, CAST(count(DISTINCT fact_id) AS DECIMAL(38, 0)) AS fact_count, min(fact_id) AS first_fact FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT source_type) > 1)"""


@register("overlap_signals", with_views(f"WITH {_OVER} SELECT key_kind, key, sources, CAST(fact_count AS BIGINT) AS fact_count, first_fact FROM o", *_FV))
def overlap_signals(spark, sf_dir):
    return X.overlap_signals(_facts(spark, sf_dir))


@register("sql_conflicts", "WITH o AS (SELECT *, first_value(o_orderpriority) OVER w AS first_value FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey, o_orderpriority, first_value, against FROM (SELECT *, last_value(CASE WHEN o_orderpriority = first_value THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS against FROM o) WHERE o_orderpriority <> first_value")
def sql_conflicts(spark, sf_dir):
    return X.value_conflicts(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority", "first_value", "against")


_RELC = "WITH r AS (SELECT *, first_value(relation_type) OVER (PARTITION BY source, target ORDER BY ord) AS first_value FROM relation_mentions) SELECT source, target, relation_type, first_value, count(*) AS n FROM r WHERE relation_type <> first_value GROUP BY ALL"


@register("relation_conflicts", with_views(_RELC, "relation_mentions"))
def relation_conflicts(spark, sf_dir):
    got = X.value_conflicts(spark_view(spark, sf_dir, "relation_mentions"), ["source", "target"], ["ord"], "relation_type", "ord")
    return got.groupBy("source", "target", "relation_type", "first_value").agg(F.count("*").alias("n"))


@register("conflict_signals", with_views(f"WITH x AS ({_RELC}) SELECT 'relation' AS conflict_type, count(*) AS n FROM x UNION ALL SELECT 'sql_value', count(*) FROM (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) WHERE o_orderpriority <> f", "relation_mentions"))
def conflict_signals(spark, sf_dir):
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("conflict_type"), "n")
    return count(relation_conflicts(spark, sf_dir), "relation").unionByName(count(sql_conflicts(spark, sf_dir), "sql_value"))


_RANKED = f"{_FACTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sub_query_id ORDER BY CASE source_type WHEN 'sql_structured' THEN 0 WHEN 'graph_relationships' THEN 1 WHEN 'vector_document' THEN 2 ELSE 9 END, CASE fact_type WHEN 'sql_row' THEN 0 WHEN 'graph_edge' THEN 1 WHEN 'graph_node' THEN 2 ELSE 3 END, score DESC, fact_id) AS answer_rank FROM facts)"
_LINE = "CASE source_type WHEN 'sql_structured' THEN '[SQL] ' WHEN 'graph_relationships' THEN '[Graph] ' ELSE '[Vector] ' END || summary"


@register("fact_rank", with_views(f"WITH {_RANKED} SELECT sub_query_id, fact_id, answer_rank FROM ranked", *_FV))
def fact_rank(spark, sf_dir):
    return X.fact_rank(_facts(spark, sf_dir)).select("sub_query_id", "fact_id", "answer_rank")


@register("answer_lines", with_views(f"WITH {_FACTS} SELECT fact_id, {_LINE} AS line FROM facts", *_FV))
def answer_lines(spark, sf_dir):
    return _facts(spark, sf_dir).select("fact_id", X.answer_line(F.col("source_type"), F.col("summary")).alias("line"))


@register("sub_query_fusion", with_views(f"WITH {_RANKED} SELECT sub_query_id, count(*) AS fact_count, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS active_sources, string_agg(CASE WHEN answer_rank <= 8 THEN {_LINE} END, chr(10) ORDER BY answer_rank) AS text FROM ranked GROUP BY sub_query_id", *_FV))
def sub_query_fusion(spark, sf_dir):
    return X.sub_query_fusion(X.fact_rank(_facts(spark, sf_dir)))


@register("fusion_summary", with_views(f"WITH {_OVER} SELECT count(*) AS fact_count, count(DISTINCT sub_query_id) AS sub_query_count, (SELECT count(*) FROM o) AS overlap_count FROM facts", *_FV))
def fusion_summary(spark, sf_dir):
    f = _facts(spark, sf_dir)
    n = f.agg(F.count("*").alias("fact_count"), F.count_distinct("sub_query_id").alias("sub_query_count"))
    return n.join(F.broadcast(X.overlap_signals(f).agg(F.count("*").alias("overlap_count"))))


@register("compression_gate", with_views(f"WITH {_FACTS} SELECT count(*) AS fact_count, count(DISTINCT sub_query_id) AS sub_query_count, count(*) FILTER (source_type = 'vector_document') AS vector_count, count(*) >= 30 AND count(DISTINCT sub_query_id) >= 2 AND count(*) FILTER (source_type = 'vector_document') >= 8 AS compress FROM facts", *_FV))
def compression_gate(spark, sf_dir):
    return X.compression_gate(_facts(spark, sf_dir))


@register("answer_input", with_views(f"WITH {_RANKED} SELECT sub_query_id, answer_rank, fact_id, source_type FROM ranked WHERE answer_rank <= 8", *_FV))
def answer_input(spark, sf_dir):
    return X.fact_rank(_facts(spark, sf_dir)).filter("answer_rank <= 8").select("sub_query_id", "answer_rank", "fact_id", "source_type")


@register("repair_input", with_views(f"WITH {_RANKED} SELECT sub_query_id, answer_rank, fact_id, source_type FROM ranked WHERE answer_rank <= 10", *_FV))
def repair_input(spark, sf_dir):
    return X.fact_rank(_facts(spark, sf_dir)).filter("answer_rank <= 10").select("sub_query_id", "answer_rank", "fact_id", "source_type")


@register("compression_input", with_views(f"WITH {_RANKED} SELECT sub_query_id, answer_rank, fact_id, array_to_string(list_slice(entities, 1, 6), '|') AS entities FROM ranked WHERE answer_rank <= 8", *_FV))
def compression_input(spark, sf_dir):
    return X.fact_rank(_facts(spark, sf_dir)).filter("answer_rank <= 8").select("sub_query_id", "answer_rank", "fact_id", F.array_join(F.slice("entities", 1, 6), "|").alias("entities"))


# ---------------------------------------------------------------- answers

_IDS = r"regexp_extract_all(answer_markdown, '\[([^\[\]]+::[^\[\]]+)\]', 1)"


def _ids():
    return F.regexp_extract_all("answer_markdown", F.lit(r"\[([^\[\]]+::[^\[\]]+)\]"), F.lit(1))


@register("inline_citations", with_views(f"SELECT query_id, turn, array_to_string({_IDS}, '|') AS fact_ids FROM answers", "answers"))
def inline_citations(spark, sf_dir):
    return spark_view(spark, sf_dir, "answers").select("query_id", "turn", F.array_join(_ids(), "|").alias("fact_ids"))


@register("citation_render", with_views(f"SELECT query_id, turn, md5(replace(replace(answer_markdown, '[' || i[1] || ']', '[Evidence 1]'), '[' || i[2] || ']', '[Evidence 2]')) AS rendered_md5, len(i) AS citations FROM (SELECT *, {_IDS} AS i FROM answers)", "answers"))
def citation_render(spark, sf_dir):
    ids = F.array_distinct(_ids())
    text = F.aggregate(F.arrays_zip(ids.alias("id"), F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))).alias("n")), F.col("answer_markdown"), lambda t, x: F.replace(t, F.concat(F.lit("["), x["id"], F.lit("]")), F.concat(F.lit("[Evidence "), x["n"].cast("string"), F.lit("]"))))
    return spark_view(spark, sf_dir, "answers").select("query_id", "turn", F.md5(text).alias("rendered_md5"), F.size(ids).alias("citations"))


@register("sources_used", with_views(f"SELECT query_id, array_to_string(list_sort(list_distinct(flatten(list(list_transform({_IDS}, lambda x: string_split(x, '::')[1]))))), '|') AS sources FROM answers GROUP BY query_id", "answers"))
def sources_used(spark, sf_dir):
    each = spark_view(spark, sf_dir, "answers").select("query_id", F.explode(_ids()).alias("id")).select("query_id", F.element_at(F.split("id", "::"), 1).alias("s")).distinct()
    return each.groupBy("query_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("s"))).alias("sources"))


@register("judge_average", with_views("SELECT query_id, turn, CAST(round((faithfulness + answer_relevancy + context_precision + citation_grounding) / 4.0, 3) AS DOUBLE) AS average_score, CAST(round((faithfulness + answer_relevancy + context_precision + citation_grounding) / 4.0 / 5, 3) AS DOUBLE) AS scaled FROM gate_input", "gate_input"))
def judge_average(spark, sf_dir):
    mean = (F.col("faithfulness") + F.col("answer_relevancy") + F.col("context_precision") + F.col("citation_grounding")) / 4.0
    return spark_view(spark, sf_dir, "gate_input").select("query_id", "turn", F.round(mean, 3).cast("double").alias("average_score"), F.round(mean / 5, 3).cast("double").alias("scaled"))


_REPAIR = "CASE WHEN NOT needs_correction THEN 'no_op' WHEN context_precision <= 2 THEN 'targeted_coverage_repair' WHEN faithfulness <= 2 THEN 'conflict_aware_regeneration' WHEN citation_grounding <= 3 THEN 'citation_strict_regeneration' ELSE 'general_grounded_regeneration' END"


@register("repair_strategy", with_views(f"SELECT query_id, turn, {_REPAIR} AS strategy FROM gate_input", "gate_input"))
def repair_strategy(spark, sf_dir):
    return spark_view(spark, sf_dir, "gate_input").select("query_id", "turn", F.expr(_REPAIR).alias("strategy"))


@register("usage_cost", with_views("SELECT query_id, turn, CAST(round(length(answer_markdown) / 1000000.0 * CASE WHEN turn % 3 = 0 THEN 0.25 WHEN turn % 3 = 1 THEN 2.0 ELSE 0.0 END, 9) AS DOUBLE) AS cost_usd FROM answers", "answers"))
def usage_cost(spark, sf_dir):
    """Tokens (here characters) per million times the model's price; an unknown model costs nothing. The price list is broadcast."""
    prices = spark.range(2).select(F.col("id").alias("model"), F.when(F.col("id") == 0, 0.25).otherwise(2.0).alias("price"))
    rows = spark_view(spark, sf_dir, "answers").withColumn("model", F.col("turn") % 3)
    return rows.join(F.broadcast(prices), "model", "left").select("query_id", "turn", F.round(F.length("answer_markdown") / 1000000.0 * F.coalesce("price", F.lit(0.0)), 9).cast("double").alias("cost_usd"))


@register("pass_rates", with_views("SELECT overall_verdict, count(*) AS cases, count(*) FILTER (faithfulness >= 4) AS passed, round(count(*) FILTER (faithfulness >= 4) / count(*), 4) AS pass_rate, round(avg(answer_relevancy), 3) AS avg_relevancy FROM gate_input GROUP BY overall_verdict", "gate_input"))
def pass_rates(spark, sf_dir):
    ok = F.count_if(F.col("faithfulness") >= 4)
    return spark_view(spark, sf_dir, "gate_input").groupBy("overall_verdict").agg(F.count("*").alias("cases"), ok.alias("passed"), F.round(ok / F.count("*"), 4).alias("pass_rate"), F.round(F.avg("answer_relevancy"), 3).alias("avg_relevancy"))


@register("model_rank", with_views("SELECT overall_verdict AS model, quality, row_number() OVER (ORDER BY quality DESC, model) AS rk FROM (SELECT overall_verdict, overall_verdict AS model, round(avg(faithfulness + citation_grounding), 6) AS quality FROM gate_input GROUP BY overall_verdict)", "gate_input"))
def model_rank(spark, sf_dir):
    m = spark_view(spark, sf_dir, "gate_input").groupBy(F.col("overall_verdict").alias("model")).agg(F.round(F.avg(F.col("faithfulness") + F.col("citation_grounding")), 6).alias("quality"))
    return m.withColumn("rk", F.row_number().over(W.orderBy(F.col("quality").desc(), "model")))
