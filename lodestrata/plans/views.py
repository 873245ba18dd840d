"""Input tables, the views derived from them, and the same views as SQL.

``spark_view(spark, sf_dir, name)`` gives a view as a DataFrame; ``with_views(sql, *names)``
puts the SQL of views, and of what they need, in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.cut import settled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> (needed views, Spark SQL, DuckDB SQL or None where it is the same)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "parents": (
        (),
        "SELECT d.doc_id, i AS parent_index, concat(CAST(d.doc_id AS STRING), '_par', CAST(i AS STRING)) AS parent_id, substring(d.text, 1300 * i + 1, 1500) AS parent_text, d.lang, d.source FROM documents d LATERAL VIEW explode(sequence(0, greatest(1, CAST(ceil((length(d.text) - 200) / 1300.0D) AS INT)) - 1)) t AS i",
        "SELECT d.doc_id, i AS parent_index, concat(CAST(d.doc_id AS VARCHAR), '_par', CAST(i AS VARCHAR)) AS parent_id, substr(d.text, 1300 * i + 1, 1500) AS parent_text, d.lang, d.source FROM documents d, unnest(range(0, greatest(1, CAST(ceil((length(d.text) - 200) / 1300.0) AS INT)))) t(i)",
    ),
    "chunks": (
        ("parents",),
        "SELECT p.*, k AS child_index, concat(p.parent_id, '_ch', CAST(k AS STRING)) AS child_id, substring(p.parent_text, 350 * k + 1, 400) AS child_text FROM parents p LATERAL VIEW explode(sequence(0, greatest(1, CAST(ceil((length(p.parent_text) - 50) / 350.0D) AS INT)) - 1)) t AS k",
        "SELECT p.*, k AS child_index, concat(p.parent_id, '_ch', CAST(k AS VARCHAR)) AS child_id, substr(p.parent_text, 350 * k + 1, 400) AS child_text FROM parents p, unnest(range(0, greatest(1, CAST(ceil((length(p.parent_text) - 50) / 350.0) AS INT)))) t(k)",
    ),
    "queries": ((), "SELECT item_id AS query_id, text AS query_text FROM benchmark", None),
    "variant_rows": (
        (),
        "SELECT item_id AS query_id, 'original' AS variant_type, 0 AS variant_ord, text AS query_text FROM benchmark UNION ALL SELECT item_id, 'multi_query', 1, concat('more ', text) FROM benchmark UNION ALL SELECT item_id, 'step_back', 2, concat('overview ', text) FROM benchmark",
        None,
    ),
    "scored": (
        (),
        None,
        "SELECT q.vec_id // 60 AS sub_query_id, CAST(q.vec_id // 20 % 3 AS BIGINT) AS variant_ord, d.vec_id AS chunk_no, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0",
    ),
    "matches": (
        ("scored",),
        None,
        "SELECT sub_query_id, variant_ord, chunk_no, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY sub_query_id, variant_ord ORDER BY score DESC, chunk_no) AS rk FROM scored) t WHERE rk <= 6",
    ),
    "entity_mentions": (
        (),
        "SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN upper(n_name) WHEN l_linenumber % 3 = 1 THEN concat(n_name, ' (', upper(substring(n_name, 1, 3)), ')') ELSE n_name END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'geography' ELSE 'organization' END AS entity_type, concat(l_returnflag, l_linestatus) AS evidence, concat('o', CAST(l_orderkey % 50 AS VARCHAR(20))) AS source_parent_id, l_linestatus AS section_title, l_linenumber AS page_start, l_linenumber + 1 AS page_end FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT l_orderkey * 10 + l_linenumber, s_name, 'organization', concat(l_returnflag, l_linestatus), concat('o', CAST(l_orderkey % 50 AS VARCHAR(20))), l_linestatus, l_linenumber, l_linenumber + 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        None,
    ),
    "relation_mentions": (
        (),
        "SELECT l_orderkey * 10 + l_linenumber AS ord, n_name AS source, CASE WHEN l_linenumber % 4 = 0 THEN 'supports' WHEN l_linenumber % 7 = 0 THEN 'owns' ELSE 'includes' END AS relation_type, CASE WHEN l_linenumber = 5 THEN n_name WHEN l_linenumber = 6 THEN 'unknown co' ELSE s_name END AS target, l_returnflag AS evidence, l_linenumber AS page_start FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
        None,
    ),
    # equal mentions with their number n and first ord: counted by the keys of lineitem, so that names are put in for groups and not for every line
    "entity_mention_counts": (
        (),
        "WITH l AS (SELECT l_suppkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) * 10 + l_linenumber AS ord FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag, l_linestatus) SELECT ord, n, CASE WHEN l_linenumber % 3 = 0 THEN upper(n_name) WHEN l_linenumber % 3 = 1 THEN concat(n_name, ' (', upper(substring(n_name, 1, 3)), ')') ELSE n_name END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'geography' ELSE 'organization' END AS entity_type, concat(l_returnflag, l_linestatus) AS evidence, l_linestatus AS section_title, l_linenumber AS page_start, l_linenumber + 1 AS page_end FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT ord, n, s_name, 'organization', concat(l_returnflag, l_linestatus), l_linestatus, l_linenumber, l_linenumber + 1 FROM l JOIN supplier ON l_suppkey = s_suppkey",
        None,
    ),
    "relation_mention_counts": (
        (),
        "WITH l AS (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS n, min(l_orderkey) * 10 + l_linenumber AS ord FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag) SELECT ord, n, n_name AS source, CASE WHEN l_linenumber % 4 = 0 THEN 'supports' WHEN l_linenumber % 7 = 0 THEN 'owns' ELSE 'includes' END AS relation_type, CASE WHEN l_linenumber = 5 THEN n_name WHEN l_linenumber = 6 THEN 'unknown co' ELSE s_name END AS target, l_returnflag AS evidence FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
        None,
    ),
    "segment_year": (
        (),
        "SELECT year(o_orderdate) AS fiscal_year, n_name AS segment_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY year(o_orderdate), n_name",
        None,
    ),
    "answers": (
        (),
        "SELECT conv_id AS query_id, turn, concat(text, ' [sql::sq_', CAST(conv_id % 5 AS VARCHAR(20)), '::1] [graph_edge::e', CAST(turn AS VARCHAR(20)), ']') AS answer_markdown FROM conversations WHERE role = 'assistant'",
        None,
    ),
    "gate_input": (
        (),
        "SELECT conv_id AS query_id, turn, 1 + (conv_id + turn) % 5 AS faithfulness, 1 + (conv_id * 3 + turn) % 5 AS answer_relevancy, 1 + (conv_id + 2 * turn) % 5 AS context_precision, 1 + (2 * conv_id + turn) % 5 AS citation_grounding, CASE (conv_id + turn) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'borderline' ELSE 'fail' END AS overall_verdict, turn % 2 AS repairs_used, turn % 3 AS total_rounds_used, (conv_id % 2 = 0) AS needs_correction, turn % 5 % 2 AS answer_regenerations_used, (turn + 1) % 2 AS pipeline_reruns_used, turn % 4 % 3 AS actions_taken, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(conv_id % 5 AS DOUBLE) END AS last_score, (conv_id * 7 + turn) % 11 = 0 AS missing_inline, (conv_id + 5 * turn) % 13 = 0 AS inline_not_declared, (conv_id * 3 + turn) % 7 = 0 AS unknown_used, (conv_id + turn) % 4 = 1 AS unanswered, (conv_id + turn) % 4 IN (1, 2) AS coverage_gap FROM conversations WHERE role = 'assistant'",
        None,
    ),
    # the answers of a conversation are the rounds of one question; no more than three can count
    "gate_rounds_input": (
        (),
        "SELECT conv_id AS query_id, CAST(n - 1 AS INTEGER) AS round, 1 + (conv_id + turn) % 5 AS faithfulness, 1 + (conv_id * 3 + turn) % 5 AS answer_relevancy, 1 + (conv_id + 2 * turn) % 5 AS context_precision, 1 + (2 * conv_id + turn) % 5 AS citation_grounding, CASE (conv_id + n) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'borderline' ELSE 'fail' END AS overall_verdict, (conv_id % 2 = 0) AS needs_correction, (conv_id * 7 + turn) % 11 = 0 AS missing_inline, (conv_id + 5 * turn) % 13 = 0 AS inline_not_declared, (conv_id * 3 + turn) % 7 = 0 AS unknown_used, (conv_id + turn) % 4 = 1 AS unanswered, (conv_id + turn) % 4 IN (1, 2) AS coverage_gap FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'assistant') t WHERE n <= 3",
        None,
    ),
    # questions of five kinds over the parts, with what their decomposition and their gates should be: written down here, not taken from the rules
    "gold_queries": (
        (),
        "SELECT p_partkey AS case_id, CASE p_partkey % 5 WHEN 0 THEN concat('What is the retail price of ', p_name, '?') WHEN 1 THEN concat('Show the price of ', p_name, ' and list the suppliers of ', p_name) WHEN 2 THEN concat('Compare revenue growth of ', p_name, ' and fiscal year 2025 revenue of ', p_brand) WHEN 3 THEN concat('Identify fiscal 2025 net income and describe cybersecurity risks of ', p_name) WHEN 4 THEN concat('Explain why its price changed and what that means for ', p_name) END AS query_text, CASE p_partkey % 5 WHEN 0 THEN concat('what is the retail price of ', p_name) WHEN 1 THEN concat('show the price of ', p_name, '|list the suppliers of ', p_name) WHEN 2 THEN concat('revenue growth of ', p_name, '|FY2025 revenue of ', p_brand) WHEN 3 THEN concat('Identify net income in FY2025|What are the cybersecurity risks of ', p_name, '?') WHEN 4 THEN concat('explain why its price changed and what that means for ', p_name) END AS gold_sub_queries, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false END AS gold_needs, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS gold_run_decomposition, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false END AS gold_run_multi_query, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS gold_run_step_back, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false END AS gold_run_hyde, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true END AS gold_is_ambiguous_case, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS gold_estimated_sub_queries FROM part",
        None,
    ),
    # questions about suppliers; what they should find comes from the suppliers' own table, and a fifth expect a relation that the graph lacks
    "graph_questions": (
        (),
        "SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN concat('Which nation includes ', s_name, '?') WHEN 1 THEN concat('What of ', n_name, ' supports ', lower(s_name)) WHEN 2 THEN 'Which suppliers are there?' ELSE concat('Suppliers of ', n_name) END AS query_text, n_name AS nation, CASE s_suppkey % 5 WHEN 4 THEN 'invests_in' ELSE 'includes' END AS relation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        None,
    ),
    # a case is an order: its passage, and what should be extracted from it by the customers' and suppliers' tables
    "case_passages": ((), "SELECT o_orderkey AS case_id, concat('Order ', o_orderstatus, ' of ', c_name, ' in ', n_name, ', ', o_orderpriority, ' and of ', c_mktsegment) AS text, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", None),
    "case_gold": ((), "SELECT DISTINCT l_orderkey AS case_id, s_name, n_name, l_quantity < 25 AS direct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_discount < 0.08", None),
    "query_log": (
        (),
        "SELECT concat('b', CAST(item_id AS VARCHAR(20))) AS query_id, text AS query_text FROM benchmark UNION ALL SELECT concat('c', CAST(conv_id AS VARCHAR(20)), '_', CAST(turn AS VARCHAR(20))), text FROM conversations WHERE role = 'user'",
        None,
    ),
    "blocks": (
        (),
        "SELECT doc_id, pos AS line_no, CAST((pos * 37 + doc_id * 11) % 400 AS DOUBLE) AS x0, CAST(pos * 20 AS DOUBLE) AS y0, CAST((pos * 37 + doc_id * 11) % 400 + 150 AS DOUBLE) AS x1, CAST(pos * 20 + 18 AS DOUBLE) AS y1, line AS text FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line",
        "SELECT doc_id, pos - 1 AS line_no, CAST(((pos - 1) * 37 + doc_id * 11) % 400 AS DOUBLE) AS x0, CAST((pos - 1) * 20 AS DOUBLE) AS y0, CAST(((pos - 1) * 37 + doc_id * 11) % 400 + 150 AS DOUBLE) AS x1, CAST((pos - 1) * 20 + 18 AS DOUBLE) AS y1, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)",
    ),
    "table_boxes": ((), "SELECT DISTINCT doc_id, 100.0D AS x0, CAST((doc_id % 7) * 40 AS DOUBLE) AS y0, 300.0D AS x1, CAST((doc_id % 7) * 40 + 60 AS DOUBLE) AS y1 FROM documents", "SELECT DISTINCT doc_id, 100.0::DOUBLE AS x0, CAST((doc_id % 7) * 40 AS DOUBLE) AS y0, 300.0::DOUBLE AS x1, CAST((doc_id % 7) * 40 + 60 AS DOUBLE) AS y1 FROM documents"),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return load(spark, sf_dir, name)
    needs, text, _ = VIEWS[name]
    if text is None:
        from lodestrata.operators import retrieval

        return {"matches": retrieval.variant_matches}[name](load(spark, sf_dir, "embeddings"))
    used = [t for t in TABLES if t in text.replace(",", " ").replace(")", " ").split()]
    return spark.sql(_named(text, [*needs, *used]), **{n: spark_view(spark, sf_dir, n) for n in [*needs, *used]})


def _named(text: str, names: list[str]) -> str:
    """Puts {name} for the views and tables that a text reads, so that ``spark.sql`` takes DataFrames for them."""
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", text)


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for need in VIEWS[name][0]:
                visit(need)
            order.append(name)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][2] or VIEWS[n][1]})" for n in order]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


def counted_lines(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, list[str]]:
    """Lines counted by their supplier and what the columns are made of, and those keys; n, and ord of the first. Written, as it is read for several names.
    Entities' evidence is entity_evidence here. A name has one of three forms by the line's number, so the number itself is a key only where more is made of it."""
    number = "l_linenumber" if {"entity_type", "page_start", "page_end", "relation_type"} & set(columns) else "l_linenumber % 3"
    keys = {"l_linenumber": F.expr(number)} | {c: F.col(c) for c, of in (("l_returnflag", {"evidence"}), ("l_linestatus", {"entity_evidence", "section_title"})) if of & set(columns)}
    lines = load(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    some = lines.select("l_suppkey", "ord", *[c.alias(name) for name, c in keys.items()])
    return settled(some.groupBy("l_suppkey", *keys).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))), list(keys)


def counted_entities(spark: SparkSession, sf_dir: str, *columns: str, counted: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """``entity_mention_counts`` with no more columns than asked for: mentions that differ in others are one row, and lineitem is grouped by so much less.
    counted: of ``counted_lines``, where more is made of it."""
    made = {
        "name": ("CASE WHEN l_linenumber % 3 = 0 THEN upper(n_name) WHEN l_linenumber % 3 = 1 THEN concat(n_name, ' (', upper(substring(n_name, 1, 3)), ')') ELSE n_name END", "s_name"),
        "entity_type": ("CASE WHEN l_linenumber % 2 = 0 THEN 'geography' ELSE 'organization' END", "'organization'"),
        "evidence": ("concat(l_returnflag, l_linestatus)",) * 2,
        "section_title": ("l_linestatus",) * 2,
        "page_start": ("l_linenumber",) * 2,
        "page_end": ("l_linenumber + 1",) * 2,
    }
    lines, keys = counted or counted_lines(spark, sf_dir, *columns, *(["entity_evidence"] if "evidence" in columns else []))
    rows = lines.join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nations = rows.groupBy("s_nationkey", *keys).agg(F.sum("n").alias("n"), F.min("ord").alias("ord")).join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # a line whose supplier has no nation names its supplier still
    return nations.selectExpr("ord", "n", *[f"{made[c][0]} AS {c}" for c in columns]).unionByName(rows.selectExpr("ord", "n", *[f"{made[c][1]} AS {c}" for c in columns]))


def counted_relations(spark: SparkSession, sf_dir: str, *columns: str, counted: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """``relation_mention_counts``, with evidence if that is asked for."""
    lines, _ = counted or counted_lines(spark, sf_dir, "relation_type", *columns)
    rows = lines.join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr("ord", "n", "n_name AS source", "CASE WHEN l_linenumber % 4 = 0 THEN 'supports' WHEN l_linenumber % 7 = 0 THEN 'owns' ELSE 'includes' END AS relation_type", "CASE WHEN l_linenumber = 5 THEN n_name WHEN l_linenumber = 6 THEN 'unknown co' ELSE s_name END AS target", *["l_returnflag AS evidence" for c in columns if c == "evidence"])
