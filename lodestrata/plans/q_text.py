"""Queries: scans, text preparation, chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunking as C
from lodestrata.plans.registry import register
from lodestrata.plans.views import TABLES, load, spark_view, with_views

#: The same cleaning in SQL.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    for bad, good in T.MOJIBAKE:
        x = f"replace({x}, '{bad}', '{good.replace(chr(39), chr(39) * 2)}')"
    x = f"replace({x}, chr(160), ' ')"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\APage [0-9]+\n', '')"
    x = rf"regexp_replace({x}, '\nPage [0-9]+\n', chr(10), 'g')"
    return _STRIP.format(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@register("clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS clean_md5, length({clean_sql('text')}) AS character_count FROM documents")
def clean_text(spark, sf_dir):
    clean = T.clean_text(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("character_count"))


_SANITIZED = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(8203) || chr(65279), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@register("query_sanitize", f"SELECT conv_id, turn, {_SANITIZED} AS sanitized FROM conversations")
def query_sanitize(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.sanitize_query(F.col("text")).alias("sanitized"))


@register(
    "page_stitch",
    f"""SELECT conv_id AS document_id, count(*) AS page_count, length({_STRIP.format('t')}) AS character_count, {_STRIP.format('t')} AS text FROM (
    SELECT conv_id, turn, string_agg('[Page ' || CAST(turn AS VARCHAR) || ']' || chr(10) || chr(10) || {clean_sql('text')}, chr(10) || chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM conversations) GROUP BY conv_id, t""",
)
def page_stitch(spark, sf_dir):
    marker = F.concat(F.lit("[Page "), F.col("turn").cast("string"), F.lit("]"))
    return C.page_stitch(load(spark, sf_dir, "conversations"), "conv_id", "turn", marker, "text")


def _html_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{mark}')"
    return clean_sql(x)


@register("html_text_extract", f"SELECT page_id, url, {_html_sql('html')} AS text, length({_html_sql('html')}) AS character_count FROM pages")
def html_text_extract(spark, sf_dir):
    text = T.html_text(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("character_count"))


@register(
    "layout_block_filter",
    with_views(
        """SELECT b.doc_id, b.line_no, b.x0, b.y0, b.text, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.y0, b.x0, b.line_no) AS reading_order FROM blocks b
        WHERE NOT EXISTS (SELECT 1 FROM table_boxes t WHERE t.doc_id = b.doc_id AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0)""",
        "blocks", "table_boxes",
    ),
)
def layout_block_filter(spark, sf_dir):
    kept = C.layout_block_filter(spark_view(spark, sf_dir, "blocks"), spark_view(spark, sf_dir, "table_boxes"))
    return kept.select("doc_id", "line_no", "x0", "y0", "text", "reading_order")


@register(
    "section_split",
    r"""WITH l AS (SELECT conv_id AS doc_id, turn AS page, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM
      (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '1. ' || text ELSE text END AS text FROM conversations)),
    m AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM l),
    h AS (SELECT *, regexp_matches(bare, '^([0-9]+\.\s+.+|Appendix\s+[A-Z]\.\s+.+)$') AS is_header, starts_with(first_value(bare) OVER (PARTITION BY doc_id, page ORDER BY line_no), 'Contents') AS contents FROM m),
    s AS (SELECT *, CAST(sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS BIGINT) AS section_index FROM h WHERE NOT (contents AND is_header)),
    g AS (SELECT doc_id, section_index, coalesce(max(CASE WHEN is_header THEN bare END), 'Document Overview') AS section_title, min(page) AS page_start, max(page) AS page_end,
      regexp_replace(string_agg(CASE WHEN is_header THEN bare ELSE line END, chr(10) ORDER BY page, line_no), '^\s+|\s+$', '', 'g') AS text FROM s GROUP BY doc_id, section_index)
    SELECT * FROM g WHERE text <> ''""",
)
def section_split(spark, sf_dir):
    marked = F.when(F.col("role") == "user", F.concat(F.lit("1. "), "text")).otherwise(F.col("text"))
    lines = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split(marked, "\n")).alias("line_no", "line"))
    return C.section_split(lines)


@register("chunk_parent_child", with_views("SELECT doc_id, lang, source, parent_index, parent_id, child_index, child_id, md5(child_text) AS child_md5, length(child_text) AS child_length FROM chunks", "chunks"))
def chunk_parent_child(spark, sf_dir):
    got = C.chunk_parent_child(load(spark, sf_dir, "documents"))
    return got.select("doc_id", "lang", "source", "parent_index", "parent_id", "child_index", "child_id", F.md5("child_text").alias("child_md5"), F.length("child_text").alias("child_length"))


@register("chunk_stats", with_views("SELECT doc_id, count(DISTINCT parent_id) AS parent_chunk_count, count(*) AS child_chunk_count FROM chunks GROUP BY doc_id", "chunks"))
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(C.chunk_parent_child(load(spark, sf_dir, "documents")))


@register(
    "table_chunks",
    """WITH t AS (SELECT fiscal_year AS doc_id, row_number() OVER (PARTITION BY fiscal_year ORDER BY segment_name) - 1 AS table_index, '| ' || segment_name || ' | ' || CAST(order_count AS VARCHAR) || ' |' AS markdown FROM
      (SELECT year(o_orderdate) AS fiscal_year, n_name AS segment_name, count(*) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL))
    SELECT doc_id, CAST(doc_id AS VARCHAR) || '_table' || CAST(table_index AS VARCHAR) AS parent_id, CAST(doc_id AS VARCHAR) || '_table' || CAST(table_index AS VARCHAR) || '_ch0' AS child_id, markdown AS child_text, markdown AS parent_text,
      'table' AS content_type, 'segment' AS header, 1 AS row_count, 2 AS column_count FROM t WHERE trim(markdown) <> ''""",
)
def table_chunks(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = spark_view(spark, sf_dir, "segment_year")
    cells = F.concat(F.lit("| "), "segment_name", F.lit(" | "), F.col("order_count").cast("string"), F.lit(" |"))
    index = F.row_number().over(W.partitionBy("fiscal_year").orderBy("segment_name")) - 1
    tables = rows.select(F.col("fiscal_year").alias("doc_id"), index.alias("table_index"), cells.alias("markdown"), F.lit("segment").alias("header"), F.lit(1).alias("row_count"), F.lit(2).alias("column_count"))
    return C.table_chunks(tables)


@register("embedding_records", with_views("SELECT child_id || '_' || substr(sha256(child_text), 1, 16) AS record_id, child_id AS source_chunk_id, parent_id, 'text' AS content_type, substr(sha256(child_text), 1, 16) AS text_hash FROM chunks", "chunks"))
def embedding_records(spark, sf_dir):
    return C.embedding_records(C.chunk_parent_child(load(spark, sf_dir, "documents")))


@register("child_filter", with_views("SELECT parent_id, child_id FROM chunks WHERE contains(child_id, '_ch')", "chunks"))
def child_filter(spark, sf_dir):
    return C.chunk_parent_child(load(spark, sf_dir, "documents")).select("parent_id", "child_id").filter(F.col("child_id").contains("_ch"))


@register(
    "graph_input_package",
    with_views(
        """SELECT parent_id, string_agg(child_id, '|' ORDER BY child_index) AS source_child_ids, CAST(count(*) AS INT) AS source_child_count, md5(first(t)) AS text_md5, length(first(t)) AS text_length FROM
        (SELECT *, CASE WHEN starts_with(parent_text, lang) THEN parent_text ELSE lang || chr(10) || chr(10) || parent_text END AS t FROM chunks) GROUP BY parent_id""",
        "chunks",
    ),
)
def graph_input_package(spark, sf_dir):
    return C.graph_input_package(C.chunk_parent_child(load(spark, sf_dir, "documents")), "lang")


@register(
    "context_blocks",
    with_views(
        """SELECT doc_id, string_agg('[' || CAST(parent_index + 1 AS VARCHAR) || '] ' || parent_id || chr(10) || parent_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY parent_index) AS context FROM parents GROUP BY doc_id""",
        "parents",
    ),
)
def context_blocks(spark, sf_dir):
    parents = spark_view(spark, sf_dir, "parents")
    block = F.concat(F.lit("["), (F.col("parent_index") + 1).cast("string"), F.lit("] "), "parent_id", F.lit("\n"), "parent_text")
    blocks = F.array_sort(F.collect_list(F.struct("parent_index", block.alias("b"))))
    return parents.groupBy("doc_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


@register(
    "markdown_table_preview",
    with_views(
        """SELECT fiscal_year, '| segment_name | order_count |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CASE WHEN trim(segment_name) = '' THEN '''''' ELSE segment_name END || ' | ' || CAST(order_count AS VARCHAR) || ' |', chr(10) ORDER BY rk) AS preview
        FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY segment_name) AS rk FROM segment_year) WHERE rk <= 10 GROUP BY fiscal_year""",
        "segment_year",
    ),
)
def markdown_table_preview(spark, sf_dir):
    return C.markdown_table_preview(spark_view(spark, sf_dir, "segment_year"), ["fiscal_year"], ["segment_name"], ["segment_name", "order_count"])


@register(
    "table_to_markdown",
    """WITH g AS (SELECT n_regionkey, string_agg('| ' || trim(n_name) || ' | ' || CAST(n_nationkey AS VARCHAR) || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || body AS markdown FROM g""",
)
def table_to_markdown(spark, sf_dir):
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string"), F.lit("too wide")).alias("cells"))
    blank = F.array(F.array(F.lit(" "), F.lit(None).cast("string")))
    rows = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"]).alias("cells"))
    return rows.select("n_regionkey", C.table_to_markdown(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), blank, F.col("cells"))).alias("markdown"))


@register("json_field_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    got = F.from_json("props", "k long, result struct<k: long>")
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(got["result"]["k"], got["k"]).alias("k"))


@register("artifact_sink", "SELECT 'run-1' AS run_id, c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def artifact_sink(spark, sf_dir):
    """The customers written as JSON lines of a run into the shared folder, and read back."""
    from lodestrata.functions.cut import shared_folder
    from lodestrata.sources.tables import read_artifact, write_artifact

    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")
    path = f"{shared_folder(spark)}/artifact-{uuid.uuid4().hex}"
    write_artifact(rows, path, "run-1", "json")
    return read_artifact(spark, path, rows.schema, "json")


_CATALOG = TABLES


@register("table_catalog_build", " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns" for t in _CATALOG))
def table_catalog_build(spark, sf_dir):
    from lodestrata.sources.tables import catalog

    return catalog({t: load(spark, sf_dir, t) for t in _CATALOG})


@register(
    "typed_csv_scan",
    """SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation, round(c_acctbal, 2) AS balance, nullif(trim(c_mktsegment), '') AS segment FROM customer""",
)
def typed_csv_scan(spark, sf_dir):
    from lodestrata.sources.tables import typed_rows

    lines = load(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2), "c_mktsegment", F.lit("overflow")).alias("line"))
    return typed_rows(lines, "line", "id long, name string, nation int, balance double, segment string")


@register(
    "corpus_validation",
    """SELECT 'unique_doc_ids' AS check_id, CASE WHEN count(*) = count(DISTINCT doc_id) THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) AS details FROM documents
    UNION ALL SELECT 'text_present', CASE WHEN count(*) FILTER (text IS NULL) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (text IS NULL) FROM documents
    UNION ALL SELECT 'length_matches', CASE WHEN count(*) FILTER (length(text) <> n_chars) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (length(text) <> n_chars) FROM documents
    UNION ALL SELECT 'table_not_empty', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END, count(*) FROM documents
    UNION ALL SELECT 'labels_have_documents', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
)
def corpus_validation(spark, sf_dir):
    from lodestrata.sources.tables import validate

    return validate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register(
    "asset_catalog",
    """SELECT 'page:' || CAST(page_id AS VARCHAR) AS asset_id, list_extract(string_split(url, '/'), -1) AS filename, CASE WHEN url LIKE '%.pdf' THEN 'application/pdf' WHEN url LIKE '%.csv' THEN 'text/csv' ELSE 'text/html' END AS media_type, 'document' AS kind FROM pages
    UNION ALL SELECT 'dataset:' || source, source || '.csv', 'text/csv', 'dataset' FROM (SELECT DISTINCT source FROM documents)""",
)
def asset_catalog(spark, sf_dir):
    from lodestrata.sources.tables import media_type

    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("asset_id"), F.element_at(F.split("url", "/"), -1).alias("filename"), media_type(F.col("url")).alias("media_type"), F.lit("document").alias("kind"))
    name = F.concat("source", F.lit(".csv"))
    sets = load(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("dataset:"), "source").alias("asset_id"), name.alias("filename"), media_type(name).alias("media_type"), F.lit("dataset").alias("kind"))
    return pages.unionByName(sets)
