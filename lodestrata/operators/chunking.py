"""Pages, sections, chunks and the records made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import clean_text, stripped

HEADER = r"^([0-9]+\.\s+.+|Appendix\s+[A-Z]\.\s+.+)$"


def page_stitch(pages: DataFrame, doc: str, page: str, marker: Column, text: str) -> DataFrame:
    """document_id, page_count, character_count, text: the cleaned pages of a document under their markers, in order."""
    body = F.concat(marker, F.lit("\n\n"), clean_text(F.col(text)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("b"))))
    rows = pages.groupBy(F.col(doc).alias("document_id")).agg(F.count("*").alias("page_count"), stripped(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n")).alias("text"))
    return rows.withColumn("character_count", F.length("text").cast("long"))


#: Side of the smallest grid cells; a rectangle lies in at most four cells of its level, whose cells have a side of CELL * 2 ** level.
CELL = 32.0


def _celled(rects: DataFrame, most: int) -> DataFrame:
    """A row for each cell that a rectangle touches, from its own level up to ``most``: own, level, cx, cy."""
    a, z = lambda c: F.least(f"{c}0", f"{c}1"), lambda c: F.greatest(f"{c}0", f"{c}1")
    rows = rects.withColumn("own", _level()).withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(most))))
    for c in ("x", "y"):
        side = F.lit(CELL) * F.pow(F.lit(2.0), F.col("level"))
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(F.floor(a(c) / side), F.floor(z(c) / side))))
    return rows


def _level() -> Column:
    size = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(CELL)) / CELL))).cast("int")


def meeting(blocks: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """The keys of blocks that meet a box of their document: an equi-join on the cells of a grid. A pair is compared at the coarser
    one of its levels, where each has at most four cells, so neither many small rectangles nor a few that cover a page are compared with all others."""
    corners = ["x0", "y0", "x1", "y1"]
    whole = F.forall(F.array(*corners), lambda v: v.isNotNull() & (F.abs(v) < 1e12))
    b = blocks.select("doc_id", *[k for k in key if k != "doc_id"], *corners).filter(whole)
    t = boxes.select("doc_id", *corners).filter(whole).distinct()
    most = max(r[0] or 0 for df in (b, t) for r in df.agg(F.max(_level())).collect())  # one number a side
    left = _celled(b, most).alias("b")
    right = _celled(t, most).withColumnsRenamed({c: f"t_{c}" for c in [*corners, "own"]}).alias("t")
    met = (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("y0") < F.col("t_y1")) & (F.col("y1") > F.col("t_y0"))
    pairs = left.join(right.hint("merge"), ["doc_id", "level", "cx", "cy"]).filter((F.greatest("own", "t_own") == F.col("level")) & met)
    return pairs.select(*key).distinct()


def layout_block_filter(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text blocks that meet no table box of their document, with their place in reading order. A block with an unknown corner meets none."""
    order = W.partitionBy("doc_id").orderBy("y0", "x0", "line_no")
    met = meeting(blocks, boxes, ["doc_id", "line_no"])
    return blocks.join(met.hint("merge"), ["doc_id", "line_no"], "left_anti").withColumn("reading_order", F.row_number().over(order))


def section_split(lines: DataFrame) -> DataFrame:
    """lines: doc_id, page, line_no, line -> sections: doc_id, section_index, section_title, page_start, page_end, text.

    A header line opens a section, except on a page that begins with ``Contents``; what stands before the first is the overview.
    """
    order = W.partitionBy("doc_id").orderBy("page", "line_no")
    first = F.first(stripped(F.col("line"))).over(W.partitionBy("doc_id", "page").orderBy("line_no"))
    marked = lines.withColumn("contents", first.startswith("Contents")).withColumn("bare", stripped(F.col("line")))
    marked = marked.withColumn("is_header", F.col("bare").rlike(HEADER)).filter(~(F.col("contents") & F.col("is_header")))
    marked = marked.withColumn("section_index", F.sum(F.col("is_header").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("page", "line_no", F.when(F.col("is_header"), F.col("bare")).otherwise(F.col("line")).alias("line"))))
    rows = marked.groupBy("doc_id", "section_index").agg(
        F.coalesce(F.max(F.when(F.col("is_header"), F.col("bare"))), F.lit("Document Overview")).alias("section_title"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        stripped(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("text"),
    )
    return rows.filter("text <> ''")


def windows(rows: DataFrame, text: str, size: int, overlap: int, index: str, piece: str) -> DataFrame:
    """One row for each window of ``size`` characters, the next one ``size - overlap`` further."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int"))
    return rows.withColumn(index, F.explode(F.sequence(F.lit(0), n - 1))).withColumn(piece, F.expr(f"substring({text}, {step} * {index} + 1, {size})"))


def chunk_parent_child(docs: DataFrame, parent=(1500, 200), child=(400, 50)) -> DataFrame:
    """Parent windows of a document's text and the child windows inside each."""
    rows = windows(docs, "text", *parent, "parent_index", "parent_text")
    rows = rows.withColumn("parent_id", F.concat(F.col("doc_id").cast("string"), F.lit("_par"), F.col("parent_index").cast("string")))
    rows = windows(rows.drop("text"), "parent_text", *child, "child_index", "child_text")
    return rows.withColumn("child_id", F.concat("parent_id", F.lit("_ch"), F.col("child_index").cast("string")))


def table_chunks(tables: DataFrame) -> DataFrame:
    """tables: doc_id, table_index, markdown, header, row_count, column_count -> a parent with one child for each table that is not empty."""
    parent = F.concat(F.col("doc_id").cast("string"), F.lit("_table"), F.col("table_index").cast("string"))
    return tables.filter(F.trim("markdown") != "").select("doc_id", parent.alias("parent_id"), F.concat(parent, F.lit("_ch0")).alias("child_id"), F.col("markdown").alias("child_text"), F.col("markdown").alias("parent_text"), F.lit("table").alias("content_type"), "header", "row_count", "column_count")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document the numbers of its parents and children. One aggregate; a parent is counted at its first child."""
    return chunks.groupBy("doc_id").agg(F.sum((F.col("child_index") == 0).cast("long")).alias("parent_chunk_count"), F.count("*").alias("child_chunk_count"))


def embedding_records(chunks: DataFrame) -> DataFrame:
    """record_id, source_chunk_id, parent_id, content_type, text_hash of every child."""
    digest = F.substring(F.sha2("child_text", 256), 1, 16)
    kind = F.coalesce("content_type", F.lit("text")) if "content_type" in chunks.columns else F.lit("text")
    return chunks.select(F.concat_ws("_", "child_id", digest).alias("record_id"), F.col("child_id").alias("source_chunk_id"), "parent_id", kind.alias("content_type"), digest.alias("text_hash"))


def graph_input_package(chunks: DataFrame, title: str) -> DataFrame:
    """Per parent: its children in order, their number, and the text to extract from, under the title unless it begins with it."""
    ids = F.array_sort(F.collect_list(F.struct("child_index", "child_id")))
    rows = chunks.groupBy("parent_id").agg(F.first(title).alias("title"), F.first("parent_text").alias("parent_text"), F.transform(ids, lambda x: x["child_id"]).alias("ids"))
    text = F.when(F.col("parent_text").startswith(F.col("title")), F.col("parent_text")).otherwise(F.concat("title", F.lit("\n\n"), "parent_text"))
    return rows.select("parent_id", F.array_join("ids", "|").alias("source_child_ids"), F.size("ids").alias("source_child_count"), F.md5(text).alias("text_md5"), F.length(text).alias("text_length"))


def table_to_markdown(rows: Column) -> Column:
    """array<array<string>> -> markdown: rows that are blank go, the first is the header, the others get its width."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    full = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    width = F.size(F.element_at(full, 1))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fitted = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)
    body = F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), lambda r: line(fitted(r)))
    head = F.array(line(F.element_at(full, 1)), line(F.array_repeat(F.lit("---"), width)))
    return F.when(F.size(full) == 0, F.lit("")).otherwise(F.array_join(F.concat(head, body), "\n"))


def markdown_cell(value: Column) -> Column:
    text = F.regexp_replace(value.cast("string"), r"\n", " ")
    return F.when(value.isNull(), "null").when(F.trim(text) == "", "''").otherwise(text)


def markdown_table_preview(rows: DataFrame, group: list[str], order: list[str], columns: list[str], n: int = 10) -> DataFrame:
    """Per group a markdown table of its first n rows in the given order. The limit is the preview's size."""
    first = rows.withColumn("_rk", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_rk") <= n)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rk", line.alias("l")))), lambda x: x["l"])
    head = f"| {' | '.join(columns)} |\n| {' | '.join(['---'] * len(columns))} |\n"
    return first.groupBy(*group).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("preview"))
