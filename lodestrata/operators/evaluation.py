"""Checks of answers and comparisons with gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.cut import settled
from lodestrata.operators.retrieval import top_k

#: Up to so many cleaned values (some 100 bytes each) are broadcast.
FEW_VALUES = 100_000


def first_distinct(rows: DataFrame, keys: list[str], text: str, order: str, n: int) -> DataFrame:
    """The first n texts of each key, trimmed, without blanks, each once whatever its case. The limit is the feature."""
    rows = rows.withColumn(text, F.trim(text)).filter(F.col(text) != "")
    one = rows.groupBy(*keys, F.lower(text).alias("_low")).agg(F.min(order).alias(order), F.min_by(text, order).alias(text))
    return top_k(one, keys, [F.col(order)], n, "n").drop("_low", order)


def reflection_checks(rows: DataFrame) -> DataFrame:
    """rows: inline, used, known (arrays of fact ids): how many are missing inline, not declared, not known."""
    n = {"missing_inline": F.size(F.array_except("used", "inline")), "inline_not_declared": F.size(F.array_except("inline", "used")), "unknown_used": F.size(F.array_except("used", "known"))}
    rows = rows.withColumns(n)
    return rows.withColumn("needs_correction", (F.col("missing_inline") > 0) | (F.col("inline_not_declared") > 0) | (F.col("unknown_used") > 0))


def critique_issues() -> Column:
    """Issues over the columns of ``reflection_checks``."""
    rules = [("missing_inline", "missing_inline_citations"), ("inline_not_declared", "citation_fact_mismatch"), ("unknown_used", "unknown_fact")]
    return F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(name)) for c, name in rules]))


def prior_context(ranked: DataFrame, question: Column, rows: int = 3, edges: int = 5, characters: int = 800) -> DataFrame:
    """For each sub-query what the earlier ones of the same question found, by source: the first table rows, the first graph facts, and the
    beginning of the texts. A row for each sub-query of a question enters its window."""
    nth = F.row_number().over(W.partitionBy("sub_query_id", "source_type").orderBy("answer_rank"))
    most = F.when(F.col("source_type") == "sql_structured", rows).when(F.col("source_type") == "graph_relationships", edges)
    some = ranked.withColumn("n", nth).filter(most.isNull() | (F.col("n") <= most))
    item = F.when(most.isNull(), F.col("summary")).otherwise(F.col("fact_id"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda x: x["x"]), ";")
    each = some.groupBy("sub_query_id", "source_type").agg(in_order.alias("text"))
    each = each.withColumn("text", F.concat("source_type", F.lit("="), F.when(most.isNull(), F.substring("text", 1, characters)).otherwise(F.col("text"))))
    one = each.groupBy("sub_query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_type", "text"))), lambda x: x["text"]), " / ").alias("found"))
    before = W.partitionBy(question).orderBy("sub_query_id").rowsBetween(W.unboundedPreceding, -1)
    return one.select("sub_query_id", F.array_join(F.collect_list("found").over(before), "|").alias("prior"))


def retrieval_eval(texts: DataFrame, want: DataFrame) -> DataFrame:
    """texts: query_id, child_id, child_text of the matches (a few a query); want: query_id, terms."""
    found = texts.groupBy("query_id").agg(F.count("*").alias("hits"), (F.count("*") - F.count_distinct("child_id")).alias("duplicates"), F.lower(F.array_join(F.collect_list("child_text"), " ")).alias("found"))
    got = want.join(found.hint("merge"), "query_id")
    return got.select("query_id", "hits", "duplicates", F.size(F.filter("terms", lambda t: F.col("found").contains(t))).cast("long").alias("terms_found"))


def _differences(a: DataFrame, b: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """missing_rows (of b), extra_rows: as multisets of rows in the columns, in one shuffle of both sides."""
    kinds = dict(a.dtypes) | dict(b.dtypes)
    cut = lambda df, n: df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns], F.lit(n).alias("_n"))
    left = cut(a, 1).unionByName(cut(b, -1)).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return left.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("missing_rows"), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("extra_rows"))


def _placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row of a result that is ordered by the columns (each ``name`` or ``name desc``); rows that tie are told apart by their other columns."""
    from lodestrata.operators.graph import numbered

    signs = df.withColumn("_order", F.struct(*[_rank(df, c) for c in order], *[F.col(c).alias(f"_o{c}") for c in df.columns]))
    return numbered(signs, ["_order"], name).drop("_order")


def _rank(df: DataFrame, by: str) -> Column:
    column, _, way = by.partition(" ")
    if way and not dict(df.dtypes)[column].startswith(("double", "float", "int", "bigint", "decimal")):
        raise ValueError("a descending order is of numbers")
    return (-F.col(column) if way else F.col(column)).alias(f"_r{column}")


def result_compare(actual: DataFrame, expected: DataFrame, order: tuple[list[str], list[str]] | None = None, digits: int = 4) -> DataFrame:
    """One row: how an actual result compares with an expected one, doubles rounded.

    Without ``order`` as multisets of rows; with it (what the actual and what the expected result is ordered by) place by place, by
    row numbers over ranges. missing_rows and extra_rows are in the expected columns, that is of the projected result; with columns missing they
    are null. A result passes strictly if columns, their order and rows are the same, and as an answer if its projection is.
    """
    missing = [c for c in expected.columns if c not in actual.columns]
    extra = [c for c in actual.columns if c not in expected.columns]
    counts = actual.agg(F.count("*").alias("actual_row_count")).join(F.broadcast(expected.agg(F.count("*").alias("expected_row_count"))))
    place = []
    if order is not None:
        actual, expected, place = _placed(actual, order[0], "_place"), _placed(expected, order[1], "_place"), ["_place"]
    columns = [c for c in expected.columns if c not in place]
    if missing:
        found = counts.select("*", F.lit(None).cast("long").alias("missing_rows"), F.lit(None).cast("long").alias("extra_rows"))
    else:
        found = counts.join(F.broadcast(_differences(expected, actual, [*columns, *place], digits)))
    same_columns = [c for c in actual.columns if c not in place] == columns
    projected = F.coalesce((F.col("missing_rows") == 0) & (F.col("extra_rows") == 0), F.lit(False))
    return found.select(
        F.lit(same_columns).alias("same_columns"), F.lit("|".join(missing)).alias("missing_columns"), F.lit("|".join(extra)).alias("extra_columns"), "missing_rows", "extra_rows", projected.alias("projected_rows_match"),
        (F.lit(same_columns) & projected).alias("strict_passed"), projected.alias("answer_passed"), "actual_row_count", "expected_row_count",
    )


def routing_eval(routes: DataFrame, must: list[str], must_not: list[str]) -> DataFrame:
    """routes: query_id, sources -> how many sources are missing or forbidden."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    missing, forbidden = F.size(F.array_except(arr(must), "sources")), F.size(F.array_intersect(F.col("sources"), arr(must_not)))
    return routes.select("query_id", missing.cast("long").alias("missing"), forbidden.cast("long").alias("forbidden"), ((missing == 0) & (forbidden == 0)).alias("passed"))


def set_recall(gold: DataFrame, found: DataFrame, case: str, item: list[str]) -> DataFrame:
    """case, expected, actual, matched: how many distinct items of a case the gold table has, the prediction has, and both. Cases of either."""
    one = lambda df, name: df.select(case, *item).distinct().withColumn(name, F.lit(1))
    both = one(gold, "_g").join(one(found, "_f").hint("merge"), [case, *item], "full")
    return both.groupBy(case).agg(F.count("_g").alias("expected"), F.count("_f").alias("actual"), F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("matched"))


def triple(source: str, relation: str, target: str, clean) -> list[Column]:
    """A relation as it is compared: the ends by their cleaned names, the type in lower case."""
    return [clean(F.col(source)).alias("source"), F.lower(F.trim(relation)).alias("relation_type"), clean(F.col(target)).alias("target")]


def graph_eval(cases: DataFrame, nodes: DataFrame, relations: DataFrame, top_nodes: DataFrame, top_edges: DataFrame, clean) -> DataFrame:
    """cases: case; gold nodes (case, name) and relations (case, source, relation_type, target) against what was retrieved: nodes and the ends of
    edges count as nodes. A case passes if all of its nodes and relations are there."""
    ends = top_edges.select("case", F.explode(F.array("source", "target")).alias("name"))
    said = top_nodes.select("case", "name").union(ends)
    names = lambda df: df.select("case", clean(F.col("name")).alias("name"))
    triples = lambda df: df.select("case", *triple("source", "relation_type", "target", clean))
    n = set_recall(names(nodes), names(said), "case", ["name"]).select("case", F.col("expected").alias("expected_node_count"), F.col("matched").alias("node_hit_count"))
    r = set_recall(triples(relations), triples(top_edges), "case", ["source", "relation_type", "target"]).select("case", F.col("expected").alias("expected_relation_count"), F.col("matched").alias("relation_hit_count"))
    got = cases.select("case").join(n.hint("merge"), "case", "left").join(r.hint("merge"), "case", "left").na.fill(0)
    return got.withColumn("passed", (F.col("node_hit_count") == F.col("expected_node_count")) & (F.col("relation_hit_count") == F.col("expected_relation_count")))


def _once_cleaned(rows: DataFrame, column: str, clean) -> DataFrame:
    """_raw, _clean: the distinct values of a column, each cleaned once, to be joined to rows; up to FEW_VALUES are broadcast."""
    values = settled(rows.select(F.col(column).alias("_raw")).distinct())
    made = settled(values.select("_raw", clean(F.col("_raw")).alias("_clean")))
    return F.broadcast(made) if made.count() <= FEW_VALUES else made.hint("merge")


def cleaned(rows: DataFrame, clean, *columns: str) -> DataFrame:
    """The rows with cleaned values of the columns, for values that repeat often."""
    for c in columns:
        rows = rows.join(_once_cleaned(rows, c, clean), F.col(c).eqNullSafe(F.col("_raw")), "left").withColumn(c, F.col("_clean")).drop("_raw", "_clean")
    return rows


def numbered_names(names: DataFrame, clean) -> DataFrame:
    """name, id: the distinct names, with one number for those that are cleaned alike; 0 for what is blank then, null has none."""
    from lodestrata.operators.graph import numbered

    made = settled(names.select("name").distinct().filter("name is not null").withColumn("_clean", clean(F.col("name"))))
    ids = numbered(made.select("_clean").distinct(), ["_clean"], "id")
    return settled(made.join(ids.hint("merge"), "_clean").select("name", F.when(F.col("_clean") == "", 0).otherwise(F.col("id")).alias("id")))


def extraction_eval(gold_entities: DataFrame, gold_relations: DataFrame, entities: DataFrame, relations: DataFrame, passages: DataFrame, clean) -> DataFrame:
    """Precision, recall and grounding of extracted entities (case, name, evidence, ord) and relations (case, source, relation_type, target, evidence, ord)
    against gold ones, and their weighted quality. Of equal extractions the first counts; one is grounded if its evidence is in the case's passage (case, text). A
    share of nothing is 0."""
    lower = F.lower(F.trim("relation_type"))
    entities = cleaned(entities.select("case", "name", "evidence", "ord"), clean, "name").filter("name <> ''")
    relations = cleaned(relations.select("case", "source", lower.alias("relation_type"), "target", "evidence", "ord"), clean, "source", "target")
    gold_entities = cleaned(gold_entities.select("case", "name"), clean, "name")
    gold_relations = cleaned(gold_relations.select("case", "source", lower.alias("relation_type"), "target"), clean, "source", "target")

    def items(df: DataFrame, kind: str, gold: bool) -> DataFrame:
        of = {"source": "name"} if kind == "entity" else {}
        has = lambda c: F.col(of.get(c, c)) if of.get(c, c) in df.columns else F.lit(None).cast("string" if c != "ord" else dict(entities.dtypes)["ord"])
        flag = lambda yes: F.lit(1 if yes else None).cast("int")
        return df.select("case", F.lit(kind).alias("kind"), *[has(c).alias(c) for c in ("source", "relation_type", "target", "evidence", "ord")], flag(gold).alias("_g"), flag(not gold).alias("_f"))

    every = items(gold_entities, "entity", True).unionByName(items(gold_relations, "relation", True)).unionByName(items(entities, "entity", False)).unionByName(items(relations, "relation", False))
    return extraction_scores(every, entities.select("evidence").union(relations.select("evidence")), passages, clean)


def extraction_scores(items: DataFrame, evidence: DataFrame, passages: DataFrame, clean) -> DataFrame:
    """``extraction_eval`` of items that can be compared as they are: case, kind (entity or relation), source (of an entity its name), relation_type, target, and evidence and
    ord of those found; _g and _f are 1 for gold and for found ones, else null. evidence: all pieces of evidence of the items.

    Gold and found items of both kinds meet in one grouping. If items and passages are dealt out by case already, nothing of them moves again."""
    item = ["source", "relation_type", "target"]
    first = F.struct(F.isnull("ord").alias("a"), F.col("ord").alias("b"), F.isnull("evidence").alias("c"), F.col("evidence").alias("d"))  # unknown ones last
    groups = items.groupBy("case", "kind", *item).agg(F.max("_g").alias("_g"), F.max("_f").alias("_f"), F.min_by("evidence", F.when(F.col("_f") == 1, first)).alias("evidence"))
    told = F.col("source").isNotNull() & ((F.col("kind") == "entity") | (F.col("relation_type").isNotNull() & F.col("target").isNotNull()))
    both = F.col("case").isNotNull() & told & F.col("_g").isNotNull() & F.col("_f").isNotNull()  # a null is like nothing
    per = groups.groupBy("case", "kind", "evidence").agg(F.count("_g").alias("_g"), F.count("_f").alias("_f"), F.count_if(both).alias("_both"))
    per = per.join(_once_cleaned(evidence, "evidence", clean), F.col("evidence").eqNullSafe(F.col("_raw")), "left").withColumn("said", F.coalesce("_clean", F.lit("")))
    # all passages of a case, of which there is one as a rule
    texts = passages.select("case", clean(F.col("text")).alias("text")).groupBy("case").agg(F.collect_list("text").alias("texts"))
    in_texts = F.size(F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: (F.col("said") != "") & t.contains(F.col("said"))))
    per = per.join(texts.hint("merge"), "case", "left").withColumn("_grounded", in_texts * F.col("_f"))
    sums = {"expected": "_g", "actual": "_f", "matched": "_both", "grounded": "_grounded"}
    kinds = ["entity", "relation"]
    # an unknown case is none that both kinds share
    apart = F.when(F.col("case").isNull(), F.col("kind")).alias("_apart")
    counts = per.groupBy("case", apart).agg(*[F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{k}_{n}") for k in kinds for n, c in sums.items()])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    shares = {f"{k}_{n}": share(f"{k}_{a}", f"{k}_{b}") for k in kinds for n, a, b in (("precision", "matched", "actual"), ("recall", "matched", "expected"), ("grounding_precision", "grounded", "actual"))}
    out = counts.select("case", *[F.col(f"{k}_{n}").alias(f"{n}_{k}_count") for k in kinds for n in ("expected", "actual")], *[c.alias(n) for n, c in shares.items()])
    #: The weights of the quality score.
    weights = [("entity_recall", 0.30), ("relation_recall", 0.25), ("entity_precision", 0.15), ("relation_precision", 0.10), ("entity_grounding_precision", 0.10), ("relation_grounding_precision", 0.10)]
    quality = sum((F.col(c) * w for c, w in weights[1:]), F.col(weights[0][0]) * weights[0][1])
    out = out.withColumn("quality_score", quality)
    return out.select("case", *[c for c in out.columns if c.endswith("_count")], *[F.round(F.round(c, 12), 4).alias(c) for c in out.columns if c.endswith(("_precision", "_recall", "_score"))])


def field_checks(rows: DataFrame, fields: list[str], gold: str = "gold_") -> DataFrame:
    """Whether each field equals the gold field of its name, two nulls too, and whether all do."""
    same = {f"{f}_ok": F.col(f).eqNullSafe(F.col(f"{gold}{f}")) for f in fields}
    return rows.withColumns(same).withColumn("passed", F.forall(F.array(*[F.col(c) for c in same]), lambda x: x))


def list_checks(rows: DataFrame, actual: str, expected: str, name: str) -> DataFrame:
    """Adds missing{name} and extra{name}: the expected items that are not among the actual ones, and the reverse, in their order, repeated ones too."""
    without = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    return rows.withColumns({f"missing{name}": without(F.col(expected), F.col(actual)), f"extra{name}": without(F.col(actual), F.col(expected))})
