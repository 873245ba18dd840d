"""Entity mentions to a validated graph, and retrieval and views over it.

Nodes have a key (``name_key``); edges are directed (source_key, relation_type, target_key). A popular
entity may have a third of all mentions: what is gathered of a node (aliases, evidence, pages) is
made distinct in a first aggregate, so a group never holds more than a node's different values.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.cut import settled, spread
from lodestrata.functions.text import clean_name, graph_text, graph_tokens, name_key, words
from lodestrata.operators.retrieval import top_k

#: Up to so many nodes (some 50 bytes each) are broadcast.
FEW_NODES = 100_000
#: A token that more nodes, or more edges, than this have is common: it alone does not lead from a query to each of them.
FEW_SHARERS = 16
#: Phrases of so many characters in all go into one automaton that is broadcast (some 100 bytes a character at most).
PHRASE_CHARACTERS = 1_000_000
#: The entity and relation types of the graph.
HIGH_VALUE_TYPES = ["organization", "segment", "product_or_service", "technology_or_platform", "regulatory_or_external_body", "geography"]
CONDITIONAL_TYPES = ["initiative_or_strategy", "risk_or_issue", "financial_or_business_concept", "time_period", "other"]
RELATION_TYPES = ["includes", "integrates", "invests_in", "supports", "faces", "uses", "positions_as", "depends_on"]


def _number(rows: DataFrame) -> Column:
    """How many mentions a group has; a row with n stands for so many."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def mention_groups(mentions: DataFrame) -> DataFrame:
    """Equal mentions in one row with their number n and first ord: each name is cleaned once."""
    what = [c for c in ("name", "entity_type", "evidence", "section_title", "page_start", "page_end") if c in mentions.columns]
    # written, as a filter on cleaned names would else be pushed below the grouping, to every mention
    groups = settled(mentions.groupBy(*what).agg(_number(mentions).alias("n"), F.min("ord").alias("ord")))
    if what == ["name"]:
        return kept_mentions(groups)
    return groups.join(kept_mentions(settled(groups.select("name").distinct())).hint("merge"), "name")


def kept_keys(mentions: DataFrame) -> DataFrame:
    """The distinct keys of the mentions that are kept."""
    return kept_mentions(settled(mentions.select("name").distinct())).select("key").distinct()


def kept_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with key and clean name, without those whose key is empty, one character, or begins like a heading."""
    rows = mentions.withColumn("key", name_key(F.col("name"))).withColumn("clean", clean_name(F.col("name")))
    return rows.filter((F.length("key") > 1) & ~F.col("key").startswith("section ") & ~F.col("key").startswith("table "))


def canonical_names(kept: DataFrame) -> DataFrame:
    """key, canonical_name: the most frequent clean name, then the shortest, then the first in lower case. kept: key, clean, n."""
    counts = kept.filter("clean <> ''").groupBy("key", "clean").agg(F.sum("n").alias("n"))
    best = F.min_by("clean", F.struct((-F.col("n")).alias("a"), F.length("clean").alias("b"), F.lower("clean").alias("c"), F.col("clean").alias("d")))
    return counts.groupBy("key").agg(best.alias("canonical_name"))


def _in_order(kept: DataFrame, value: Column, name: str) -> DataFrame:
    """key and the distinct values in order of first mention, joined by |."""
    each = kept.groupBy("key", value.alias("v")).agg(F.min("ord").alias("o"))
    return each.groupBy("key").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"])).alias(name))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """key, canonical_name, entity_type (the least of those seen), mention_count, aliases, evidence, sections, page_ranges. What the mentions do
    not have (all but name, n and ord may be missing), the nodes do not have either."""
    kept = settled(mention_groups(mentions))
    kind = [F.min("entity_type").alias("entity_type")] if "entity_type" in kept.columns else []
    base = kept.groupBy("key").agg(F.sum("n").alias("mention_count"), *kind, F.min("ord").alias("first_ord"))
    pages = F.concat_ws("-", "page_start", "page_end")
    named = settled(canonical_names(kept))
    aliases = kept.groupBy("key", "clean", "name").agg(F.min("ord").alias("ord")).join(named.hint("merge"), "key").filter("name <> canonical_name")
    out = base.join(named.hint("merge"), "key").join(_in_order(aliases, F.col("name"), "aliases").hint("merge"), "key", "left")
    for column, value, name in (("evidence", F.col("evidence"), "evidence"), ("section_title", F.col("section_title"), "sections"), ("page_end", pages, "page_ranges")):
        if column in kept.columns:
            out = out.join(_in_order(kept, value, name).hint("merge"), "key")
    return out.withColumn("aliases", F.coalesce("aliases", F.lit("")))


def keyed_relations(relations: DataFrame) -> DataFrame:
    """Equal relations in one row with source_key, target_key, their number n and first ord, and evidence if they have it."""
    evidence = [c for c in ("evidence",) if c in relations.columns]
    return _keyed_ends(relations.groupBy("source", "relation_type", "target", *evidence).agg(_number(relations).alias("n"), F.min("ord").alias("ord")))


def _keyed_ends(equal: DataFrame) -> DataFrame:
    """Relations with source_key and target_key, made once for each pair of names; a relation without a name goes."""
    equal = settled(equal)
    pairs = settled(equal.select("source", "target").distinct())
    keys = pairs.withColumns({"source_key": name_key(F.col("source")), "target_key": name_key(F.col("target"))})
    return equal.join(keys.hint("merge"), ["source", "target"])


def edge_groups(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """source_key, relation_type, target_key, mention_count, first_ord, and evidence_count if the relations have evidence; both ends are among the keys.
    relations: as they are, or of ``keyed_relations``."""
    evidence = [c for c in ("evidence",) if c in relations.columns]
    keyed = relations if "source_key" in relations.columns else keyed_relations(relations)
    grouped = keyed.groupBy("source_key", "relation_type", "target_key").agg(F.sum("n").alias("mention_count"), *[F.count_distinct(c).alias("evidence_count") for c in evidence], F.min("ord").alias("first_ord"))
    return grouped.join(keys.withColumnRenamed("key", "source_key").hint("merge"), "source_key", "left_semi").join(keys.withColumnRenamed("key", "target_key").hint("merge"), "target_key", "left_semi")


def graph_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_groups`` with edge_no (by first mention)."""
    return numbered(edge_groups(relations, settled(nodes.select("key"))), ["first_ord", "source_key", "relation_type", "target_key"], "edge_no")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 1) of each row in the order of the columns, which tell all rows apart. Ranges of rows are numbered alone, and a
    range starts after those before it; what is broadcast is a row for each range."""
    ranges = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_inside")).cast("int")).drop("_range", "_start", "_inside")


def node_reasons(name: Column, kind: Column, mentions: Column, evidence: Column) -> Column:
    """Why a node is rejected, in a fixed order."""
    n = F.size(words(name))
    rules = [
        (F.trim(name) == "", "empty_name"),
        (evidence == 0, "missing_evidence"),
        (n > 12, "name_too_long"),
        (~kind.isin(HIGH_VALUE_TYPES + CONDITIONAL_TYPES), "unsupported_entity_type"),
        (kind.isin(HIGH_VALUE_TYPES) & (mentions < 1), "missing_mentions"),
        ((kind == "initiative_or_strategy") & (mentions < 2) & (n > 4), "low_confidence_initiative"),
        ((kind == "risk_or_issue") & (mentions < 2) & (n > 5), "low_confidence_risk"),
        ((kind == "financial_or_business_concept") & (mentions < 2) & (n > 4), "low_confidence_business_concept"),
        ((kind == "time_period") & (mentions < 2), "low_value_time_period"),
        (kind == "other", "generic_other_type"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))


def edge_reasons(relation: Column, source_ok: Column, target_ok: Column, loop: Column, mentions: Column, evidence: Column) -> Column:
    rules = [
        (~relation.isin(RELATION_TYPES), "unsupported_relation_type"),
        (~source_ok, "invalid_source_node"),
        (~target_ok, "invalid_target_node"),
        (loop, "self_loop"),
        (evidence == 0, "missing_evidence"),
        (relation.isin("supports", "depends_on", "positions_as") & (mentions < 2), "weak_single_mention_relation"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))


def node_validate(nodes: DataFrame) -> DataFrame:
    r = node_reasons(F.col("canonical_name"), F.col("entity_type"), F.col("mention_count"), F.size(F.split("evidence", r"\|")))
    return nodes.withColumn("reasons", r).withColumn("valid", F.size("reasons") == 0)


def edge_validate(edges: DataFrame, checked: DataFrame) -> DataFrame:
    ok = settled(checked.filter("valid").select(F.col("key").alias("k"), F.lit(True).alias("ok")))
    rows = edges.join(ok.withColumnsRenamed({"k": "source_key", "ok": "s_ok"}).hint("merge"), "source_key", "left").join(ok.withColumnsRenamed({"k": "target_key", "ok": "t_ok"}).hint("merge"), "target_key", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    r = edge_reasons(F.col("relation_type"), yes("s_ok"), yes("t_ok"), F.col("source_key") == F.col("target_key"), F.col("mention_count"), F.col("evidence_count"))
    return rows.withColumn("reasons", r).withColumn("valid", F.size("reasons") == 0).drop("s_ok", "t_ok")


def load_stats(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """One row: how many validated nodes (key, canonical_name, valid) and edges (source_key, relation_type, target_key, valid) there are, how many of them are
    valid and so stored, their relation types, and the first k stored edges by the names of source, relation and target."""
    n = nodes.agg(F.count("*").alias("node_count"), F.count_if("valid").alias("stored_node_count"))
    e = edges.agg(F.count("*").alias("edge_count"), F.count_distinct("relation_type").alias("relation_types"), F.count_if("valid").alias("stored_edge_count"), F.count_distinct(F.when(F.col("valid"), F.col("relation_type"))).alias("stored_relation_types"))
    name = lambda end, c: nodes.select(F.col("key").alias(end), F.col("canonical_name").alias(c)).hint("merge")
    by = ["source", "relation_type", "target"]
    first = edges.filter("valid").join(name("source_key", "source"), "source_key").join(name("target_key", "target"), "target_key").select(*by).orderBy(*by).limit(k)
    first = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: F.concat_ws("|", *[x[c] for c in by])), ";").alias("first_edges"))
    return e.join(F.broadcast(n)).join(F.broadcast(first))


def rejection_counts(checked: DataFrame, kind: str) -> DataFrame:
    return checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "reason", "n")


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts: id (of any type), text; phrases: phrase, and others -> id and the columns of phrases for each phrase that a text contains. Empty phrases are in no text.

    Up to PHRASE_CHARACTERS the distinct phrases make one automaton, which is broadcast; a text is read once, and only hits leave the task.
    Beyond that the texts' substrings are joined to the phrases.
    """
    phrases = settled(phrases.filter("phrase <> ''"))
    distinct = phrases.select("phrase").distinct()
    size = distinct.agg(F.sum(F.length("phrase"))).first()[0] or 0
    if size > PHRASE_CHARACTERS:
        hits = _substrings(texts, phrases)
    else:
        hits = _automaton_hits(texts, [r.phrase for r in distinct.collect()])
    return hits.join(phrases.hint("merge"), "phrase")


def _automaton_hits(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """id, phrase: each phrase that a text contains, once. The automaton (goto, failure and output links) finds all phrases in one pass over a text."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select("id").schema)
    if not phrases:
        return texts.select("id", F.col("text").alias("phrase")).limit(0)
    machine = ahocorasick.Automaton()
    for x in phrases:
        machine.add_word(x, x)
    machine.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(machine)

    def scan(batches):
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                some = sorted({x for _, x in shared.value.iter(text)}) if text else []
                at.extend([i] * len(some))
                found.extend(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "phrase"])

    return texts.select("id", "text").mapInArrow(scan, f"{shape}, phrase string")


def _substrings(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, phrase by an equi-join with the texts' substrings of the lengths that phrases have. A text is few bytes and many substrings."""
    texts = spread(texts.select("id", "text"), "id")
    lengths = sorted(r[0] for r in phrases.select(F.length("phrase")).distinct().collect())
    starts = texts.filter("text <> ''").select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("start"))
    sizes = starts.select("*", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("size")).filter("start + size - 1 <= length(text)")
    parts = sizes.select("id", F.expr("substring(text, start, size)").alias("phrase"))
    return parts.join(phrases.select("phrase").distinct().hint("merge"), "phrase", "left_semi").distinct()


def named_in(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, key where the query's text contains the node's name or, if the nodes have aliases, one of them."""
    names = F.array(graph_text(F.col("canonical_name")))
    if "aliases" in nodes.columns:
        names = F.array_union(names, F.transform(F.split("aliases", r"\|"), graph_text))
    hits = contained(queries.select(F.col("query_id").alias("id"), graph_text(F.col("query_text")).alias("text")), nodes.select("key", F.explode(names).alias("phrase")))
    return hits.select(F.col("id").alias("query_id"), "key").distinct()


def _asked(queries: DataFrame) -> DataFrame:
    """query_id, q_tokens, q_norm; a query without a text finds nothing."""
    q = queries.select("query_id", F.array_distinct(graph_tokens(F.col("query_text"))).alias("q_tokens"), graph_text(F.col("query_text")).alias("q_norm"))
    return q.filter(F.col("q_norm").isNotNull())


def _told(few: bool):
    return F.broadcast if few else lambda df: df.hint("merge")


def _shared_tokens(rows: DataFrame, key: str, tokens: Column):
    """(key, token) of the tokens that up to FEW_SHARERS rows have, and the common ones in one column, token, ready to be joined."""
    has = settled(rows.select(key, F.explode(tokens).alias("token")).distinct())
    common = settled(has.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > FEW_SHARERS).select("token"))
    common = _told(common.count() <= FEW_NODES)(common)
    return has.join(common, "token", "left_anti"), common


def _with_common(rows: DataFrame, keys: list[str], tokens: Column, common: DataFrame) -> DataFrame:
    """The rows, which keys tell apart, with what of their tokens is common, in order."""
    some = rows.select(*keys, F.explode(tokens).alias("token")).join(common, "token", "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("common"))
    return rows.join(some.hint("merge"), keys, "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))


def _node_points(asked: str, phrase: Column | None = None) -> Column:
    """A node's score for the tokens asked. phrase: points for names in the text."""
    common = lambda c: F.size(F.array_intersect(asked, c))
    named = (F.lit(0.0) if phrase is None else phrase) + F.when(common("name_tokens") > 0, 0.5).otherwise(0.0)
    score = 2.0 * common("name_tokens") + 1.5 * common("alias_tokens") + 0.4 * common("evidence_tokens") + named + 0.1 * F.least("mention_count", F.lit(5))
    return F.round(score, 4)


def _best_nodes_first() -> list[Column]:
    return [F.col("score").desc(), F.col("mention_count").desc(), F.lower("canonical_name")]


def node_pairs(q: DataFrame, n: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """query_id, key: among them the k best nodes of every query, but not all nodes that share a common token with it.

    A node that shares a rarer token with the query, or is named in it, is a pair of its own. What any other has of the query are common tokens only, so its score
    is that of all nodes with the same common tokens, but for mentions: the k first of those stand for them, and the k best of these serve all queries
    with the same common tokens. Nodes left out are behind k others, whose score can only be higher for a query that also says something rarer of them.
    """
    parts = ["name_tokens", "alias_tokens", "evidence_tokens"]
    every = F.array_union(F.array_union(*parts[:2]), parts[2])
    rare, common = _shared_tokens(n, "key", every)
    alike = _with_common(n, ["key"], every, common).select("key", "canonical_name", "mention_count", *[F.array_sort(F.array_intersect(c, "common")).alias(c) for c in parts])
    first = settled(top_k(alike, parts, _best_nodes_first()[1:], k))
    q = settled(_with_common(q, ["query_id", "q_norm"], F.col("q_tokens"), common))
    kinds = q.select("common").distinct()
    met = kinds.select("common", F.explode("common").alias("token")).join(first.select("key", F.explode(every).alias("token")).hint("merge"), "token").select("common", "key")
    most = [r.key for r in first.orderBy(*_best_nodes_first()[1:]).limit(k).select("key").collect()]
    met = met.union(kinds.select("common", F.explode(F.array(*map(F.lit, most)).cast("array<string>")).alias("key"))).distinct()
    best = top_k(met.join(first.hint("merge"), "key").withColumn("score", _node_points("common")), ["common"], _best_nodes_first(), k)
    pairs = q.join(best.select("common", "key").hint("merge"), "common").select("query_id", "key")
    pairs = pairs.union(q.select("query_id", F.explode("q_tokens").alias("token")).join(rare.hint("merge"), "token").select("query_id", "key"))
    return pairs.union(named).distinct()


def node_topk(queries: DataFrame, nodes: DataFrame, k: int = 5, named: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rk. Tokens of a node's name, aliases and evidence count that are in the query, its whole name or an alias
    anywhere in the query's text, and its mentions, which alone give a score. named: of ``named_in``, if it is there already."""
    named = named_in(queries, nodes) if named is None else named
    n = nodes.select("key", "canonical_name", "mention_count", F.array_distinct(graph_tokens(F.col("canonical_name"))).alias("name_tokens"), F.array_distinct(graph_tokens(F.replace("aliases", F.lit("|"), F.lit(" ")))).alias("alias_tokens"), F.array_distinct(graph_tokens(F.array_join(F.slice(F.split("evidence", r"\|"), 1, 3), " "))).alias("evidence_tokens"), graph_text(F.col("canonical_name")).alias("norm"), F.filter(F.transform(F.split("aliases", r"\|"), graph_text), lambda x: x != "").alias("alias_norms"))
    n, q = settled(n), settled(_asked(queries))
    rows = node_pairs(q, n, named, k).join(q.hint("merge"), "query_id").join(n.hint("merge"), "key")
    phrase = F.when((F.col("norm") != "") & F.col("q_norm").contains(F.col("norm")), 3.0).otherwise(0.0) + F.when(F.exists("alias_norms", lambda a: F.col("q_norm").contains(a)), 2.0).otherwise(0.0)
    rows = rows.withColumn("score", _node_points("q_tokens", phrase)).filter("score > 0")
    return top_k(rows, ["query_id"], _best_nodes_first(), k).select("query_id", "key", "canonical_name", "mention_count", "score", "rk")


def neighborhood(edges: DataFrame, top: DataFrame) -> DataFrame:
    """The edges that touch any of a query's nodes, each once. Two equi-joins instead of a disjunction; an edge found by its target is left out where
    its source has found it, so that the edges (many for each query where a node is a hub) are not compared with one another."""
    some = settled(top.select("query_id", "key").distinct())
    few = some.count() <= FEW_NODES
    told = lambda df: F.broadcast(df) if few else df.hint("merge")
    by_source = edges.join(told(some.withColumnRenamed("key", "source_key")), "source_key").select("query_id", *edges.columns)
    by_target = edges.join(told(some.withColumnRenamed("key", "target_key")), "target_key").select("query_id", *edges.columns)
    return by_source.unionByName(by_target.join(told(some.withColumnRenamed("key", "source_key")), ["query_id", "source_key"], "left_anti"))


def edge_snippets(relations: DataFrame, k: int = 2) -> DataFrame:
    """source_key, relation_type, target_key, snippets: the k earliest distinct pieces of evidence of an edge, in order. Equal ones are merged first, and
    of the rest only k a task and edge are kept, so a hot edge stays small. relations: as they are, or of ``keyed_relations``."""
    edge = ["source_key", "relation_type", "target_key"]
    keyed = relations if "source_key" in relations.columns else keyed_relations(relations)
    each = keyed.filter("evidence is not null").groupBy(*edge, "evidence").agg(F.min("ord").alias("ord"))
    first = top_k(each, edge, [F.col("ord"), F.col("evidence")], k, "n")
    return first.groupBy(*edge).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence"))), lambda x: x["evidence"]).alias("snippets"))


def _best_edges_first() -> list[Column]:
    return [F.col("score").desc(), F.col("mention_count").desc(), F.col("edge_id")]


def edge_pairs(q: DataFrame, e: DataFrame, top: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """query_id, edge_no: among them the k best edges of every query, but not all edges of a hub.

    An edge of one of the query's nodes is a pair of its own if its other end is another of them or named in the query, or if it shares a rarer token with the query. What
    any other has of the query are common tokens only: of a node's edges with the same common tokens the k of most mentions stand for them, and the k best of these
    serve all queries that have the node and the same common tokens.
    """
    rare, common = _shared_tokens(e, "edge_no", F.col("tokens"))
    alike = _with_common(e.select("edge_no", "edge_id", "source_key", "target_key", "mention_count", "tokens"), ["edge_no"], F.col("tokens"), common).drop("tokens")
    ends = alike.withColumn("key", F.explode(F.array_distinct(F.array("source_key", "target_key"))))
    first = top_k(ends, ["key", "common"], _best_edges_first()[1:], k).select("key", "edge_no", "edge_id", "mention_count", F.col("common").alias("tokens"))
    asked = settled(_with_common(q, ["query_id", "q_norm"], F.col("q_tokens"), common))
    some = settled(top.join(asked.select("query_id", "common").hint("merge"), "query_id").select("query_id", "key", "common").distinct())
    met = some.select("common", "key").distinct().join(first.hint("merge"), "key")
    best = top_k(met.withColumn("score", _edge_points("common")), ["common", "key"], _best_edges_first(), k)
    pairs = some.join(best.select("common", "key", "edge_no").hint("merge"), ["common", "key"]).select("query_id", "edge_no")
    other = some.select("query_id", "key").union(named).distinct().withColumnRenamed("key", "other")
    both = some.select("query_id", "key").join(other.hint("merge"), "query_id")
    both = both.toDF("query_id", "source_key", "target_key").union(both.select("query_id", "other", "key")).distinct()
    pairs = pairs.union(both.join(e.select("source_key", "target_key", "edge_no").hint("merge"), ["source_key", "target_key"]).select("query_id", "edge_no"))
    said = asked.select("query_id", F.explode("q_tokens").alias("token")).join(rare.hint("merge"), "token").select("query_id", "edge_no").distinct()
    said = said.join(e.select("edge_no", F.explode(F.array("source_key", "target_key")).alias("key")).hint("merge"), "edge_no").join(some.select("query_id", "key").hint("merge"), ["query_id", "key"], "left_semi")
    return pairs.union(said.select("query_id", "edge_no")).distinct()


def _edge_points(asked: str, more: Column | None = None) -> Column:
    """An edge's score for the tokens asked. more: points for its ends."""
    score = 1.5 * F.size(F.array_intersect(asked, "tokens"))
    return F.round((score if more is None else score + more) + 0.2 * F.least("mention_count", F.lit(3)), 4)


def edge_topk(queries: DataFrame, edges: DataFrame, top: DataFrame, nodes: DataFrame, snippets: DataFrame, k: int = 8, named: DataFrame | None = None) -> DataFrame:
    """The best edges that touch a query's nodes. snippets: of ``edge_snippets``; their words count like those of the ends' names. named: of ``named_in``, if it is there already."""
    named = named_in(queries, nodes.select("key", "canonical_name")) if named is None else named
    name = nodes.select("key", "canonical_name")
    e = edges.join(snippets.hint("merge"), ["source_key", "relation_type", "target_key"], "left")
    e = e.join(name.withColumnsRenamed({"key": "source_key", "canonical_name": "s_name"}).hint("merge"), "source_key").join(name.withColumnsRenamed({"key": "target_key", "canonical_name": "t_name"}).hint("merge"), "target_key")
    told = F.flatten(F.transform(F.coalesce("snippets", F.array().cast("array<string>")), graph_tokens))
    tokens = F.array_union(F.array_union(graph_tokens(F.col("s_name")), graph_tokens(F.col("t_name"))), told)
    e = settled(e.select("edge_no", F.concat(F.lit("edge_"), F.col("edge_no").cast("string")).alias("edge_id"), "source_key", "relation_type", "target_key", "mention_count", "s_name", "t_name", graph_text(F.col("s_name")).alias("s_norm"), graph_text(F.col("t_name")).alias("t_norm"), tokens.alias("tokens")))
    q = settled(_asked(queries))
    top = settled(top.select("query_id", "key").distinct())
    tops = top.groupBy("query_id").agg(F.collect_set("key").alias("tops"))  # k keys at most
    rows = edge_pairs(q, e, top, named, k).join(q.join(tops.hint("merge"), "query_id").hint("merge"), "query_id").join(e.hint("merge"), "edge_no")
    said = lambda c: F.when((F.col(c) != "") & F.col("q_norm").contains(F.col(c)), 3.0).otherwise(0.0)
    at = lambda c: F.when(F.array_contains("tops", F.col(c)), 1.0).otherwise(0.0)
    rows = rows.withColumn("score", _edge_points("q_tokens", said("s_norm") + said("t_norm") + at("source_key") + at("target_key"))).filter("score > 0")
    return top_k(rows, ["query_id"], _best_edges_first(), k).select("query_id", "edge_id", "source_key", "relation_type", "target_key", "score", "rk", "s_name", "t_name")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, degree over undirected edges; a loop counts twice, a node without edges has 0."""
    ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    return nodes.select("key").join(ends.hint("merge"), "key", "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))


def hub(degree: DataFrame) -> DataFrame:
    return degree.orderBy(F.col("degree").desc(), "key").limit(1)


def hop_distance(edges: DataFrame, start: DataFrame) -> DataFrame:
    """key, hops from the start over undirected edges, for the nodes that can be reached, however far.

    A join for each hop, until no new node is found. A neighbour of nodes at distance h is at h - 1, h or h + 1, so only the last two
    rings are compared, and a ring of up to FEW_NODES nodes is broadcast.
    """
    both = settled(edges.select("source_key", "target_key").union(edges.select("target_key", "source_key")).toDF("a", "b").filter("a <> b").distinct())
    ring = settled(start.select("key", F.lit(0).alias("hops")).distinct())
    rings, last, hop, n = [ring], None, 0, ring.count()
    told = lambda df, n: F.broadcast(df) if n <= FEW_NODES else df.hint("merge")
    while n:
        hop += 1
        near = both.join(told(ring.select(F.col("key").alias("a")), n), "a").select(F.col("b").alias("key")).distinct()
        old = ring.select("key") if last is None else ring.select("key").union(last.select("key"))
        found = settled(near.join(told(old, n if last is None else n + m), "key", "left_anti").withColumn("hops", F.lit(hop)))
        last, ring, m, n = ring, found, n, found.count()
        rings.append(found)
        if len(rings) > 16:
            rings = [settled(reduce(DataFrame.unionByName, rings))]
    return reduce(DataFrame.unionByName, rings)


def hop_rings(hops: DataFrame, radius: float = 120.0) -> DataFrame:
    """Where a node stands on the ring of its distance: ring 3 holds all beyond two hops."""
    rows = numbered(hops.withColumn("ring", F.least("hops", F.lit(3))), ["ring", "key"], "_no")
    sizes = rows.groupBy("ring").agg(F.count("*").alias("_size"), F.min("_no").alias("_least"))  # four rows at most
    rows = rows.join(F.broadcast(sizes), "ring")
    angle = (F.col("_no") - F.col("_least")) / F.col("_size") * 2 * F.pi()
    return rows.select("key", "hops", "ring", angle.alias("_angle")).withColumns({"x": F.round(F.cos("_angle") * F.col("ring") * radius, 4), "y": F.round(F.sin("_angle") * F.col("ring") * radius, 4)}).drop("_angle")


def graph_search(nodes: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term: nodes whose name contains it, how many are in view (they and their neighbours), and the match of the shortest name."""
    names = nodes.select(F.struct("key", "canonical_name").alias("id"), F.lower("canonical_name").alias("text"))
    hit = settled(contained(names, terms.select("term", F.lower("term").alias("phrase")).distinct()).select("term", "id.key", "id.canonical_name"))
    near = edges.join(hit.select("term", F.col("key").alias("source_key")).hint("merge"), "source_key").select("term", F.col("target_key").alias("key"))
    near = near.union(edges.join(hit.select("term", F.col("key").alias("target_key")).hint("merge"), "target_key").select("term", F.col("source_key").alias("key")))
    view = near.union(hit.select("term", "key")).distinct().groupBy("term").agg(F.count("*").alias("in_view"))
    best = hit.groupBy("term").agg(F.count("*").alias("matched"), F.min_by("canonical_name", F.struct(F.length("canonical_name").alias("l"), F.col("canonical_name").alias("c"))).alias("best_match"))
    return best.join(view.hint("merge"), "term")


def induced_subgraph(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges that have both ends among the keys."""
    return edges.join(keys.withColumnRenamed("key", "source_key").hint("merge"), "source_key", "left_semi").join(keys.withColumnRenamed("key", "target_key").hint("merge"), "target_key", "left_semi")
