"""Queries: knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import GRAPH_STOPWORDS, GRAPH_SUFFIXES, clean_name, graph_tokens, name_key
from lodestrata.operators import graph as G
from lodestrata.plans.registry import register
from lodestrata.plans.views import counted_entities, counted_lines, counted_relations, load, spark_view, with_views


def _clean(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    for bad, good in (("â€™", "''"), ("’", "''"), ("—", "-"), ("–", "-")):
        x = f"replace({x}, '{bad}', '{good}')"
    return rf"trim(regexp_replace({x}, '\s+\([A-Z0-9&+/ -]{{2,12}}\)$', ''))"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({_clean(x)}), '[^a-z0-9]+', ' ', 'g'))"


_KEPT = f"keyed AS (SELECT *, {_key('name')} AS key, {_clean('name')} AS clean FROM entity_mentions), kept AS (SELECT * FROM keyed WHERE length(key) > 1 AND NOT starts_with(key, 'section ') AND NOT starts_with(key, 'table '))"
_CANON = f"{_KEPT}, cn AS (SELECT key, clean, count(*) AS n FROM kept WHERE clean <> '' GROUP BY ALL), canon AS (SELECT key, clean AS canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(clean), lower(clean), clean) AS r FROM cn) WHERE r = 1)"


def _listed(value: str, name: str, source: str = "kept") -> str:
    return f"{name}_l AS (SELECT key, string_agg(v, '|' ORDER BY o, v) AS {name} FROM (SELECT key, {value} AS v, min(ord) AS o FROM {source} GROUP BY ALL) GROUP BY key)"


_NODES = f"""{_CANON}, base AS (SELECT key, count(*) AS mention_count, min(entity_type) AS entity_type, min(ord) AS first_ord FROM kept GROUP BY key),
    al AS (SELECT kept.key, name, ord FROM kept JOIN canon USING (key) WHERE name <> canonical_name), {_listed('name', 'aliases', 'al')}, {_listed('evidence', 'evidence')}, {_listed('section_title', 'sections')}, {_listed("CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR)", 'page_ranges')},
    nodes AS (SELECT base.*, canonical_name, coalesce(aliases, '') AS aliases, evidence, sections, page_ranges FROM base JOIN canon USING (key) LEFT JOIN aliases_l USING (key) JOIN evidence_l USING (key) JOIN sections_l USING (key) JOIN page_ranges_l USING (key))"""
_EDGES = f"""{_NODES}, rk AS (SELECT *, {_key('source')} AS source_key, {_key('target')} AS target_key FROM relation_mentions),
    eg AS (SELECT source_key, relation_type, target_key, count(*) AS mention_count, count(DISTINCT evidence) AS evidence_count, min(ord) AS first_ord FROM rk GROUP BY ALL),
    edges AS (SELECT *, row_number() OVER (ORDER BY first_ord, source_key, relation_type, target_key) AS edge_no FROM eg WHERE source_key IN (SELECT key FROM nodes) AND target_key IN (SELECT key FROM nodes))"""
_BOTH = ("entity_mentions", "relation_mentions")


def _said(spark, sf_dir, *columns):
    """Counted mentions with no more columns than a query tells apart."""
    return counted_entities(spark, sf_dir, *columns)


def _nodes(spark, sf_dir):
    return G.graph_nodes(spark_view(spark, sf_dir, "entity_mention_counts"))


def _asked_nodes(spark, sf_dir):
    """Nodes with what a question is compared with."""
    return G.graph_nodes(_said(spark, sf_dir, "name", "evidence"))


def _numbered_edges(spark, sf_dir):
    """Edges without the number of their pieces of evidence."""
    return G.graph_edges(counted_relations(spark, sf_dir), _keys(spark, sf_dir))


def _edges(spark, sf_dir):
    return G.graph_edges(spark_view(spark, sf_dir, "relation_mention_counts"), _keys(spark, sf_dir))


@register("name_normalize", with_views(f"SELECT name, count(*) AS mentions, {_clean('name')} AS clean, {_key('name')} AS key FROM entity_mentions GROUP BY name", "entity_mentions"))
def name_normalize(spark, sf_dir):
    names = spark_view(spark, sf_dir, "entity_mentions").groupBy("name").agg(F.count("*").alias("mentions"))
    return names.select("name", "mentions", clean_name(F.col("name")).alias("clean"), name_key(F.col("name")).alias("key"))


@register("entity_filter", with_views(f"WITH {_KEPT} SELECT key, count(*) AS kept FROM kept GROUP BY key", "entity_mentions"))
def entity_filter(spark, sf_dir):
    return G.mention_groups(_said(spark, sf_dir, "name")).groupBy("key").agg(F.sum("n").alias("kept"))


@register("mention_enrich", with_views("SELECT source_parent_id, section_title, page_start, count(*) AS mentions, count(DISTINCT name) AS names FROM entity_mentions GROUP BY ALL", "entity_mentions"))
def mention_enrich(spark, sf_dir):
    return spark_view(spark, sf_dir, "entity_mentions").groupBy("source_parent_id", "section_title", "page_start").agg(F.count("*").alias("mentions"), F.count_distinct("name").alias("names"))


@register(
    "extraction_normalize",
    with_views(f"""SELECT ord, source_key, relation_type, target_key FROM (SELECT ord, {_key('source')} AS source_key, relation_type, {_key('target')} AS target_key, row_number() OVER (PARTITION BY {_key('source')}, relation_type, {_key('target')} ORDER BY ord, source, target) AS n FROM relation_mentions
    WHERE relation_type IN ({', '.join(f"'{r}'" for r in G.RELATION_TYPES)}) AND trim(source) <> '' AND trim(target) <> '') WHERE n = 1""", "relation_mentions"),
)
def extraction_normalize(spark, sf_dir):
    """Relations of a known type with both ends, each triple at its first mention."""
    r = spark_view(spark, sf_dir, "relation_mentions").filter(F.col("relation_type").isin(G.RELATION_TYPES) & (F.trim("source") != "") & (F.trim("target") != ""))
    r = r.withColumns({"source_key": name_key(F.col("source")), "target_key": name_key(F.col("target"))})
    return r.groupBy("source_key", "relation_type", "target_key").agg(F.min("ord").alias("ord"))


@register("extraction_usage", with_views("SELECT (SELECT count(*) FROM entity_mentions) AS entities, (SELECT count(*) FROM relation_mentions) AS relations, (SELECT count(DISTINCT source_parent_id) FROM entity_mentions) AS inputs", *_BOTH))
def extraction_usage(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity_mentions").agg(F.count("*").alias("entities"), F.count_distinct("source_parent_id").alias("inputs"))
    return e.join(F.broadcast(spark_view(spark, sf_dir, "relation_mentions").agg(F.count("*").alias("relations"))))


@register("canonical_name", with_views(f"WITH {_CANON} SELECT * FROM canon", "entity_mentions"))
def canonical_name(spark, sf_dir):
    return G.canonical_names(G.mention_groups(_said(spark, sf_dir, "name")))


@register("entity_type_resolve", with_views(f"WITH {_NODES} SELECT key, entity_type FROM nodes", "entity_mentions"))
def entity_type_resolve(spark, sf_dir):
    return G.mention_groups(_said(spark, sf_dir, "name", "entity_type")).groupBy("key").agg(F.min("entity_type").alias("entity_type"))


@register("graph_nodes", with_views(f"WITH {_NODES} SELECT * FROM nodes", "entity_mentions"))
def graph_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


@register("graph_edges", with_views(f"WITH {_EDGES} SELECT * FROM edges", *_BOTH))
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


_NODE_R = """array_to_string(list_filter([CASE WHEN trim(canonical_name) = '' THEN 'empty_name' END, CASE WHEN len(list_filter(string_split(canonical_name, ' '), lambda x: x <> '')) > 12 THEN 'name_too_long' END,
    CASE WHEN entity_type NOT IN ('geography', 'organization') THEN 'unsupported_entity_type' END], lambda x: x IS NOT NULL), '|')"""
_CHECKED = f"""{_EDGES}, nv AS (SELECT key, {_NODE_R} AS reasons FROM nodes),
    ev AS (SELECT edge_no, source_key, relation_type, target_key, array_to_string(list_filter([CASE WHEN relation_type NOT IN ({', '.join(f"'{r}'" for r in G.RELATION_TYPES)}) THEN 'unsupported_relation_type' END,
      CASE WHEN source_key NOT IN (SELECT key FROM nv WHERE reasons = '') THEN 'invalid_source_node' END, CASE WHEN target_key NOT IN (SELECT key FROM nv WHERE reasons = '') THEN 'invalid_target_node' END,
      CASE WHEN source_key = target_key THEN 'self_loop' END, CASE WHEN evidence_count = 0 THEN 'missing_evidence' END, CASE WHEN relation_type IN ('supports', 'depends_on', 'positions_as') AND mention_count < 2 THEN 'weak_single_mention_relation' END], lambda x: x IS NOT NULL), '|') AS reasons FROM edges)"""


@register("node_validate", with_views(f"WITH {_CHECKED} SELECT key, reasons, reasons = '' AS valid FROM nv", *_BOTH))
def node_validate(spark, sf_dir):
    return G.node_validate(_nodes(spark, sf_dir)).select("key", F.array_join("reasons", "|").alias("reasons"), "valid")


def _edge_checked(spark, sf_dir):
    return G.edge_validate(_edges(spark, sf_dir), G.node_validate(_nodes(spark, sf_dir)))


@register("edge_validate", with_views(f"WITH {_CHECKED} SELECT *, reasons = '' AS valid FROM ev", *_BOTH))
def edge_validate(spark, sf_dir):
    return _edge_checked(spark, sf_dir).select("edge_no", "source_key", "relation_type", "target_key", F.array_join("reasons", "|").alias("reasons"), "valid")


@register(
    "rejection_counts",
    with_views(f"WITH {_CHECKED} SELECT 'edge' AS kind, reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM ev WHERE reasons <> '') GROUP BY reason UNION ALL SELECT 'node', reason, count(*) FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM nv WHERE reasons <> '') GROUP BY reason", *_BOTH),
)
def rejection_counts(spark, sf_dir):
    nodes = G.settled(G.node_validate(_nodes(spark, sf_dir)))
    return G.rejection_counts(G.edge_validate(_edges(spark, sf_dir), nodes), "edge").unionByName(G.rejection_counts(nodes, "node"))


def _norm(x: str) -> str:
    x = f"lower({x})"
    for bad, good in (("â€™", "''"), ("’", "''"), ("—", " "), ("–", " ")):
        x = f"replace({x}, '{bad}', '{good}')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9$%+\-./ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _gtokens(x: str) -> str:
    stem = "CASE WHEN length(t) <= 4 THEN t " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) - {len(s)} >= 4 THEN left(t, length(t) - {len(s)})" for s in GRAPH_SUFFIXES) + " ELSE t END"
    stop = ", ".join(f"'{w}'" for w in GRAPH_STOPWORDS)
    return f"list_transform(list_filter(string_split({_norm(x)}, ' '), lambda t: t <> '' AND NOT list_contains([{stop}], t)), lambda t: {stem})"


@register("graph_tokens", f"SELECT item_id, array_to_string({_gtokens('text')}, ' ') AS tokens FROM benchmark")
def graph_tokens_(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(graph_tokens(F.col("text")), " ").alias("tokens"))


_SCORED = f"""{_EDGES}, q AS (SELECT query_id, {_gtokens('query_text')} AS qt, {_norm('query_text')} AS qn FROM queries),
    nt AS (SELECT *, {_gtokens('canonical_name')} AS n1, {_gtokens("replace(aliases, '|', ' ')")} AS n2, {_gtokens("array_to_string(list_slice(string_split(evidence, '|'), 1, 3), ' ')")} AS n3, {_norm('canonical_name')} AS norm, list_filter(list_transform(string_split(aliases, '|'), lambda a: {_norm('a')}), lambda a: a <> '') AS an FROM nodes),
    ns AS (SELECT query_id, key, canonical_name, mention_count, CAST(round(2.0 * len(list_intersect(qt, n1)) + 1.5 * len(list_intersect(qt, n2)) + 0.4 * len(list_intersect(qt, n3)) + CASE WHEN norm <> '' AND contains(qn, norm) THEN 3.0 ELSE 0.0 END
      + CASE WHEN len(list_filter(an, lambda a: contains(qn, a))) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN len(list_intersect(qt, n1)) > 0 THEN 0.5 ELSE 0.0 END + 0.1 * least(mention_count, 5), 4) AS DOUBLE) AS score FROM q, nt),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, lower(canonical_name)) AS rk FROM ns WHERE score > 0) WHERE rk <= 5),
    nb AS (SELECT DISTINCT query_id, edges.* FROM edges JOIN top ON key = source_key OR key = target_key)"""


def _queries(spark, sf_dir):
    return spark_view(spark, sf_dir, "queries")


@register("node_score_topk", with_views(f"WITH {_SCORED} SELECT * FROM top", *_BOTH, "queries"))
def node_score_topk(spark, sf_dir):
    once, same = _once(_queries(spark, sf_dir))
    return _for_all(same, G.node_topk(once, G.settled(_asked_nodes(spark, sf_dir))))


@register("neighborhood", with_views(f"WITH {_SCORED} SELECT query_id, edge_no, source_key, relation_type, target_key, mention_count FROM nb", *_BOTH, "queries"))
def neighborhood(spark, sf_dir):
    return G.neighborhood(_numbered_edges(spark, sf_dir), G.settled(node_score_topk(spark, sf_dir))).select("query_id", "edge_no", "source_key", "relation_type", "target_key", "mention_count")


_EDGE_SCORED = f"""{_SCORED}, s1 AS (SELECT source_key, relation_type, target_key, evidence, row_number() OVER (PARTITION BY source_key, relation_type, target_key ORDER BY min(ord), evidence) AS n FROM rk GROUP BY source_key, relation_type, target_key, evidence),
        s2 AS (SELECT source_key, relation_type, target_key, string_agg(evidence, ' ' ORDER BY n) AS said FROM s1 WHERE n <= 2 GROUP BY ALL),
        x AS (SELECT nb.*, s.canonical_name AS sn, t.canonical_name AS tn, qt, qn, coalesce(said, '') AS said, (SELECT list(key) FROM top WHERE top.query_id = nb.query_id) AS tops FROM nb JOIN q USING (query_id) JOIN nodes s ON s.key = source_key JOIN nodes t ON t.key = target_key LEFT JOIN s2 USING (source_key, relation_type, target_key)),
        es AS (SELECT query_id, 'edge_' || CAST(edge_no AS VARCHAR) AS edge_id, source_key, relation_type, target_key, mention_count, sn, tn, CAST(round(1.5 * len(list_intersect(qt, list_concat({_gtokens('sn')}, {_gtokens('tn')}, {_gtokens('said')}))) + CASE WHEN contains(qn, {_norm('sn')}) THEN 3.0 ELSE 0.0 END + CASE WHEN contains(qn, {_norm('tn')}) THEN 3.0 ELSE 0.0 END
          + CASE WHEN list_contains(tops, source_key) THEN 1.0 ELSE 0.0 END + CASE WHEN list_contains(tops, target_key) THEN 1.0 ELSE 0.0 END + 0.2 * least(mention_count, 3), 4) AS DOUBLE) AS score FROM x),
        tope AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, edge_id) AS rk FROM es WHERE score > 0) WHERE rk <= 8)"""


def _once(queries):
    """(queries without those that ask the same as another, query_id and the one that stands for it)."""
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_list("query_text")).alias("texts"))  # one text a query as a rule
    asked = G.settled(asked)
    first = asked.groupBy("texts").agg(F.min("query_id").alias("first"))
    same = asked.join(first.hint("merge"), "texts").select("query_id", "first")
    return G.settled(first.select(F.col("first").alias("query_id"), F.explode("texts").alias("query_text"))), G.settled(same)


def _for_all(same, found):
    """What was found for the queries of ``_once``, for each query that asks the same."""
    return same.join(found.withColumnRenamed("query_id", "first").hint("merge"), "first").drop("first")


def _retrieved(spark, sf_dir, queries):
    """(best nodes, best edges with their ends' names) of the queries."""
    once, same = _once(queries)
    lines = counted_lines(spark, sf_dir, "relation_type", "evidence", "entity_evidence")  # read once for nodes, edges and snippets
    nodes = G.settled(G.graph_nodes(counted_entities(spark, sf_dir, "name", "evidence", counted=lines)))
    relations = G.settled(G.keyed_relations(counted_relations(spark, sf_dir, "evidence", counted=lines)))
    named = G.settled(G.named_in(once, nodes))
    top = G.settled(G.node_topk(once, nodes, named=named))
    edges = G.settled(G.edge_topk(once, G.graph_edges(relations.drop("evidence"), nodes), top, nodes, G.edge_snippets(relations), named=named))
    return _for_all(same, top), _for_all(same, edges)


@register("edge_score_topk", with_views(f"WITH {_EDGE_SCORED} SELECT query_id, edge_id, source_key, relation_type, target_key, score, rk FROM tope", *_BOTH, "queries"))
def edge_score_topk(spark, sf_dir):
    return _retrieved(spark, sf_dir, _queries(spark, sf_dir))[1].drop("s_name", "t_name")


@register(
    "graph_load_stats",
    with_views(f"""WITH {_CHECKED}, se AS (SELECT s.canonical_name AS source, relation_type, t.canonical_name AS target FROM ev JOIN nodes s ON s.key = source_key JOIN nodes t ON t.key = target_key WHERE reasons = ''),
        fe AS (SELECT * FROM se ORDER BY source, relation_type, target LIMIT 5)
        SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT relation_type) FROM edges) AS relation_types, (SELECT count(*) FROM nv WHERE reasons = '') AS stored_node_count,
          (SELECT count(*) FROM se) AS stored_edge_count, (SELECT count(DISTINCT relation_type) FROM se) AS stored_relation_types, (SELECT coalesce(string_agg(source || '|' || relation_type || '|' || target, ';' ORDER BY source, relation_type, target), '') FROM fe) AS first_edges""", *_BOTH),
)
def graph_load_stats(spark, sf_dir):
    """What a load of the validated graph stores: valid nodes, valid edges between them, and the first five of these edges."""
    nodes = G.settled(G.node_validate(_nodes(spark, sf_dir)).select("key", "canonical_name", "valid"))
    edges = G.edge_groups(spark_view(spark, sf_dir, "relation_mention_counts"), nodes.select("key"))
    return G.load_stats(nodes, G.settled(G.edge_validate(edges, nodes).select("source_key", "relation_type", "target_key", "valid")))


@register("graph_payload", with_views(f"WITH {_EDGES} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, max(page_end) AS max_page FROM kept", *_BOTH))
def graph_payload(spark, sf_dir):
    n = G.mention_groups(_said(spark, sf_dir, "name", "page_end")).agg(F.count_distinct("key").alias("node_count"), F.max("page_end").alias("max_page"))
    return n.join(F.broadcast(_edges(spark, sf_dir).agg(F.count("*").alias("edge_count"))))


_DEGREE = f"{_EDGES}, de AS (SELECT key, count(*) AS d FROM (SELECT source_key AS key FROM edges UNION ALL SELECT target_key FROM edges) GROUP BY key), degree AS (SELECT nodes.key, coalesce(d, 0) AS degree FROM nodes LEFT JOIN de USING (key)), hub AS (SELECT key FROM degree ORDER BY degree DESC, key LIMIT 1)"


def _keys(spark, sf_dir):
    return G.kept_keys(_said(spark, sf_dir, "name"))


@register("degree_hub", with_views(f"WITH {_DEGREE} SELECT key, degree, key = (SELECT key FROM hub) AS is_hub FROM degree", *_BOTH))
def degree_hub(spark, sf_dir):
    d = G.settled(G.degrees(_edges(spark, sf_dir), _keys(spark, sf_dir)))
    return d.join(F.broadcast(G.hub(d).select(F.col("key").alias("h")))).select("key", "degree", (F.col("key") == F.col("h")).alias("is_hub"))


_HOPS = f"""{_DEGREE}, und AS (SELECT source_key AS a, target_key AS b FROM edges WHERE source_key <> target_key UNION SELECT target_key, source_key FROM edges WHERE source_key <> target_key),
    h1 AS (SELECT key, 0 AS hops FROM hub UNION SELECT b, 1 FROM und WHERE a = (SELECT key FROM hub)), h2 AS (SELECT DISTINCT b AS key, 2 AS hops FROM und JOIN h1 ON a = key AND hops = 1 WHERE b NOT IN (SELECT key FROM h1)),
    h3 AS (SELECT DISTINCT b AS key, 3 AS hops FROM und JOIN h2 ON a = key WHERE b NOT IN (SELECT key FROM h1 UNION SELECT key FROM h2)),
    h4 AS (SELECT DISTINCT b AS key, 4 AS hops FROM und JOIN h3 ON a = key WHERE b NOT IN (SELECT key FROM h1 UNION SELECT key FROM h2 UNION SELECT key FROM h3)),
    hops AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4)"""


def _hops(spark, sf_dir):
    keys = G.settled(_keys(spark, sf_dir))
    e = G.settled(G.edge_groups(counted_relations(spark, sf_dir), keys).select("source_key", "target_key"))
    return G.hop_distance(e, G.hub(G.degrees(e, keys)))


@register("hop_distance", with_views(f"WITH {_HOPS} SELECT * FROM hops", *_BOTH))
def hop_distance(spark, sf_dir):
    return _hops(spark, sf_dir)


@register(
    "hop_rings",
    with_views(f"WITH {_HOPS}, r AS (SELECT *, least(hops, 3) AS ring FROM hops), p AS (SELECT *, (row_number() OVER (PARTITION BY ring ORDER BY key) - 1) / count(*) OVER (PARTITION BY ring) * 2 * pi() AS angle FROM r) SELECT key, hops, ring, round(cos(angle) * ring * 120, 4) AS x, round(sin(angle) * ring * 120, 4) AS y FROM p", *_BOTH),
)
def hop_rings(spark, sf_dir):
    return G.hop_rings(_hops(spark, sf_dir))


@register(
    "graph_search",
    with_views(
        f"""WITH {_EDGES}, hit AS (SELECT r_name AS term, key, canonical_name FROM (SELECT lower(left(s_name, 4)) AS r_name FROM supplier) r JOIN nodes ON contains(lower(canonical_name), lower(r_name))),
        h AS (SELECT DISTINCT * FROM hit), near AS (SELECT term, target_key AS key FROM edges JOIN h ON key = source_key UNION SELECT term, source_key FROM edges JOIN h ON key = target_key UNION SELECT term, key FROM h)
        SELECT term, count(*) AS matched, arg_min(canonical_name, lpad(CAST(length(canonical_name) AS VARCHAR), 5, '0') || canonical_name) AS best_match, (SELECT count(*) FROM near WHERE near.term = h.term) AS in_view FROM h GROUP BY term""",
        *_BOTH,
    ),
)
def graph_search(spark, sf_dir):
    terms = load(spark, sf_dir, "supplier").select(F.lower(F.substring("s_name", 1, 4)).alias("term")).distinct()
    return G.graph_search(_nodes(spark, sf_dir), G.settled(_edges(spark, sf_dir)), terms)


@register("node_expand", with_views(f"WITH {_DEGREE} SELECT edge_no, source_key, relation_type, target_key FROM edges WHERE source_key = (SELECT key FROM hub) OR target_key = (SELECT key FROM hub)", *_BOTH))
def node_expand(spark, sf_dir):
    e = G.settled(_numbered_edges(spark, sf_dir))
    start = G.hub(G.degrees(e, _keys(spark, sf_dir))).select(F.lit(0).alias("query_id"), "key")
    return G.neighborhood(e, start).select("edge_no", "source_key", "relation_type", "target_key")


@register("induced_subgraph", with_views(f"WITH {_DEGREE}, v AS (SELECT key FROM degree WHERE degree >= (SELECT avg(degree) FROM degree)) SELECT edge_no, source_key, relation_type, target_key FROM edges WHERE source_key IN (SELECT key FROM v) AND target_key IN (SELECT key FROM v)", *_BOTH))
def induced_subgraph(spark, sf_dir):
    """The edges between nodes of at least the mean degree."""
    e = G.settled(_numbered_edges(spark, sf_dir))
    d = G.settled(G.degrees(e, _keys(spark, sf_dir)))
    mean = d.agg(F.avg("degree").alias("m"))
    keys = d.join(F.broadcast(mean)).filter("degree >= m").select("key")
    return G.induced_subgraph(e, keys).select("edge_no", "source_key", "relation_type", "target_key")
