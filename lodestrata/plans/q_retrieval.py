"""Queries: sparse, dense and hybrid retrieval; merging, coverage, diversification."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.cut import settled, shared_folder
from lodestrata.functions.text import COVERAGE_STOPWORDS, index_terms
from lodestrata.operators import chunking, merging, retrieval
from lodestrata.plans.registry import FLAGSHIP, register
from lodestrata.plans.views import load, spark_view, with_views
from lodestrata.sources import upsert

_TERMS = r"list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9\-&+.]*'), lambda x: lower(x))"
_T = _TERMS.format("child_text")
_POSTINGS = f"""t AS (SELECT child_id, len({_T}) AS length, unnest({_T}) AS term FROM chunks),
    postings AS (SELECT child_id, term, count(*) AS tf, first(length) AS length FROM t GROUP BY child_id, term),
    stats AS (SELECT count(*) AS doc_count, avg(len({_T})) AS avg_doc_len FROM chunks),
    idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT doc_count FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY term)"""
_BM25 = f"""{_POSTINGS},
    asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_TERMS.format('query_text')}) AS term FROM queries)),
    s AS (SELECT query_id, child_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / (SELECT avg_doc_len FROM stats)))), 6) AS score FROM asked JOIN postings USING (term) JOIN idf USING (term) GROUP BY query_id, child_id),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rk FROM s) WHERE rk <= 6)"""


def _chunks(spark, sf_dir):
    return chunking.chunk_parent_child(load(spark, sf_dir, "documents"))


@register("tokenize_terms", with_views(f"SELECT child_id, array_to_string({_T}, ' ') AS terms FROM chunks", "chunks"))
def tokenize_terms(spark, sf_dir):
    return _chunks(spark, sf_dir).select("child_id", F.array_join(index_terms(F.col("child_text")), " ").alias("terms"))


@register("term_postings", with_views(f"WITH {_POSTINGS} SELECT * FROM postings", "chunks"))
def term_postings(spark, sf_dir):
    return retrieval.term_postings(_chunks(spark, sf_dir), "child_id", "child_text")


@register("bm25_idf", with_views(f"WITH {_POSTINGS} SELECT term, df, round(idf, 9) AS idf, round(avg_doc_len, 6) AS avg_doc_len FROM idf, stats", "chunks"))
def bm25_idf(spark, sf_dir):
    got = retrieval.bm25_idf(retrieval.counted_blocks(_chunks(spark, sf_dir), "child_id", "child_text"))
    return got.select("term", "df", F.round("idf", 9).alias("idf"), F.round("avg_doc_len", 6).alias("avg_doc_len"))


def _hits(spark, sf_dir):
    return retrieval.bm25_topk(spark_view(spark, sf_dir, "queries"), _chunks(spark, sf_dir), "child_id", "child_text")


@register("bm25_score_topk", with_views(f"WITH {_BM25} SELECT query_id, child_id, score, rk FROM hits", "chunks", "queries"))
def bm25_score_topk(spark, sf_dir):
    return _hits(spark, sf_dir)


_CONTEXT = """p AS (SELECT query_id, parent_id, min(rk) AS best_rank, max(score) AS best_score, count(*) AS hit_count, array_to_string(list_slice(list(child_id ORDER BY rk), 1, 2), '|') AS children FROM
      (SELECT hits.*, regexp_replace(child_id, '_ch[0-9]+$', '') AS parent_id FROM hits) GROUP BY query_id, parent_id),
    pc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, best_score DESC) AS parent_rank FROM p) WHERE parent_rank <= 4)"""


def _contexts(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("parent_id", F.regexp_replace("child_id", "_ch[0-9]+$", ""))
    return merging.parent_context(hits)


@register("parent_context", with_views(f"WITH {_BM25}, {_CONTEXT} SELECT * FROM pc", "chunks", "queries"))
def parent_context(spark, sf_dir):
    return _contexts(spark, sf_dir)


@register(FLAGSHIP, with_views(f"WITH {_BM25}, {_CONTEXT} SELECT pc.*, md5(parent_text) AS context_md5 FROM pc JOIN parents USING (parent_id)", "chunks", "queries", "parents"))
def bm25_answer_context(spark, sf_dir):
    best = settled(_contexts(spark, sf_dir))
    parents = retrieval.of_matches(spark_view(spark, sf_dir, "parents"), best, "parent_id").select("parent_id", F.md5("parent_text").alias("context_md5"))
    return parents.join(best.hint("merge"), "parent_id")


@register(
    "match_hydrate",
    with_views(
        f"""WITH {_BM25}, c AS (SELECT child_id, child_text, parent_id, child_index FROM chunks), q AS (SELECT min(parent_text) AS parent_text, parent_id FROM chunks GROUP BY parent_id)
    SELECT query_id, rk, hits.child_id, md5(coalesce(child_text, '')) AS child_md5, md5(coalesce(parent_text, '')) AS parent_md5 FROM hits LEFT JOIN c USING (child_id) LEFT JOIN q ON q.parent_id = regexp_replace(hits.child_id, '_ch[0-9]+$', '')""",
        "chunks", "queries",
    ),
)
def match_hydrate(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    hits = _hits(spark, sf_dir).withColumn("parent_id", F.regexp_replace("child_id", "_ch[0-9]+$", ""))
    got = retrieval.match_hydrate(hits, chunks.select("child_id", "child_text"), chunks.select("parent_id", "parent_text", "child_index"))
    return got.select("query_id", "rk", "child_id", F.md5("child_text").alias("child_md5"), F.md5("parent_text").alias("parent_md5"))


@register(
    "rerank_documents",
    with_views(
        f"""WITH {_BM25} SELECT query_id, rk, child_id, md5('Section: ' || lang || chr(10) || 'Page: ' || CAST(parent_index AS VARCHAR) || chr(10) || 'Type: text' || chr(10) || 'Child: ' || child_text || chr(10) || 'Parent: ' || substr(parent_text, 1, 800)) AS document_md5
        FROM hits JOIN chunks USING (child_id)""",
        "chunks", "queries",
    ),
)
def rerank_documents(spark, sf_dir):
    text = retrieval.rerank_document(F.col("lang"), F.col("parent_index"), F.lit("text"), F.col("child_text"), F.col("parent_text"))
    hits = settled(_hits(spark, sf_dir))
    return retrieval.of_matches(_chunks(spark, sf_dir), hits, "child_id").join(hits.hint("merge"), "child_id").select("query_id", "rk", "child_id", F.md5(text).alias("document_md5"))


@register(
    "sparse_vector_encode",
    with_views(f"WITH {_POSTINGS} SELECT child_id, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) AS bucket, round(sum(tf * idf), 6) AS value FROM postings JOIN idf USING (term) GROUP BY ALL", "chunks"),
)
def sparse_vector_encode(spark, sf_dir):
    return retrieval.sparse_vector_encode(retrieval.counted_blocks(_chunks(spark, sf_dir), "child_id", "child_text"), "child_id", "string")


_DENSE = "SELECT query_id, id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0{0})) WHERE rk <= 6"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _dense(corpus):
    return retrieval.dense_topk(corpus, corpus.filter("id % 20 = 0").withColumnRenamed("id", "query_id"))


@register("dense_topk", _DENSE.format(""))
def dense_topk(spark, sf_dir):
    return _dense(_vectors(spark, sf_dir))


@register("namespace_filter", _DENSE.format(" AND q.label = 3 AND d.label = 3"))
def namespace_filter(spark, sf_dir):
    """Search in one namespace: the filter on the label is pushed to the scan of queries and corpus."""
    return _dense(_vectors(spark, sf_dir).filter("label = 3"))


@register("ann_topk")
def ann_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.ann_topk(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"))


@register(
    "hybrid_topk",
    with_views(
        f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_T}) AS term FROM chunks),
        sp AS (SELECT q.doc_id AS query_id, d.doc_id AS id, count(*) / 10.0 AS score FROM t q JOIN t d ON q.term = d.term AND q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0 AND q.doc_id IN (SELECT vec_id FROM embeddings) AND d.doc_id IN (SELECT vec_id FROM embeddings) GROUP BY ALL),
        de AS ({_DENSE.format('')}),
        h AS (SELECT coalesce(de.query_id, sp.query_id) AS query_id, coalesce(de.id, sp.id) AS id, round(0.6 * coalesce(de.score, 0) + 0.4 * coalesce(sp.score, 0), 6) AS score FROM de FULL JOIN sp ON de.query_id = sp.query_id AND de.id = sp.id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM h) WHERE rk <= 6""",
        "chunks",
    ),
)
def hybrid_topk(spark, sf_dir):
    """Dense matches joined with the number of terms that both documents share, over 10. Terms are gathered from all chunks of a document."""
    own = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    # documents without a vector go before they are chunked and cut into terms
    docs = retrieval.of_matches(load(spark, sf_dir, "documents"), own, "doc_id")
    mine = chunking.chunk_parent_child(docs).select("doc_id", F.array_distinct(index_terms(F.col("child_text"))).alias("terms"))
    terms = settled(mine.groupBy(F.col("doc_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    asked = terms.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    dense = settled(dense_topk(spark, sf_dir).drop("rk"))
    # of the pairs that are no dense matches at most k are among a query's k best: those with most shared terms; k more stand for the dense ones
    most = retrieval.shared_terms(asked, terms, 2 * retrieval.TOP_K)
    near = dense.join(asked.withColumnRenamed("terms", "q_terms").hint("merge"), "query_id").join(terms.hint("merge"), "id")
    near = near.select("query_id", "id", F.size(F.array_intersect("q_terms", "terms")).cast("long").alias("shared")).filter("shared > 0")
    sparse = most.unionByName(near).groupBy("query_id", "id").agg((F.max("shared") / 10.0).alias("score"))
    return retrieval.hybrid_topk(dense, sparse, ["query_id"])


@register("match_dedupe", with_views("SELECT sub_query_id, chunk_no, variant_ord, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY sub_query_id, chunk_no ORDER BY variant_ord, rk) AS f FROM matches) WHERE f = 1", "matches"))
def match_dedupe(spark, sf_dir):
    m = spark_view(spark, sf_dir, "matches").withColumn("ord", F.col("variant_ord") * 100 + F.col("rk"))
    return retrieval.match_dedupe(m, ["sub_query_id"], "chunk_no", "ord").select("sub_query_id", "chunk_no", "variant_ord", "score", "rk")


@register(
    "variant_expand",
    """SELECT item_id AS query_id, 'original' AS variant_id, 'original' AS variant_type, text AS query_text FROM benchmark UNION ALL SELECT item_id, 'mq_1', 'multi_query', 'more ' || text FROM benchmark
    UNION ALL SELECT item_id, 'mq_2', 'multi_query', lower(text) FROM benchmark UNION ALL SELECT item_id, 'step_back', 'step_back', 'overview ' || text FROM benchmark WHERE item_id % 2 = 0""",
)
def variant_expand(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    back = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("overview "), "text"))
    return retrieval.variant_expand(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("original"), F.array(F.concat(F.lit("more "), "text"), F.lower("text")).alias("rewrites"), back.alias("step_back")))


@register("variant_retrieval", with_views("SELECT sub_query_id, count(DISTINCT variant_ord) AS variant_count, count(*) AS match_count, round(avg(score), 6) AS avg_score FROM matches GROUP BY sub_query_id", "matches"))
def variant_retrieval(spark, sf_dir):
    return spark_view(spark, sf_dir, "matches").groupBy("sub_query_id").agg(F.count_distinct("variant_ord").alias("variant_count"), F.count("*").alias("match_count"), F.round(F.avg("score"), 6).alias("avg_score"))


_ARRIVED = "arrived AS (SELECT *, variant_ord * 100 + rk AS ord FROM matches)"
_MERGED = f"""{_ARRIVED}, merged AS (SELECT sub_query_id, chunk_no, max(score) AS best_score, arg_max(ord, score * 1000000 - ord / 1000.0) AS best_ord, count(*) AS match_count, string_agg(CAST(variant_ord AS VARCHAR), '|' ORDER BY ord) AS variants, min(ord) AS first_ord FROM arrived GROUP BY sub_query_id, chunk_no),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sub_query_id ORDER BY best_score DESC, match_count DESC, first_ord) AS rk FROM merged)"""


def _arrived(spark, sf_dir):
    return spark_view(spark, sf_dir, "matches").withColumn("ord", F.col("variant_ord") * 100 + F.col("rk")).withColumn("variant", F.col("variant_ord").cast("string"))


def _merged(spark, sf_dir):
    return merging.ranked(merging.merge_dedup(_arrived(spark, sf_dir)))


@register("merge_dedup", with_views(f"WITH {_MERGED} SELECT * FROM ranked", "matches"))
def merge_dedup(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("variants", F.array_join("variants", "|"))


@register(
    "merge_summary",
    with_views(f"WITH {_MERGED} SELECT (SELECT count(DISTINCT sub_query_id) FROM arrived) AS sub_query_count, (SELECT count(DISTINCT (sub_query_id, variant_ord)) FROM arrived) AS variant_count, (SELECT count(*) FROM arrived) AS total_matches, count(*) AS total_merged, (SELECT count(*) FROM arrived) - count(*) AS duplicates_removed FROM merged", "matches"),
)
def merge_summary(spark, sf_dir):
    m = merging.merge_dedup(_arrived(spark, sf_dir))
    per = m.select("sub_query_id", "match_count", F.explode("variants").alias("v"), "chunk_no")
    sums = m.agg(F.count_distinct("sub_query_id").alias("sub_query_count"), F.sum("match_count").alias("total_matches"), F.count("*").alias("total_merged"))
    n = per.agg(F.count_distinct("sub_query_id", "v").alias("variant_count"))
    return sums.join(F.broadcast(n)).select("sub_query_count", "variant_count", "total_matches", "total_merged", (F.col("total_matches") - F.col("total_merged")).alias("duplicates_removed"))


@register("retry_merge", with_views(f"WITH {_MERGED} SELECT sub_query_id, chunk_no, best_score, match_count, first_ord FROM merged", "matches"))
def retry_merge(spark, sf_dir):
    """The third variant taken as a retry: merging it later gives what merging all at once gives."""
    a = _arrived(spark, sf_dir)
    got = merging.retry_merge(merging.merge_dedup(a.filter("variant_ord < 2")), a.filter("variant_ord = 2"))
    return got.select("sub_query_id", "chunk_no", "best_score", "match_count", "first_ord")


_STOP = ", ".join(f"'{w}'" for w in COVERAGE_STOPWORDS)
_CT = r"list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\-+]*'), lambda x: NOT list_contains([" + _STOP + "], x))"
_COVER = f"""{_MERGED}, c0 AS (SELECT doc_id, lang || ' ' || text AS evidence, text AS child_text FROM documents),
    r AS (SELECT ranked.*, coalesce(e.evidence, '') AS evidence, coalesce(q.child_text, '') AS query_text FROM ranked LEFT JOIN c0 e ON e.doc_id = chunk_no LEFT JOIN c0 q ON q.doc_id = sub_query_id * 60),
    a AS (SELECT sub_query_id, max(CASE WHEN rk = 1 THEN best_score END) AS top_score, string_agg(CASE WHEN rk <= 3 THEN evidence END, ' ' ORDER BY rk) AS evidence, first(query_text) AS query_text,
      least(count(*) FILTER (rk <= 5 AND match_count >= 2) / 3.0, 1.0) AS reinforced, least(count(*) / 5.0, 1.0) AS depth, string_agg(CASE WHEN rk <= 3 THEN CAST(chunk_no AS VARCHAR) END, '|' ORDER BY rk) AS top_match_ids FROM r GROUP BY sub_query_id),
    o AS (SELECT *, list_distinct({_CT.format('query_text')}) AS asked, {_CT.format('evidence')} AS has FROM a),
    v AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_filter(asked, lambda x: list_contains(has, x))) / len(asked) END AS overlap, CASE WHEN top_score <= 0 THEN 0.0 ELSE least(top_score / 3.0, 1.0) END AS strength FROM o),
    w AS (SELECT *, round(0.45 * strength + 0.35 * overlap + 0.10 * reinforced + 0.10 * depth, 4) AS coverage_score FROM v),
    coverage AS (SELECT sub_query_id, top_score, overlap, reinforced, depth, strength, top_match_ids, coverage_score, CASE WHEN coverage_score >= 0.72 THEN 'strong' WHEN coverage_score >= 0.48 THEN 'moderate' ELSE 'weak' END AS coverage_label FROM w)"""


def _coverage(spark, sf_dir):
    c0 = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("child_text"), F.concat("lang", F.lit(" "), "text").alias("evidence"))
    m = _merged(spark, sf_dir)
    e = c0.select(F.col("doc_id").alias("chunk_no"), "evidence")
    q = c0.select((F.col("doc_id") / 60).cast("long").alias("sub_query_id"), F.col("child_text").alias("query_text"), "doc_id").filter("doc_id % 60 = 0").drop("doc_id")
    rows = m.join(e.hint("merge"), "chunk_no", "left").join(q.hint("merge"), "sub_query_id", "left")
    return merging.coverage_scores(rows.withColumns({"evidence": F.coalesce("evidence", F.lit("")), "query_text": F.coalesce("query_text", F.lit(""))}))


@register("coverage_score", with_views(f"WITH {_COVER} SELECT * FROM coverage", "matches", "chunks"))
def coverage_score(spark, sf_dir):
    return _coverage(spark, sf_dir)


@register("overlap_ratio", with_views(f"WITH {_COVER} SELECT sub_query_id, overlap FROM coverage", "matches", "chunks"))
def overlap_ratio(spark, sf_dir):
    return _coverage(spark, sf_dir).select("sub_query_id", "overlap")


_WEAK = "coverage_label = 'weak'"


@register(
    "coverage_summary",
    with_views(f"WITH {_COVER} SELECT count(*) AS sub_query_count, round(avg(coverage_score), 4) AS average_coverage_score, count(*) FILTER ({_WEAK}) AS weak_sub_query_count, coalesce(string_agg(CASE WHEN {_WEAK} THEN CAST(sub_query_id AS VARCHAR) END, '|' ORDER BY sub_query_id), '') AS weak_sub_query_ids FROM coverage", "matches", "chunks"),
)
def coverage_summary(spark, sf_dir):
    return merging.coverage_summary(_coverage(spark, sf_dir))


_HYDE = f"""array_to_string(list_filter([CASE WHEN {_WEAK} THEN 'coverage_label_weak' END, CASE WHEN round(overlap, 4) < 0.2 AND round(top_score, 4) < 2.2 THEN 'very_low_overlap_and_unconvincing_score' END,
    CASE WHEN round(overlap, 4) < 0.12 AND round(reinforced, 4) < 0.34 THEN 'low_overlap_and_low_reinforcement' END, CASE WHEN round(strength, 4) < 0.35 AND round(depth, 4) < 0.4 THEN 'shallow_low_score_result_set' END], lambda x: x IS NOT NULL), '|')"""


@register("hyde_trigger", with_views(f"WITH {_COVER} SELECT sub_query_id, {_HYDE} AS reasons, {_HYDE} <> '' AS triggered FROM coverage", "matches", "chunks"))
def hyde_trigger(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("r", merging.hyde_reasons()).select("sub_query_id", F.array_join("r", "|").alias("reasons"), (F.size("r") > 0).alias("triggered"))


@register(
    "fast_evidence",
    with_views(f"WITH {_MERGED} SELECT sub_query_id, rk, chunk_no, best_score FROM ranked WHERE rk <= 3", "matches"),
)
def fast_evidence(spark, sf_dir):
    return _merged(spark, sf_dir).filter("rk <= 3").select("sub_query_id", "rk", "chunk_no", "best_score")


@register(
    "cosine_similarity",
    with_views("SELECT sub_query_id, variant_ord, chunk_no, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS cosine FROM matches JOIN embeddings q ON q.vec_id = sub_query_id * 60 + variant_ord * 20 JOIN embeddings d ON d.vec_id = chunk_no", "matches"),
)
def cosine_similarity(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = spark_view(spark, sf_dir, "matches").withColumn("q_id", F.col("sub_query_id") * 60 + F.col("variant_ord") * 20)
    got = m.join(v.withColumnsRenamed({"vec_id": "q_id", "embedding": "a"}).hint("merge"), "q_id").join(v.withColumnsRenamed({"vec_id": "chunk_no", "embedding": "b"}).hint("merge"), "chunk_no")
    return got.select("sub_query_id", "variant_ord", "chunk_no", F.round(retrieval.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def _mmr_sql() -> str:
    cos = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 12)"
    out = ["c1 AS (SELECT sub_query_id, chunk_no, rk, best_score, embedding, CAST(NULL AS DOUBLE) AS near FROM ranked JOIN embeddings ON vec_id = chunk_no WHERE rk <= 6)"]
    for place in range(1, 5):
        score = "best_score" if place == 1 else "round(0.75 * best_score - 0.25 * near, 6)"
        out.append(f"s{place} AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY sub_query_id ORDER BY {score} DESC, rk) AS n FROM c{place})")
        if place < 4:
            out.append(f"c{place + 1} AS (SELECT a.sub_query_id, a.chunk_no, a.rk, a.best_score, a.embedding, greatest(coalesce(a.near, -2), {cos.format('a.embedding', 'b.embedding')}) AS near FROM s{place} a JOIN s{place} b ON a.sub_query_id = b.sub_query_id AND b.n = 1 WHERE a.n > 1)")
    picks = " UNION ALL ".join(f"SELECT sub_query_id, chunk_no, {p} AS place, score AS mmr_score FROM s{p} WHERE n = 1" for p in range(1, 5))
    return with_views(f"WITH {_MERGED}, {', '.join(out)} {picks}", "matches")


#: Stand-ins for a policy's plan and for scores on a hybrid scale: which profile a sub-query should have, and how far its coverage is lifted.
_PLANNED = "CASE sub_query_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'full' ELSE 'skip' END"
_LIFTED = "least(coverage_score + 0.2 * (sub_query_id % 5), 1.0)"
_DECIDED = f"""{_COVER}, lifted AS (SELECT sub_query_id, {_PLANNED} AS planned, CAST(round({_LIFTED}, 4) AS DOUBLE) AS average, {_LIFTED} < 0.48 AS weak FROM coverage),
    decided AS (SELECT *, CASE WHEN planned IN ('skip', 'full') OR (planned = 'fast' AND average >= 0.62 AND NOT weak) OR (planned = 'balanced' AND average >= 0.70 AND NOT weak) THEN planned ELSE planned || '_escalated' END AS profile FROM lifted)"""


def _decided(spark, sf_dir):
    lifted = _coverage(spark, sf_dir).withColumn("coverage_score", F.expr(_LIFTED))
    lifted = lifted.withColumn("coverage_label", F.when(F.col("coverage_score") < 0.48, "weak").otherwise("moderate"))
    lifted = settled(lifted.select("sub_query_id", "coverage_score", "coverage_label"))
    return merging.decided_profiles(lifted.select("sub_query_id", F.expr(_PLANNED).alias("planned")), lifted, "sub_query_id")


@register(
    "profile_escalation",
    f"""WITH w AS ({with_views(f"WITH {_DECIDED} SELECT * FROM decided", "matches", "chunks")}), r AS ({with_views(f"WITH {_MERGED} SELECT sub_query_id, rk, chunk_no, best_score FROM ranked", "matches")}), m AS (SELECT sub_query_id, place, chunk_no, mmr_score FROM ({_mmr_sql()})),
    x AS (SELECT sub_query_id, rk AS place, chunk_no, best_score AS score FROM r JOIN w USING (sub_query_id) WHERE (profile = 'fast' AND rk <= 3) OR (profile = 'balanced' AND rk <= 4)
      UNION ALL SELECT sub_query_id, place, chunk_no, mmr_score FROM m JOIN w USING (sub_query_id) WHERE profile = 'full' OR ends_with(profile, '_escalated'))
    SELECT sub_query_id, planned, profile, average, place, chunk_no, score FROM w LEFT JOIN x USING (sub_query_id)""",
)
def profile_escalation(spark, sf_dir):
    """What each sub-query ends with: the first matches of a profile that stood, or the diversified ones of the full path; a skipped one has no match."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vec"))

    def full(matches):
        best = matches.filter("rk <= 6").select("sub_query_id", "chunk_no", F.col("rk").alias("rank"), F.col("best_score").alias("relevance"))
        return merging.mmr_select(best.join(v.hint("merge"), "chunk_no"), ["sub_query_id"]).withColumnRenamed("mmr_score", "score")

    decided = settled(_decided(spark, sf_dir))
    got = merging.execute_profiles(decided, settled(_merged(spark, sf_dir)), full, "sub_query_id")
    return decided.select("sub_query_id", "planned", "profile", "average").join(got.drop("profile").hint("merge"), "sub_query_id", "left")


@register(
    "profile_usage",
    with_views(
        f"""WITH {_DECIDED}, u AS (SELECT 'profile' AS kind, profile AS name FROM decided UNION ALL SELECT 'source', 'vector_document' FROM decided WHERE profile <> 'skip' UNION ALL SELECT 'source', 'sql_structured' FROM decided WHERE profile = 'skip'),
        k AS (SELECT 'profile' AS kind, unnest([{', '.join(f"'{p}'" for p in merging.PROFILE_NAMES)}]) AS name UNION ALL SELECT 'source', unnest(['vector_document', 'graph_relationships', 'sql_structured']))
        SELECT k.kind, k.name, count(u.name) AS n FROM k LEFT JOIN u ON u.kind = k.kind AND u.name = k.name GROUP BY ALL""",
        "matches", "chunks",
    ),
)
def profile_usage(spark, sf_dir):
    """How often each profile and each source was used, 0 where never. A sub-query whose vector source is skipped is answered from tables here."""
    profiles = settled(_decided(spark, sf_dir).groupBy("profile").agg(F.count("*").alias("n")))
    sources = profiles.groupBy(F.when(F.col("profile") == "skip", "sql_structured").otherwise("vector_document").alias("source")).agg(F.sum("n").alias("n"))
    both = [("profile", merging.zero_filled(profiles, "profile", merging.PROFILE_NAMES, "n")), ("source", merging.zero_filled(sources, "source", ["vector_document", "graph_relationships", "sql_structured"], "n"))]
    named = [df.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), "n") for kind, df in both]
    return named[0].unionByName(named[1])


@register("mmr_select", _mmr_sql())
def mmr_select(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vec"))
    best = _merged(spark, sf_dir).filter("rk <= 6").select("sub_query_id", "chunk_no", F.col("rk").alias("rank"), F.col("best_score").alias("relevance"))
    return merging.mmr_select(best.join(v.hint("merge"), "chunk_no"), ["sub_query_id"])


@register("mmr_bundle", f"WITH x AS ({_mmr_sql()}) SELECT sub_query_id, count(*) AS diversified_count, string_agg(CAST(chunk_no AS VARCHAR), '|' ORDER BY place) AS chunks FROM x GROUP BY sub_query_id")
def mmr_bundle(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_no"))), lambda x: x["chunk_no"])
    return mmr_select(spark, sf_dir).groupBy("sub_query_id").agg(F.count("*").alias("diversified_count"), F.concat_ws("|", ids).alias("chunks"))


@register(
    "rerank_apply",
    with_views(f"""WITH {_MERGED}, s AS (SELECT sub_query_id, chunk_no, round(1.0 / rk + match_count, 6) AS rerank_score FROM ranked)
    SELECT sub_query_id, chunk_no, best_score, rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY sub_query_id ORDER BY rerank_score DESC, chunk_no) AS rerank_rank FROM ranked JOIN s USING (sub_query_id, chunk_no)) WHERE rerank_rank <= 6""", "matches"),
)
def rerank_apply(spark, sf_dir):
    m = _merged(spark, sf_dir)
    scores = m.select("sub_query_id", "chunk_no", F.round(1.0 / F.col("rk") + F.col("match_count"), 6).alias("rerank_score"))
    return retrieval.rerank_apply(m, scores, ["sub_query_id"], "chunk_no").select("sub_query_id", "chunk_no", "best_score", "rerank_score", "rerank_rank")


@register(
    "evidence_bundle",
    with_views(f"""WITH {_MERGED} SELECT sub_query_id, rk AS evidence_no, chunk_no, best_score, CAST(chunk_no AS VARCHAR) || '_par0_ch0' AS source_chunk_id, CAST(chunk_no AS VARCHAR) || '_par0' AS parent_id, lang AS section_title, count(*) OVER (PARTITION BY sub_query_id) AS evidence_count
    FROM ranked LEFT JOIN documents ON doc_id = chunk_no""", "matches"),
)
def evidence_bundle(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_no"), F.col("lang").alias("section_title"))
    m = _merged(spark, sf_dir).join(d.hint("merge"), "chunk_no", "left")
    n = F.col("chunk_no").cast("string")
    return m.select("sub_query_id", F.col("rk").alias("evidence_no"), "chunk_no", "best_score", F.concat(n, F.lit("_par0_ch0")).alias("source_chunk_id"), F.concat(n, F.lit("_par0")).alias("parent_id"), "section_title", F.count("*").over(W.partitionBy("sub_query_id")).alias("evidence_count"))


@register(
    "dense_sparse_assemble",
    with_views(f"WITH t AS (SELECT doc_id, count(*) AS terms FROM (SELECT doc_id, unnest({_T}) FROM chunks) GROUP BY doc_id) SELECT vec_id AS record_id, len(embedding) AS dense_dim, terms AS sparse_terms FROM embeddings JOIN t ON doc_id = vec_id", "chunks"),
)
def dense_sparse_assemble(spark, sf_dir):
    terms = _chunks(spark, sf_dir).select("doc_id", F.explode(index_terms(F.col("child_text"))).alias("t")).groupBy(F.col("doc_id").alias("record_id")).agg(F.count("*").alias("sparse_terms"))
    dense = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.size("embedding").alias("dense_dim"))
    return dense.join(terms.hint("merge"), "record_id")


@register(
    "vector_upsert",
    "SELECT doc_id AS record_id, lang AS namespace, batch, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY batch DESC) AS n FROM (SELECT doc_id, lang, source, 0 AS batch FROM documents UNION ALL SELECT doc_id, lang, 'new', 1 FROM documents JOIN labels USING (doc_id))) WHERE n = 1",
)
def vector_upsert(spark, sf_dir):
    """Two batches written to an upsert sink, the second one twice, and read back: the last write of a record in its namespace counts."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("namespace"), "source", F.lit(0).alias("batch"))
    new = d.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id")).hint("merge"), "record_id", "left_semi").withColumns({"source": F.lit("new"), "batch": F.lit(1)})
    path, columns = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}", "record_id long, batch int, source string, namespace string"
    for number, rows in ((0, d), (1, new), (1, new)):
        upsert.upsert(rows, path, number, columns)
    return upsert.read_records(spark, path, columns).select("record_id", "namespace", "batch", "source")
