"""Range joins on a grid, comparison of results, and profiles that are executed again."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import chunking, evaluation, merging

RECT = "doc_id long, line_no int, x0 double, y0 double, x1 double, y1 double, text string"


def test_grid_join_meets_what_all_pairs_meet(spark):
    """A page dense with small boxes, boxes that cover the page, equal and touching ones, negative, inverted and unknown corners."""
    rng = random.Random(3)

    def rect(size):
        x, y = rng.uniform(-300, 900), rng.uniform(-300, 900)
        return (x, y, x + rng.uniform(0, size), y + rng.uniform(0, size))

    blocks = [(d, n, *rect(rng.choice([3, 40, 400])), "t") for d in (1, 2, 3) for n in range(120)]
    blocks += [(1, 900, 10.0, 10.0, 20.0, 20.0, "t"), (1, 901, 32.0, 32.0, 64.0, 64.0, "t"), (1, 902, None, 0.0, 1.0, 1.0, "t"), (9, 0, 0.0, 0.0, 5.0, 5.0, "no boxes"), (2, 903, -1e5, -1e5, 1e5, 1e5, "all")]
    boxes = [(d, *rect(rng.choice([2, 30, 100]))) for d in (1, 2, 3) for _ in range(40)] + [(1, 20.0, 20.0, 32.0, 32.0), (1, 50.0, 50.0, 40.0, 40.0), (3, -5e3, -5e3, 5e3, 5e3), (1, 0.0, float("nan"), 1.0, 1.0)] * 2
    b, t = spark.createDataFrame(blocks, RECT), spark.createDataFrame(boxes, "doc_id long, x0 double, y0 double, x1 double, y1 double")
    meets = lambda r, s: r[0] == s[0] and None not in r[2:6] and not any(v != v for v in s[1:]) and r[2] < s[3] and r[4] > s[1] and r[3] < s[4] and r[5] > s[2]
    want = {(r[0], r[1]) for r in blocks if any(meets(r, s) for s in boxes)}
    assert {tuple(r) for r in chunking.meeting(b, t, ["doc_id", "line_no"]).collect()} == want and len(want) > 50
    kept = chunking.layout_block_filter(b, t).collect()
    assert {(r.doc_id, r.line_no) for r in kept} == {(r[0], r[1]) for r in blocks} - want
    assert "CartesianProduct" not in chunking.meeting(b, t, ["doc_id", "line_no"])._jdf.queryExecution().toString()
    assert chunking.layout_block_filter(b, t.limit(0)).count() == len(blocks)


def compared(spark, actual, expected, order=None, types=("name string, score double", "name string, score double")):
    return evaluation.result_compare(spark.createDataFrame(actual, types[0]), spark.createDataFrame(expected, types[1]), order).first()


def test_compared_results(spark):
    rows = [("Azure", 95.0), ("Windows", 46.812345), ("Windows", 46.812345), (None, None)]
    same = compared(spark, rows[::-1], [(n, s and round(s, 4)) for n, s in rows])
    assert same.strict_passed and same.answer_passed and same.actual_row_count == 4
    once = compared(spark, rows[:2] + rows[3:], rows)
    assert not once.answer_passed and (once.missing_rows, once.extra_rows) == (1, 0)
    up, down = ["score"], ["score desc"]
    assert compared(spark, rows[:2], rows[:2], (up, up)).strict_passed
    assert not compared(spark, rows[:2], rows[:2], (down, up)).strict_passed
    wide = compared(spark, [("Azure", 95.0, "x")], [("Azure", 95.0)], types=("name string, score double, extra string", "name string, score double"))
    assert wide.answer_passed and not wide.strict_passed and wide.extra_columns == "extra"
    less = compared(spark, [("Azure",)], [("Azure", 95.0)], types=("name string", "name string, score double"))
    assert less.missing_columns == "score" and not less.answer_passed and less.missing_rows is None
    turned = compared(spark, [(95.0, "Azure")], [("Azure", 95.0)], types=("score double, name string", "name string, score double"))
    assert turned.answer_passed and not turned.same_columns and not turned.strict_passed
    assert compared(spark, [], []).strict_passed


def test_a_planned_profile_stands_or_all_of_it_runs_again(spark):
    plan = spark.createDataFrame([(1, "fast"), (2, "fast"), (3, "balanced"), (4, "balanced"), (5, "full"), (6, "skip"), (7, "fast"), (8, "balanced")], "sub_query_id int, planned string")
    scores = [(1, 0.8, "strong"), (2, 0.6, "moderate"), (3, 0.8, "strong"), (4, 0.65, "moderate"), (5, 0.1, "weak"), (6, 0.9, "strong"), (8, 0.99, "strong"), (8, 0.99, "weak")]
    decided = merging.decided_profiles(plan, spark.createDataFrame(scores, "sub_query_id int, coverage_score double, coverage_label string"), "sub_query_id")
    assert {r.sub_query_id: r.profile for r in decided.collect()} == {1: "fast", 2: "fast_escalated", 3: "balanced", 4: "balanced_escalated", 5: "full", 6: "skip", 7: "fast_escalated", 8: "balanced_escalated"}
    matches = spark.createDataFrame([(q, rk, 100 * q + rk, 1.0 / rk) for q in range(1, 9) for rk in range(1, 7)], "sub_query_id int, rk int, chunk_no int, best_score double")
    asked = []

    def full(some):
        asked.extend(sorted({r.sub_query_id for r in some.select("sub_query_id").collect()}))
        return some.filter("rk = 6").select("sub_query_id", F.lit(1).alias("place"), "chunk_no", F.lit(0.5).alias("score"))

    got = merging.execute_profiles(decided, matches, full, "sub_query_id").collect()
    assert asked == [2, 4, 5, 7, 8]
    counts = {q: sorted(r.chunk_no for r in got if r.sub_query_id == q) for q in range(1, 9)}
    assert counts == {1: [101, 102, 103], 2: [206], 3: [301, 302, 303, 304], 4: [406], 5: [506], 6: [], 7: [706], 8: [806]}


def test_counted_mentions_give_the_graph_of_single_ones(spark):
    """Rows with n stand for so many mentions; the counted views hold fewer rows than lineitem and give the same nodes and edges."""
    from lodestrata.operators import graph as G
    from lodestrata.plans.views import load, spark_view

    d = "/root/testdata/sf0.001"
    counts = spark_view(spark, d, "entity_mention_counts")
    assert counts.count() < 2 * load(spark, d, "lineitem").count() == counts.agg({"n": "sum"}).first()[0]
    made = [sorted(map(str, G.graph_nodes(spark_view(spark, d, v)).collect())) for v in ("entity_mention_counts", "entity_mentions")]
    assert made[0] == made[1]
    keys = G.kept_keys(counts)
    made = [sorted(map(str, G.graph_edges(spark_view(spark, d, v), keys).collect())) for v in ("relation_mention_counts", "relation_mentions")]
    assert made[0] == made[1]


def test_mentions_are_counted_by_what_is_asked_for_alone(spark):
    """Fewer rows than the view with all columns, for the same mentions; and an edge between two of a query's nodes is found once."""
    from lodestrata.operators import graph as G
    from lodestrata.plans.views import counted_entities, counted_relations, spark_view

    d = "/root/testdata/sf0.001"
    every = spark_view(spark, d, "entity_mention_counts")
    for columns in (["name"], ["name", "entity_type"], ["name", "evidence"], ["name", "section_title", "page_end"]):
        few = counted_entities(spark, d, *columns)
        each = lambda df: sorted(map(str, df.groupBy(*columns).agg(F.sum("n").alias("n"), F.min("ord").alias("ord")).collect()))  # noqa: E731, B023
        assert each(few) == each(every) and few.count() < every.count()
    triple = ["source", "relation_type", "target"]
    made = [sorted(map(str, r.groupBy(*triple).agg(F.sum("n").alias("n"), F.min("ord").alias("ord")).collect())) for r in (counted_relations(spark, d), spark_view(spark, d, "relation_mention_counts"))]
    assert made[0] == made[1]
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("b", "b", 4)], "source_key string, target_key string, edge_no int")
    top = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "query_id int, key string")
    assert sorted((r.query_id, r.edge_no) for r in G.neighborhood(edges, top).collect()) == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 3)]
