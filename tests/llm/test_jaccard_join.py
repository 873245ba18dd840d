import collections
import random

import pandas as pd

from lodestrata.llm import jaccard_join
from lodestrata.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows, threshold=0.8):
    """doc_id -> (class_id, links, class_size) by comparing all pairs of different sets."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    keys = list(sets)
    by = collections.defaultdict(list)
    for n, s in enumerate(keys):
        for x in s:
            by[x].append(n)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [len(sets[k]) - 1 for k in keys]
    for n, s in enumerate(keys):
        shared = collections.Counter(m for x in s for m in by[x] if m > n)
        for m, both in shared.items():
            if both >= threshold * (len(s) + len(keys[m]) - both) - 1e-9:
                links[n] += len(sets[keys[m]])
                links[m] += len(sets[s])
                root[find(m)] = find(n)
    size, least = collections.Counter(), {}
    for n, s in enumerate(keys):
        r = find(n)
        size[r] += len(sets[s])
        for i in sets[s]:
            least[r] = min(least.get(r, i), i)
    return {i: (least[find(n)], links[n], size[find(n)]) for n, s in enumerate(keys) for i in sets[s]}


def run(df):
    return {r.doc_id: (r.class_id, r.links, r.class_size) for r in jaccard_join.jaccard_links(df).collect()}


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.links, r.class_size) for r in jaccard_join.op7_jaccard_join(spark, d).collect()}
    assert got == brute(list(zip(docs.doc_id.tolist(), docs.text)))


def test_large_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "EXPANDED", 8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        ws = list(base)
        for _ in range(rng.randrange(5)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(100 + i, "A short Text") for i in range(40)] + [(150, "a short\ttext"), (151, "a short"), (160, None), (161, ""), (162, " \n "), (170, "long " * 30000), (171, "one two three four five six seven eight nine ten"), (172, "one two three four five six seven eight nine zehn")]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, links int")
    assert run(df) == brute(rows)
    kept = jaccard_join.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in brute(rows).values()})
    assert run(df.limit(0)) == {}
    twice = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c", 0), (None, "c", 0)], "doc_id long, text string, links int")
    assert sorted((str(r.class_id), r.links, r.class_size) for r in jaccard_join.jaccard_links(twice).collect()) == [("1", 1, 2), ("1", 1, 2), ("None", 1, 2), ("None", 1, 2)]
    assert jaccard_join.one_of_each_class(twice).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(30)}}


def test_pruning_keeps_what_can_reach_the_threshold():
    need = jaccard_join.least_matches(0.8)
    assert all(need[n] < 0.8 * n for n in need) and need[128] > 70 and need[16] < need[32]


def test_one_doc_id_with_unlike_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 1), (1, b, 2), (1, a, 3), (2, b + " more", 4), (3, a, 5), (None, "c d e f g h", 6), (None, "c d e f g h", 7), (None, b, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, links int")
    kept = sorted((str(r.doc_id), r.text) for r in jaccard_join.one_of_each_class(df).collect())
    assert kept == sorted([("1", a), ("1", b), ("None", "c d e f g h")])


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.components.FEW_EDGES", 3)
    edges = [(i, i + 1) for i in range(12)] + [(50, 50 + i) for i in range(1, 9)] + [(90, 91)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(13)}, **{50 + i: 50 for i in range(9)}, 90: 90, 91: 90}
