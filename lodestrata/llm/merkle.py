"""Merkle manifest of a dataset: a tree for each source, a tree over the sources' roots, and a proof for each row.

The rows of a source, in order, are cut into blocks of ``fanout ** 2`` neighbouring leaves, each a
subtree that one row of a table holds. The upper levels are a butterfly exchange: in a round the
blocks below the ``fanout`` children of one parent meet in small groups, one block of each
child (its *lane*: its place below the child), swap their children's hashes, and each computes the
parent. So every block has a parent's hash and its own siblings after the round, all blocks
do the same work, and nothing has to go down again. A child with fewer blocks than its siblings
(the last one, or a small source) serves several lanes. A round is one shuffle in which a
group has at most ``fanout`` rows; with n rows there are log(n / fanout ** 2) rounds to the base
of the fan-out, and some more over the sources.

A leaf is the hash of the row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and the
value. A proof is a list of (hashes before, hashes after), level by level; folding it over a leaf gives the root.

Defined results: rows of a source ascend by doc_id (null first), of equal ids by their leaf, so that repeated rows each are
a leaf; a null source is a source and comes first; a source of one row has its leaf as subroot; the last run of a level may hold one node and is
hashed all the same; a null doc_id is never tampered with; an empty table gives an empty
result; other columns of the input are not used. Texts do not move: each row is reduced to its hashes first.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import checked, settle, table
from lodestrata.llm.sharding import with_number

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """The hash of a row's columns; ``instead`` gives other expressions for some of them."""
    parts = []
    for c in columns:
        value = instead.get(c, F.col(c)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return digest(*parts)


def _joined(hashes: Column, start: Column | int, n: Column | int) -> Column:
    return F.concat_ws("", F.slice(hashes, start, n))


def _around(hashes: Column, run: Column, place: Column, fanout: int) -> Column:
    """What stands before and after a place, from 0, in a run of ``fanout`` hashes."""
    before = _joined(hashes, run * fanout + 1, place)
    after = _joined(hashes, run * fanout + place + 2, F.lit(fanout - 1) - place)
    return F.struct(before.alias("before"), after.alias("after"))


def _sources(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their range, a row for each range and source: where it starts, the source's number, leaves and blocks). rows: skey, doc_id, leaf, bad, tie."""
    order = ["skey", "doc_id", "leaf", "tie"]
    ranged = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = settle(ranged.groupBy("skey", "part").agg(F.count("*").alias("n_part")), "merkle-counts")
    per = settle(counts.groupBy("skey").agg(F.sum("n_part").alias("n")), "merkle-sizes")
    numbered = with_number(per, [F.col("skey")], "s").select("skey", F.col("s").cast("long").alias("s"), "n", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    before = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a source
    starts = counts.withColumn("start", F.coalesce(F.sum("n_part").over(before), F.lit(0))).join(numbered.hint("merge"), "skey")
    return ranged, settle(starts.select("skey", "part", "start", "s", "n", "blocks"), "merkle-sources")


def _blocks(ranged: DataFrame, starts: DataFrame, fanout: int) -> DataFrame:
    """A row for each block: s, block, n, blocks, leaves (doc_id, leaf, bad), low (the hashes above the leaves), hash."""
    inside = F.row_number().over(W.partitionBy("skey", "part").orderBy("doc_id", "leaf", "tie")) - 1
    placed = ranged.withColumn("inside", inside).join(checked(starts), ["skey", "part"]).withColumn("pos", F.col("start") + F.col("inside"))
    size = fanout**2
    held = placed.groupBy("s", F.expr(f"pos div {size}").alias("block")).agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "bad"))).alias("leaves"))
    hashes = F.col("leaves.leaf")
    runs = F.sequence(F.lit(0), F.expr(f"(size(leaves) - 1) div {fanout}"))
    low = F.transform(runs, lambda i: digest(_joined(hashes, i * fanout + 1, fanout)))
    top = F.when(F.col("n") == 1, hashes[0]).when(F.col("n") <= fanout, F.col("low")[0]).otherwise(digest(F.concat_ws("", "low")))
    return settle(held.withColumn("low", low).withColumn("hash", top), "merkle-blocks")


def exchange(state: DataFrame, most: Column, fanout: int) -> DataFrame:
    """One round. state: tree, node, nodes (of the tree), place and held (this block's place below the node, blocks below it),
    hash (the node's), steps, and s, block. ``most``: the blocks below the largest child of the node's parent.

    Where a tree has one node already, its rows stay as they are.
    """
    parent, digit = F.expr(f"node div {fanout}"), F.expr(f"node % {fanout}")
    lanes = F.when(F.col("nodes") > 1, F.sequence(F.col("place"), most - 1, F.col("held"))).otherwise(F.array("place"))
    sent = state.withColumns({"parent": parent, "digit": digit}).withColumn("lane", F.explode(lanes))
    mine = F.when(F.col("lane") == F.col("place"), F.struct("s", "block", "place", "steps"))
    groups = sent.groupBy("tree", "parent", "lane").agg(F.first("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct("digit", "hash", "held", mine.alias("mine")))).alias("kids"))
    kids, hashes = F.col("kids"), F.col("kids.hash")
    up = F.when(F.col("nodes") > 1, digest(F.concat_ws("", hashes))).otherwise(hashes[0])
    total = lambda upto: F.aggregate(F.slice("kids", 1, upto), F.lit(0).cast("long"), lambda a, x: a + x["held"])
    step = _around(hashes, F.lit(0), F.col("kid.digit").cast("int"), fanout)
    out = groups.select("tree", "parent", "nodes", kids.alias("kids"), up.alias("hash"), F.explode(F.filter(kids, lambda k: k["mine"].isNotNull())).alias("kid"))
    more = F.col("nodes") > 1
    return out.select(
        "tree", F.col("parent").alias("node"), F.when(more, F.expr(f"(nodes + {fanout - 1}) div {fanout}")).otherwise(F.col("nodes")).alias("nodes"),
        F.when(more, F.col("kid.mine.place") + total(F.col("kid.digit").cast("int"))).otherwise(F.col("kid.mine.place")).alias("place"), F.when(more, total(F.size("kids"))).otherwise(F.col("kid.held")).alias("held"),
        "hash", F.when(more, F.concat("kid.mine.steps", F.array(step))).otherwise(F.col("kid.mine.steps")).alias("steps"), F.col("kid.mine.s").alias("s"), F.col("kid.mine.block").alias("block"),
    )


def _rounds(nodes: int, fanout: int) -> int:
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // fanout), n + 1
    return n


def _upper(blocks: DataFrame, starts: DataFrame, fanout: int) -> DataFrame:
    """s, block, steps (above the block), subroot, root."""
    per = settle(starts.select("s", "blocks").distinct(), "merkle-trees")
    ends = per.agg(F.max("blocks").alias("blocks"), F.count("*").alias("sources")).first()
    state = blocks.select(F.col("s").alias("tree"), F.col("block").alias("node"), F.col("blocks").alias("nodes"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("held"), "hash", F.array().cast(f"array<{STEP}>").alias("steps"), "s", "block")
    for r in range(_rounds(ends.blocks, fanout)):
        # all children of a parent but the tree's last node are full
        several = F.least(F.col("nodes") - F.expr(f"node div {fanout} * {fanout}"), F.lit(fanout)) > 1
        state = settle(exchange(state, F.when(several, F.lit(fanout**r)).otherwise(F.col("held")), fanout), "merkle-round")
    state = state.select(F.lit(0).cast("long").alias("tree"), F.col("s").alias("node"), F.lit(ends.sources).cast("long").alias("nodes"), F.col("block").alias("place"), F.col("held"), "hash", "steps", "s", "block", F.col("hash").alias("subroot"))
    subroots = state.filter("block = 0").select("s", "subroot")
    state = state.drop("subroot")
    held = per.select(F.col("s").alias("node"), F.col("blocks").alias("held"))
    for _ in range(_rounds(ends.sources, fanout)):
        up = held.groupBy(F.expr(f"node div {fanout}").alias("up")).agg(F.max("held").alias("most"), F.sum("held").alias("all"))
        up = settle(up, "merkle-lanes")
        widest = state.join(checked(up).drop("all"), F.expr(f"node div {fanout}") == F.col("up"))
        state = settle(exchange(widest, F.col("most"), fanout), "merkle-round")
        held = up.select(F.col("up").alias("node"), F.col("all").alias("held"))
    return state.select("s", "block", "steps", F.col("hash").alias("root")).join(checked(settle(subroots, "merkle-subroots")), "s")


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row for each block of the tree: s (number of the source), block, n (leaves of the source), leaves (pos, doc_id, leaf, bad),
    low (hashes of the block's runs), steps (proof of the block), subroot, root. rows: source, doc_id, leaf, bad (another hash for the same place, or null)."""
    key = F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n"))
    rows = settle(rows.select(key.alias("skey"), "doc_id", "leaf", "bad", F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    if not rows.take(1):
        return rows.sparkSession.createDataFrame([], f"s long, block long, n long, leaves array<struct<pos:long,doc_id:long,leaf:string,bad:string>>, low array<string>, steps array<{STEP}>, subroot string, root string")
    ranged, starts = _sources(rows, fanout**2)
    blocks = _blocks(ranged, starts, fanout)
    return blocks.select("s", "block", "n", "leaves", "low").join(_upper(blocks, starts, fanout).hint("merge"), ["s", "block"])


def proofs(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row for each leaf: doc_id, leaf, bad, subroot, root, steps (its whole proof)."""
    leaves, low = F.col("leaves.leaf"), F.col("low")

    def whole(i):
        run, place = F.floor(i / fanout).cast("int"), (i % fanout).cast("int")
        first = F.when(F.col("n") > 1, F.array(_around(leaves, run, place, fanout))).otherwise(F.array().cast(f"array<{STEP}>"))
        second = F.when(F.col("n") > fanout, F.array(_around(low, F.lit(0), run, fanout))).otherwise(F.array().cast(f"array<{STEP}>"))
        return F.concat(first, second, F.col("steps"))

    at = blocks.select("subroot", "root", "n", "leaves", "low", "steps", F.posexplode("leaves").alias("i", "own"))
    return at.select(F.col("own.doc_id").alias("doc_id"), F.col("own.leaf").alias("leaf"), F.col("own.bad").alias("bad"), "subroot", "root", whole(F.col("i")).alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof_hash(steps: Column) -> Column:
    return digest(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["before"], s["after"]))))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("source", "doc_id", leaf_of().alias("leaf"), F.when(hit, leaf_of(text=lower)).alias("bad"))
    got = proofs(manifest(rows))
    out = got.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("bad", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no crc32: it is folded over the digits, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf_sql(text: str) -> str:
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


OP13_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
t AS (SELECT 0 AS lvl, s, pos AS i, leaf AS h, n FROM l
  UNION ALL SELECT lvl + 1, s, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM t WHERE n > 1 GROUP BY lvl, s, i // 16),
subroots AS (SELECT s, h AS subroot, lvl AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, s AS i, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM u WHERE n > 1 GROUP BY lvl, i // 16),
r AS (SELECT h AS root, lvl AS height FROM u WHERE n = 1),
a AS (SELECT x.lvl, x.s, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS z
  FROM t x JOIN t y ON x.lvl = y.lvl AND x.s = y.s AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY ALL),
v AS (SELECT x.lvl, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS z
  FROM u x JOIN u y ON x.lvl = y.lvl AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY ALL),
p AS (SELECT l.s, l.pos, a.lvl AS lv, a.b, a.z FROM l JOIN a ON a.s = l.s AND a.i = l.pos // CAST(pow(16, a.lvl) AS BIGINT)
  UNION ALL SELECT l.s, l.pos, q.height + v.lvl, v.b, v.z FROM l JOIN subroots q ON q.s = l.s JOIN v ON v.i = l.s // CAST(pow(16, v.lvl) AS BIGINT)),
f AS (SELECT l.s, l.pos, 0 AS lv, coalesce(bad, leaf) AS h FROM l UNION ALL SELECT f.s, f.pos, f.lv + 1, sha256(p.b || f.h || p.z) FROM f JOIN p ON p.s = f.s AND p.pos = f.pos AND p.lv = f.lv),
g AS (SELECT s, pos, sha256(coalesce(string_agg(b || z, '' ORDER BY lv), '')) AS proof_sha256 FROM p GROUP BY s, pos)
SELECT l.doc_id, l.leaf, q.subroot, r.root, coalesce(g.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM l JOIN subroots q ON q.s = l.s CROSS JOIN r LEFT JOIN g ON g.s = l.s AND g.pos = l.pos JOIN f ON f.s = l.s AND f.pos = l.pos AND f.lv = q.height + r.height"""
