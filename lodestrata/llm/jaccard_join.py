"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (see ``shingles``); two are linked at a Jaccard similarity
of 0.8 or more. Texts with the same set are copies: one stands for them, with their number.

1. MinHash signatures of 128 values are cut into 32 bands of 4; two sets of similarity 0.8
   share none of them with a chance of 5e-8. Documents that meet in a band are candidates.
2. A pair's MinHash values are compared 16 at a time. With m of n equal, the posterior of the
   similarity (uniform prior) is Beta(m + 1, n - m + 1), and the pair goes as soon as its chance
   of reaching 0.8 is below 1e-6.
3. What is left falls into clusters (connected components). A cluster's shingle sets meet in
   cells of at most some 512 x 512 texts, fewer of long ones, where the surviving pairs are verified exactly. A cell returns
   how many links each text has and a spanning forest of them, never the pairs.

Bands in which more than 32 texts meet are not expanded into pairs: their texts form one
cluster, and only pairs from different ones are formed in smaller bands. So a group of thousands of
near copies costs as many rows as it has texts, times the number of blocks it is cut into.

Defined results: null and empty texts are copies of each other and of nothing else; rows of one doc_id with unlike texts are of different classes; a text of
one to four words is one shingle; a repeated row is a copy; rows with a null doc_id take part, and a
class that has no other has a null class_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import settle, table
from lodestrata.llm.components import components
from lodestrata.llm.shingles import MinHash, shingle_hashes

HASHES, ROWS_A_BAND, STEP = 128, 4, 16
EXPANDED, BLOCK, SHINGLES_A_BLOCK = 32, 512, 2_000_000
TOLERANCE = 1e-6


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values the fewest equal ones with which P(similarity >= threshold) is at least the tolerance.

    1 - I_t(m + 1, n - m + 1), the chance under the Beta posterior, is that of at most m hits in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which pairs of signature rows are not pruned."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        equal = equal + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        keep = equal >= need[n]
        alive, equal = alive[keep], equal[keep]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _key(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def _pieces(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 256):
        yield batch.slice(at, 256)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128-bit digest of the shingle set), n (its size), sig."""

    def sign(batches):
        minhash = MinHash(HASHES)
        for batch in batches:
            for part in _pieces(batch):
                keys, n, sig = [], [], []
                for s in shingle_hashes(part.column(1)):
                    keys.append(_key(s))
                    n.append(len(s))
                    sig.append(minhash.signature(s).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["doc_id", "k1", "k2", "n", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, k1 long, k2 long, n int, sig binary")


def _clusters(reps: DataFrame, need: dict[int, int]) -> DataFrame:
    """nid, comp for the texts that may have links."""
    bands = HASHES // ROWS_A_BAND
    width = 4 * ROWS_A_BAND
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    rows = reps.filter("n > 0").select("nid", "sig", band).select("nid", F.xxhash64("band", F.expr(f"substring(sig, band * {width} + 1, {width})")).alias("bucket"))
    # written first, so that Spark may split a bucket that many texts share
    several = settle(rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("nid").alias("b")).filter("m > 1"), "bands")
    hits = settle(rows.join(several.hint("merge"), "bucket"), "band-hits")
    stars = hits.filter(F.col("m") > EXPANDED).select(F.col("nid").alias("a"), "b").distinct()
    stars = settle(components(stars), "band-stars")
    small = hits.filter(F.col("m") <= EXPANDED).join(stars.withColumnRenamed("node", "nid").hint("merge"), "nid", "left")
    met = small.groupBy("bucket").agg(F.collect_list(F.struct("nid", F.coalesce("comp", "nid").alias("comp"))).alias("x")).filter(F.size(F.array_distinct("x.comp")) > 1)
    each = met.select("x", F.explode("x").alias("p")).select(F.col("p.nid").alias("a"), F.explode(F.expr("filter(x, q -> q.nid > p.nid and q.comp <> p.comp)")).alias("q"))
    pairs = each.select("a", F.col("q.nid").alias("b")).distinct()
    sig = reps.select("nid", "sig")
    both = pairs.join(sig.withColumnsRenamed({"nid": "a", "sig": "sig_a"}).hint("merge"), "a").join(sig.withColumnsRenamed({"nid": "b", "sig": "sig_b"}).hint("merge"), "b")

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                mat = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
                keep = pa.array(survivors(*mat, need))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = both.mapInArrow(prune, "a long, b long")
    return settle(components(left.union(stars.select("node", "comp"))), "clusters")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(left) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    twice = n[col] > 1
    _, col = np.unique(col[twice], return_inverse=True)
    owner = owner[twice]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[owner[lo:hi], col[lo:hi] - at] = 1
        both += m @ m.T
    return both[left, right].astype(np.int64)


def _verified(nodes: list[dict], crossing: bool, threshold: float, need: dict[int, int]) -> list[tuple[int, int, int]]:
    """(nid, links, another nid of its class in this cell) for the texts of a cell that have links."""
    sets = [np.frombuffer(x["shingles"], dtype=np.uint64) for x in nodes]
    sig = np.frombuffer(b"".join(x["sig"] for x in nodes), dtype=np.uint32).reshape(-1, HASHES)
    blk, copies = np.array([x["blk"] for x in nodes]), np.array([x["copies"] for x in nodes], dtype=np.int64)
    a, b = np.triu_indices(len(nodes), 1)
    if crossing:
        keep = blk[a] != blk[b]
        a, b = a[keep], b[keep]
    keep = np.concatenate([survivors(sig[a[i : i + 20000]], sig[b[i : i + 20000]], need) for i in range(0, len(a), 20000)]) if len(a) else np.zeros(0, dtype=bool)
    a, b = a[keep], b[keep]
    if not len(a):
        return []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = _shared(sets, a, b)
    keep = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[keep], b[keep]
    links, root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            break
    return [(nodes[i]["nid"], int(links[i]), nodes[root[i]]["nid"]) for i in np.flatnonzero(links)]


def jaccard_links(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), links (documents at or above the threshold, copies included), class_size."""
    signed, of = _classes(docs, threshold)
    return signed.select("doc_id", "k1", "k2").join(of.hint("merge"), ["k1", "k2"]).select("doc_id", "class_id", "links", "class_size")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2 of every row; of every text k1, k2, comp, class_id, links, class_size)."""
    need = least_matches(threshold)
    signed = settle(_signed(docs), "signed")
    # a signature is the same for all rows of a key
    per = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    reps = settle(per.withColumn("nid", F.monotonically_increasing_id()), "reps")
    clusters = _clusters(reps, need)
    known = settle(clusters.join(reps.hint("merge"), F.col("node") == F.col("nid")), "cluster-texts")
    sizes = settle(known.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES_A_BLOCK)).cast("int").alias("blocks")), "cluster-sizes")
    nodes = known.join(sizes.hint("merge"), "comp")
    nodes = settle(nodes.select("comp", "nid", "rep", "k1", "k2", "copies", "sig", "blocks", F.pmod(F.xxhash64("nid"), "blocks").cast("int").alias("blk")), "nodes")

    def again(batches):
        for batch in batches:
            for part in _pieces(batch):
                got = list(shingle_hashes(part.column(0)))
                keys = [_key(s) for s in got]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["k1", "k2", "shingles"])

    wanted = nodes.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_rep")), "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    sets = texts.mapInArrow(again, "k1 long, k2 long, shingles binary").dropDuplicates(["k1", "k2"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = nodes.join(sets.hint("merge"), ["k1", "k2"]).select("comp", "nid", "copies", "sig", "shingles", "blk", other.alias("o"))
    cells = cells.select("comp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "nid", "copies", "sig", "shingles", "blk")

    def rows_of(batches):
        for batch in batches:
            for part in _pieces(batch):
                yield from part.to_pylist()

    def verify(batches):
        out = []
        for (_, i, j), group in groupby(rows_of(batches), key=lambda r: (r["comp"], r["i"], r["j"])):
            out += _verified(list(group), i != j, threshold, need)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["nid", "links", "other"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["nid", "links", "other"])

    found = settle(cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(verify, "nid long, links long, other long"), "links")
    linked = found.groupBy("nid").agg(F.sum("links").alias("more"))
    classes = settle(components(found.select(F.col("nid").alias("a"), F.col("other").alias("b"))), "classes")
    of = reps.select("k1", "k2", "nid", "rep", "copies").join(classes.withColumnRenamed("node", "nid").hint("merge"), "nid", "left").join(linked.hint("merge"), "nid", "left")
    of = of.withColumn("comp", F.coalesce("comp", "nid"))
    whole = of.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    of = settle(of.join(whole.hint("merge"), "comp").select("k1", "k2", "comp", "class_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "class_size"), "text-classes")
    return signed, of


def one_of_each_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without near duplicates: of each class the row of the least doc_id, null last, and of those the one of the least text key."""
    signed, of = _classes(docs, threshold)
    mine = signed.select("doc_id", "k1", "k2").join(of.select("k1", "k2", "comp", "class_id").hint("merge"), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = mine.groupBy("comp").agg(F.min(F.struct("k1", "k2", "doc_id")).alias("k")).select(F.col("k.k1").alias("_k1"), F.col("k.k2").alias("_k2"), F.col("k.doc_id").alias("_kept"))
    often = signed.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    kept = settle(kept.join(often.hint("merge"), kept["_kept"].eqNullSafe(often["_kept"])).select("_k1", "_k2", kept["_kept"], "_rows"), "kept")
    of_kept = lambda some: docs.join(some.select("_kept").distinct().hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    alone = of_kept(kept.filter("_rows = 1"))
    # a doc_id of several rows: only these texts are read again for their keys, and of rows with one key one is taken
    several = kept.filter("_rows > 1")
    keyed = _keyed(of_kept(several))
    one = keyed.join(several.hint("merge"), (F.col("_k1") == F.col("_k1_")) & (F.col("_k2") == F.col("_k2_")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    return alone.unionByName(one.dropDuplicates(["_k1_", "_k2_"]).select(*docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with _k1_ and _k2_, the digest of their shingle set."""

    def key(batches):
        for batch in batches:
            for part in _pieces(batch):
                text = part.column("text").fill_null("")
                keys = [_key(s) for s in shingle_hashes(text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())], names=[*part.schema.names, "_k1_", "_k2_"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(key, f"{shape}, _k1_ long, _k2_ long")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))
