"""Approximate nearest neighbours: inverted lists and adaptive dimension scan.

Vectors are put into the list of their nearest centre. A query looks into the lists of its
nearest centres: first into the nearest one alone, whose kth distance bounds what any other list
can add, then into the others under that bound. Inside a list all vectors are turned by one random rotation, and
queries and rows are compared by blocks of columns: after d' of D columns the partial distance, scaled by D / d',
estimates the whole one, and a pair goes as soon as a hypothesis test says that it is
farther than the query's bound; rows that no query needs any more leave the block. The others get their exact distance on the original
vectors in double precision.

Vectors of each length are searched among themselves. Centres are fitted on a bounded sample: the ``fit_rows`` rows (20,000) of smallest id hash; a length
with 200 of them or more (or the most common one) gets centres of its own. On the same sample it is measured how many lists hold ``aim`` of the nearest neighbours, and so
many are probed: few where vectors cluster, most where they do not. Rows of rarer lengths are compared with the queries of their length exactly, in blocks.
Every row is indexed.

Small lists share a cell, a longer one is cut by hash into cells of up to 32 MB; queries come to each cell of the lists that they probe. What is copied
depends on the demand: the rows of a group of lists are sent once for each 8 MB of queries that this group gets, and no vector that repeats, no
popular centre and no popular query makes a large task.

Rows with a component over 1e100, whose squares may not fit a double, are in a list of their own, which all queries probe; such a query probes all lists,
and distances that overflow are infinite.

Defined results: vectors that are null, empty, zero, or hold a null or not finite component
take no part, neither do rows with a null id; vectors of different lengths have no distance, so they are no candidates of each other;
a query id in several rows asks once, with the least of its vectors; a row is no candidate of a query with its own id; ties go to the smaller id; other columns of the input are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import checked, default_parallelism, settle, table
from lodestrata.llm.vectors import usable

FIT_ROWS, MOST_LISTS = 20_000, 1024
FIT_LEAST = 200
CELL_BYTES, ASK_BYTES, ROWS_AT_ONCE, QUERIES_AT_ONCE = 32 << 20, 8 << 20, 8192, 256
COLUMNS, EPS = 16, 2.1
HUGE = 1e100
RESULT = "query_id long, rank int, vec_id long, score double"


def fit_centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """k-means on the driver's bounded sample; empty lists keep their centre."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        sums, count = np.zeros_like(centres), np.bincount(near, minlength=n)
        np.add.at(sums, near, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, aim: float) -> int:
    """The fewest nearest lists that hold ``aim`` of the k nearest others of 500 of the sample's vectors."""
    ask = sample[:500]
    if len(sample) < 2:
        return len(centres)
    far = (sample**2).sum(1) - 2 * ask @ sample.T
    far[np.arange(len(ask)), np.arange(len(ask))] = np.inf
    near = np.argpartition(far, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
    lists = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
    place = ((centres**2).sum(1) - 2 * ask @ centres.T).argsort(1).argsort(1)
    rank = np.sort(np.take_along_axis(place, lists[near], axis=1), axis=None)
    return int(rank[min(len(rank) - 1, int(np.ceil(aim * len(rank))))]) + 1


def scan_block(ask: np.ndarray, rows: np.ndarray, bound: np.ndarray, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be within the queries' squared bounds, all rotated; with all ``columns`` at once none is missed."""
    dim, at = rows.shape[1], np.arange(len(rows))
    part, alive = np.zeros((len(ask), len(rows))), np.ones((len(ask), len(rows)), dtype=bool)
    for c in range(0, dim, columns):
        q, r = ask[:, c : c + columns], rows[at, c : c + columns]
        part += (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T
        seen = min(c + columns, dim)
        limit = bound if seen == dim else bound * seen / dim * (1 + EPS / np.sqrt(seen)) ** 2
        size = (ask[:, :seen] ** 2).sum(1) + limit
        alive &= part <= (limit + 1e-12 * size)[:, None]  # the last term covers what the product form rounds
        some = alive.any(0)
        if some.mean() < 0.7:
            at, part, alive = at[some], part[:, some], alive[:, some]
    query, row = np.nonzero(alive)
    return query, at[row]


def scan(q: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the k nearest of q, both rotated, under the bound that the first of them give."""
    head = ((rows[: max(4 * k, 64)] - q) ** 2).sum(1)
    if len(rows) <= len(head):
        return np.arange(len(rows))
    return np.sort(scan_block(q[None, :], rows, np.partition(head, k - 1)[k - 1 : k])[1])


def _nearest(ids: np.ndarray, ask: np.ndarray, bound: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, turn: np.ndarray | None) -> pd.DataFrame:
    """query_id, vec_id, score of the up to k nearest of some rows for each query, within the bounds on distances; exact without a rotation."""
    with np.errstate(over="ignore", invalid="ignore"):
        if max(np.abs(ask).max(initial=0.0), np.abs(rows).max(initial=0.0)) > HUGE:
            query, row = np.nonzero(np.ones((len(ask), len(rows)), dtype=bool))
        else:
            q, r = (ask, rows) if turn is None else (ask @ turn, rows @ turn)
            squared = bound**2 * (1 + 1e-9) + 1e-300
            if len(rows) > max(4 * k, 64):  # the first rows may bound it closer; one more than k, as a row may be the query
                head = (q * q).sum(1)[:, None] + (r[: 4 * k + 24] ** 2).sum(1) - 2 * q @ r[: 4 * k + 24].T
                squared = np.minimum(squared, np.partition(head, k, axis=1)[:, k] * (1 + 1e-9) + 1e-12 * (q * q).sum(1))
            query, row = scan_block(q, r, squared, COLUMNS if turn is not None else r.shape[1])
        keep = ids[query] != own[row]
        query, row = query[keep], row[keep]
        d = np.concatenate([np.empty(0), *[np.sqrt(((rows[row[a : a + 50_000]] - ask[query[a : a + 50_000]]) ** 2).sum(1)) for a in range(0, len(row), 50_000)]])
    order = np.lexsort((own[row], d, query))
    query, row, d = query[order], row[order], d[order]
    first = np.searchsorted(query, np.arange(len(ids)))
    keep = np.arange(len(query)) - first[query] < k
    return pd.DataFrame({"query_id": ids[query[keep]], "vec_id": own[row[keep]], "score": d[keep]})


def _compare(ids, ask, bound, own, rows, k, turn) -> pd.DataFrame:
    """``_nearest`` of many rows and queries by pieces; what the first pieces give bounds the next ones."""
    out = []
    for at in range(0, len(ids), QUERIES_AT_ONCE):
        part = slice(at, at + QUERIES_AT_ONCE)
        some, near = ids[part], bound[part].copy()
        for a in range(0, len(own), ROWS_AT_ONCE):
            got = _nearest(some, ask[part], near, own[a : a + ROWS_AT_ONCE], rows[a : a + ROWS_AT_ONCE], k, turn)
            out.append(got)
            full = got.groupby("query_id")["score"].agg(["size", "max"])
            full = full["max"][full["size"] == k]
            near = np.minimum(near, pd.Series(some).map(full).fillna(np.inf).to_numpy())
    return _best(out, k)


def _best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.concat(found, ignore_index=True).sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)


def _grouped(counts: dict[int, int], lists: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell group of each list, cuts of each group): small neighbouring lists share a group, a long one is cut."""
    group, cuts, held = np.zeros(lists, dtype=np.int64), [1], 0
    for i in range(lists):
        n = counts.get(i, 0)
        if held and held + n > rows:
            cuts.append(1)
            held = 0
        group[i], held = len(cuts) - 1, held + n
        cuts[-1] = max(1, -(-held // rows))
    return group, np.array(cuts)


def _matrix(vecs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(-1, dim)


def _first_k(df: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_lists(rows: DataFrame, asked: DataFrame, sample: np.ndarray, dim: int, k: int, share: float | None, lists: int | None, aim: float) -> DataFrame:
    """query_id, vec_id, score: candidates of the queries, all vectors of one length, from inverted lists."""
    spark = rows.sparkSession
    usual = sample[np.abs(sample).max(1) <= HUGE]
    sample = usual if len(usual) else np.zeros((1, dim))
    n = min(lists or int(np.sqrt(rows.count())), MOST_LISTS, len(sample)) or 1
    centres, turn = fit_centres(sample, n), rotation(dim)
    probes = min(n, max(1, int(np.ceil(share * n)) if share is not None else probes_needed(sample, centres, k, aim)))
    model = spark.sparkContext.broadcast((centres, turn))  # MOST_LISTS + dim vectors at most

    def place(batches):
        centres, _ = model.value
        for pdf in batches:
            if len(pdf):
                v = np.array(list(pdf["vec"]), dtype=np.float64).reshape(len(pdf), dim)
                huge = np.abs(v).max(1) > HUGE
                far = (centres**2).sum(1) - 2 * np.where(huge[:, None], 0.0, v) @ centres.T
                yield pd.DataFrame({"id": pdf["id"], "list": np.where(huge, n, far.argmin(1)).astype("int32"), "vec": [x.tobytes() for x in v]})

    placed = settle(rows.mapInPandas(place, "id long, list int, vec binary"), "ann-lists")
    asked = settle(asked.mapInPandas(place, "id long, list int, vec binary"), "ann-asked")
    counts = {r.list: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list, MOST_LISTS + 1 at most
    most = max(1, CELL_BYTES // (8 * dim))
    group, cuts = _grouped(counts, n + 1, int(min(most, max(512, sum(counts.values()) // (2 * default_parallelism(spark))))))

    def probed(pdf, nearest_only):
        """(place of the query, its lists) for some queries."""
        centres, _ = model.value
        v, huge = _matrix(pdf["vec"], dim), pdf["list"].to_numpy() == n
        order = np.argsort((centres**2).sum(1) - 2 * np.where(huge[:, None], 0.0, v) @ centres.T, axis=1, kind="stable")
        for i, far in enumerate(huge):
            if nearest_only:
                yield i, np.array([n] if far else order[i, :1])
            else:
                yield i, np.arange(n) if far else np.append(order[i, 1:probes], n)

    def asks_of_groups(nearest_only) -> np.ndarray:
        """How many queries each group gets."""

        def count(batches):
            sums = np.zeros(len(cuts), dtype=np.int64)
            for pdf in batches:
                for _, mine in probed(pdf, nearest_only) if len(pdf) else ():
                    sums[np.unique(group[mine])] += 1
            yield pd.DataFrame({"grp": np.flatnonzero(sums).astype("int32"), "n": sums[sums > 0]})

        out = np.zeros(len(cuts), dtype=np.int64)
        for r in asked.mapInPandas(count, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():  # a row for each group at most
            out[r.grp] = r.n
        return out

    def search(bounds, nearest_only):
        q_cuts = np.maximum(1, -(-asks_of_groups(nearest_only) // max(1, ASK_BYTES // (8 * dim))))
        some = asked.withColumn("bound", F.lit(float("inf"))) if bounds is None else asked.join(bounds.hint("merge"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

        def send(batches):
            """The queries with their bound, once for each cell that has a list to be probed."""
            for pdf in batches:
                if not len(pdf):
                    continue
                out = []
                ids, vecs, near = pdf["id"].to_numpy(), pdf["vec"].to_numpy(), pdf["bound"].to_numpy()
                for i, lists_ in probed(pdf, nearest_only):
                    of = group[lists_]
                    for g in np.unique(of):
                        mine = lists_[of == g].astype(np.int32).tobytes()
                        out += [(int(g), r, int(q_cuts[g]), ids[i], vecs[i], near[i], mine) for r in range(cuts[g])]
                yield pd.DataFrame(out, columns=["grp", "r_cut", "cut", "id", "vec", "bound", "lists"])

        def cell(_, ask, rows_):
            if not len(ask) or not len(rows_):
                return _best([], k)
            _, turn = model.value
            rows_ = rows_.sort_values(["list", "id"], kind="stable")
            ids, v, bound = ask["id"].to_numpy(), _matrix(ask["vec"], dim), ask["bound"].to_numpy()
            own, w, of = rows_["id"].to_numpy(), _matrix(rows_["vec"], dim), rows_["list"].to_numpy()
            wants = np.zeros((len(ids), n + 1), dtype=bool)
            for i, x in enumerate(ask["lists"]):
                wants[i, np.frombuffer(x, dtype=np.int32)] = True
            out = []
            for one in np.unique(of):
                mine = np.flatnonzero(wants[:, one])
                a, z = np.searchsorted(of, [one, one + 1])
                if len(mine):
                    out.append(_compare(ids[mine], v[mine], bound[mine], own[a:z], w[a:z], k, turn))
            return _best(out, k)

        sent = some.mapInPandas(send, "grp int, r_cut int, cut int, id long, vec binary, bound double, lists binary")
        left = sent.withColumn("q_cut", F.pmod(F.xxhash64("id"), "cut").cast("int"))
        told = F.broadcast(spark.createDataFrame([(i, int(g), int(cuts[g]), int(q_cuts[g])) for i, g in enumerate(group)], "list int, grp int, cuts int, q_cuts int"))
        right = placed.join(told, "list").select("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "cuts").cast("int").alias("r_cut"), F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)).alias("q_cut"), "list", "id", "vec")
        keys = ["grp", "r_cut", "q_cut"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")

    first = settle(_first_k(search(None, True), k), "ann-first")
    bounds = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    return first.drop("rank").unionByName(search(bounds, False))


def _search_rest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: candidates of queries whose lengths have no lists, every row of a length with every query of it, in blocks."""
    sizes = settle(rows.groupBy("dim").agg(F.count("*").alias("n")).join(asked.groupBy("dim").agg(F.count("*").alias("q")).hint("merge"), "dim"), "ann-lengths")
    cut = lambda of, held: F.greatest(F.lit(1), F.ceil(F.col(of) / F.greatest(F.lit(1), F.floor(F.lit(held) / (8 * F.col("dim")))))).cast("int")
    told = checked(sizes.select("dim", cut("n", CELL_BYTES).alias("r_cuts"), cut("q", ASK_BYTES).alias("q_cuts")))
    every = lambda cuts: F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))
    left = asked.join(told, "dim").select("dim", F.pmod(F.xxhash64("id"), "q_cuts").cast("int").alias("q_cut"), every("r_cuts").alias("r_cut"), "id", "vec")
    right = rows.withColumn("row", F.monotonically_increasing_id()).join(told, "dim").select("dim", F.pmod(F.xxhash64("row"), "r_cuts").cast("int").alias("r_cut"), every("q_cuts").alias("q_cut"), "id", "vec")

    def cell(_, ask, rows_):
        if not len(ask) or not len(rows_):
            return _best([], k)
        mat = lambda s: np.array(list(s), dtype=np.float64)
        return _compare(ask["id"].to_numpy(), mat(ask["vec"]), np.full(len(ask), np.inf), rows_["id"].to_numpy(), mat(rows_["vec"]), k, None)

    keys = ["dim", "r_cut", "q_cut"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")


def nearest_rows(rows: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10, share: float | None = None, fit_rows: int = FIT_ROWS, lists: int | None = None, aim: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found in ``share`` of the lists, or in as many as the sample says."""
    found = rows.filter(usable(F.col(vec_col), nonzero=True) & F.col(id_col).isNotNull())
    found = found.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("q"))
    picked = found.select("id", "dim", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(fit_rows).toPandas()
    if not len(picked):
        return rows.sparkSession.createDataFrame([], RESULT)
    asked = settle(found.filter("q").groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("dim"), "vec"), "ann-queries")
    found, sizes = found.drop("q"), picked["dim"].value_counts()
    fitted = [int(d) for d, n in sizes.items() if n >= FIT_LEAST or d == sizes.index[0]]
    near = [_search_lists(found.filter(F.col("dim") == d), asked.filter(F.col("dim") == d), np.array(list(picked["vec"][picked["dim"] == d])), d, k, share, lists, aim) for d in fitted]
    others = asked.filter(~F.col("dim").isin(fitted))
    if not others.isEmpty():
        near.append(_search_rest(found.filter(~F.col("dim").isin(fitted)), others, k))
    every = near[0]
    for more in near[1:]:
        every = every.unionByName(more)
    return _first_k(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
