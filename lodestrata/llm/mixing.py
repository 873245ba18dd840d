"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 60-bit hash. For a source, "take the hashes below T" is a nested family of
samples, so a budget of words is met by finding T: sizes are summed by (source, leading bits
of the hash), and the bucket in which the running sum passes the budget is refined by its
next 12 bits, and only that one, until single hashes are left. No row is sorted.

T alone meets a budget only to within one document. What it leaves is filled by further
thresholds, each over rows that are not taken yet and no larger than what is
missing; the last one also takes the row at its threshold where that comes nearer.

Defined results: a null text has size 0; a null source is a source of its own and comes last;
rows with an equal doc_id have an equal hash and are taken together or not at all; sources
without words have target 0; an empty table gives an empty result. Columns of the input other
than doc_id, text and source are carried along untouched by ``mix``; its working columns start
with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import hash60, n_words, settle, table

BITS, STEP = 60, 12
FILLS = 4
SHARE = 1
#: Sources up to this number are broadcast (some 100 bytes each); more are joined by shuffling.
FEW_SOURCES = 100_000


def _source_key(source: Column) -> Column:
    """Not null, in the order of code points, null last."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("w"))


def attached(rows: DataFrame, per_source: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    few = F.broadcast(per_source) if n_sources <= FEW_SOURCES else per_source.hint("merge")
    return rows.join(few, "_mix_key", how)


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """Per source key: source_size and target. rows: _mix_key, size.

    A target above ``ceiling`` times its source's size stops there, and the rest is shared again
    by weight. That ends with min(ceiling * size, level * weight) for one level. In the order of
    ceiling * size / weight the stopped sources come first, so running sums give the level. The
    windows hold one row for each source.
    """
    picks = F.array(*[F.lit(float(w)) for w in weights])
    every, order = W.partitionBy(), W.orderBy("ratio", "_mix_key").rowsBetween(W.unboundedPreceding, -1)
    per = (
        rows.groupBy("_mix_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(picks, (F.row_number().over(W.orderBy("_mix_key")) - 1) % len(weights) + 1))
        .withColumn("stop", F.col("source_size") * ceiling)
        .withColumn("ratio", F.col("stop") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(order), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("stopped")) / F.col("weight_left"))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "_mix_key"))).over(every))
    )
    return per.select("_mix_key", "source_size", F.coalesce(F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """Per source key with rows beyond its budget: the range of hashes [low, high) at which they pass it, the words
    below it and in it. The range holds one hash that occurs, or none of its rows can be told apart.

    rows: _mix_key, hash, size; budgets: _mix_key, budget.
    """
    at = budgets.select("_mix_key", "budget", F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("below"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows if shift == BITS - STEP else attached(rows, at.select("_mix_key", "hit"), n_sources).filter(F.shiftright("hash", shift + STEP) == F.col("hit"))
        sums = inside.groupBy("_mix_key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = W.partitionBy("_mix_key").orderBy("bucket")
        upto = F.col("below") + F.col("upto")
        over = attached(sums.withColumn("upto", F.sum("words").over(run)), at.select("_mix_key", "budget", "below"), n_sources).filter(upto > F.col("budget"))
        first = F.min_by(F.struct("bucket", "words", "n", (upto - F.col("words")).alias("below")), "bucket")
        found = over.groupBy("_mix_key").agg(F.first("budget").alias("budget"), first.alias("f"))
        at = settle(found.select("_mix_key", "budget", F.col("f.bucket").alias("hit"), F.col("f.below").alias("below"), F.col("f.words").alias("words"), F.col("f.n").alias("n")), "mix-level")
        if (at.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    return at.select("_mix_key", "budget", "below", "words", F.shiftleft("hit", shift).alias("low"), F.shiftleft(F.col("hit") + 1, shift).alias("high"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(rows, per source, number of sources). rows: doc_id, _mix_key, size, hash; per source: source_size, target, times
    (how often every row is taken) and the nested thresholds by which a row is taken once more: t1, cap2, t2, ..."""
    rows = settle(docs.select("doc_id", _source_key(F.col("source")).alias("_mix_key"), n_words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash")), "mix-rows")
    per = settle(source_targets(rows, weights, ceiling), "mix-targets")
    n_sources = per.count()
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("times", times).withColumn("left", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    left = rows.filter("size > 0")
    for fill in range(1, FILLS + 1):
        cap = F.lit(2**62) if fill == 1 else F.floor(F.col("left") / SHARE)
        per = per.withColumn(f"cap{fill}", cap.cast("long"))
        untaken = attached(left, per, n_sources).filter((F.col("size") <= F.col(f"cap{fill}")) & ~_taken_once_more(fill - 1)).select("_mix_key", "hash", "size")
        hits = thresholds(untaken, per.select("_mix_key", F.col("left").alias("budget")), n_sources).withColumnRenamed("budget", "_budget")
        sums = untaken.groupBy("_mix_key").agg(F.sum("size").alias("_all"))
        nearer = F.col("words") - (F.col("_budget") - F.col("below")) < F.col("_budget") - F.col("below")
        t = F.when(F.col("low").isNull(), F.lit(2**60)).otherwise(F.when(nearer, F.col("high")).otherwise(F.col("low")) if fill == FILLS else F.col("low"))
        joined = per.join(hits.hint("merge"), "_mix_key", "left").join(sums.hint("merge"), "_mix_key", "left")
        rest = F.col("left") - F.coalesce(F.when(F.col("low").isNull(), F.col("_all")).otherwise(F.col("below")), F.lit(0))
        per = settle(joined.select(*[c for c in per.columns if c != "left"], t.cast("long").alias(f"t{fill}"), rest.cast("long").alias("left")), "mix-fill")
    return rows, per, n_sources


def _taken_once_more(fills: int = FILLS) -> Column:
    hit = F.lit(False)
    for fill in range(1, fills + 1):
        hit = hit | ((F.col("size") <= F.col(f"cap{fill}")) & (F.col("hash") < F.col(f"t{fill}")))
    return hit


def _copies() -> Column:
    return F.col("times") + _taken_once_more().cast("long")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words that the mix takes of it)."""
    rows, per, n = plan(docs, weights, ceiling)
    return attached(rows, per, n).select("doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    _, per, n = plan(docs, weights, ceiling)
    per = per.select(*[F.col(c).alias(f"_mix_{c}" if c != "_mix_key" else c) for c in per.columns])
    keyed = docs.withColumns({"_mix_key": _source_key(F.col("source")), "_mix_size": n_words(F.col("text")), "_mix_hash": hash60(F.col("doc_id"))})
    more = F.lit(False)
    for fill in range(1, FILLS + 1):
        more = more | ((F.col("_mix_size") <= F.col(f"_mix_cap{fill}")) & (F.col("_mix_hash") < F.col(f"_mix_t{fill}")))
    copies = (F.col("_mix_times") + more.cast("long")).cast("int")
    taken = attached(keyed, per, n).withColumn("_mix_copies", copies).filter("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def _fill_sql(n: int, last: bool) -> str:
    cap = "9223372036854775807" if n == 1 else f"floor(left{n - 1} / {SHARE})"
    old = " OR ".join(f"m{i}" for i in range(1, n)) or "false"
    near = f" OR (c{n} > left{n - 1} AND coalesce(p{n}, 0) <= left{n - 1} AND c{n} - left{n - 1} < left{n - 1} - coalesce(p{n}, 0))" if last else ""
    return f"""
a{n} AS (SELECT *, CASE WHEN size > 0 AND NOT ({old}) AND size <= {cap} THEN size ELSE 0 END AS s{n},
  size > 0 AND NOT ({old}) AND size <= {cap} AS ok{n} FROM f{n - 1}),
b{n} AS (SELECT *, sum(s{n}) OVER (PARTITION BY k ORDER BY h RANGE UNBOUNDED PRECEDING) AS c{n},
  sum(s{n}) OVER (PARTITION BY k, h) AS w{n} FROM a{n}),
d{n} AS (SELECT *, c{n} - w{n} AS p{n} FROM b{n}),
e{n} AS (SELECT *, ok{n} AND (c{n} <= left{n - 1}{near}) AS m{n} FROM d{n}),
f{n} AS (SELECT *, left{n - 1} - sum(CASE WHEN m{n} THEN size ELSE 0 END) OVER (PARTITION BY k) AS left{n} FROM e{n})"""


OP1_SQL = (
    r"""WITH r AS (SELECT doc_id, coalesce('v' || source, 'w') AS k,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) END AS BIGINT) AS size,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY k),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS stop FROM s),
q AS (SELECT *, stop / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM q WINDOW o AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, coalesce(least(CAST(stop AS DOUBLE), (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1) * weight), 0.0) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
f0 AS (SELECT r.*, source_size, target, times, floor(target - times * source_size) AS left0 FROM r JOIN u USING (k)),"""
    + ",".join(_fill_sql(n, n == FILLS) for n in range(1, FILLS + 1))
    + f"""
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN {' OR '.join(f'm{n}' for n in range(1, FILLS + 1))} THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f{FILLS}"""
)
