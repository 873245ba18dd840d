"""Secret scans with an incremental ledger of blobs.

Every historical version of every path is named by its content: a *blob* is a distinct text, known by
its SHA-256. The ledger is a table that says for a blob which rule versions it was scanned with and
what they found. A scan takes the blobs of the given versions, drops the pairs of blob and
rule version that the ledger has, runs the rest and appends the result; findings are then joined
back to all paths and versions that hold the blob. A copy costs nothing, a new rule or a new
version of one runs that rule alone over the old blobs, and nothing is scanned twice.

A ledger row is whole (one blob, the rules it was scanned with, what they found), so a scan that was
stopped leaves pairs that are simply not there and are scanned by the next one; two scans at once can write a pair twice, which
reads as once. Rules are regular expressions; a match counts if a group of it has so many characters. Matches are the
leftmost ones without overlap, and their places, in code points, are sums over the pieces between them.

Everything is made of DataFrame operations. Texts move once, by blob, after equal ones of a task are merged.

Defined results: a null text is empty; repeated rows are each reported; equal starts are in the
order of the rules; findings of rule versions that are not asked for stay in the ledger and are not
reported; an empty table gives an empty result; other columns of the input are carried along, but
``blob`` and ``found`` are those of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import new_path, settle, table

SPAN = "struct<rule:string,start:long,end:long>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters. Raise ``version`` with any change."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Letters of either case are written out, as engines differ in what they fold beyond ASCII.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),  # 20 characters and more
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
MORE = (
    Rule("hosting", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """blob, rules (names it was scanned with), found. A ledger that does not exist is begun."""
    none = spark.range(0).select(F.lit("").alias("blob"), F.array().cast("array<string>").alias("rules"), F.array().cast(f"array<{SPAN}>").alias("found"))
    none.write.mode("append").parquet(path)
    return spark.read.schema(none.schema).parquet(path)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, todo: the distinct texts that lack a rule version in the ledger, and which."""
    text = F.coalesce("text", F.lit(""))
    blobs = versions.select(_address(F.col("text")).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    every = F.array(*[F.lit(r.name) for r in rules])
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen.hint("merge"), "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)


def _measured(r: Rule):
    """Of a match: how many characters lie between it and the one before, how many it has, whether it counts."""

    def measure(hit: Column, gap: Column) -> Column:
        counted = F.char_length(F.regexp_extract(hit, r.pattern, r.group) if r.group else hit) >= r.least
        return F.struct(F.lit(r.name).alias("rule"), F.char_length(gap).cast("long").alias("gap"), F.char_length(hit).cast("long").alias("chars"), counted.alias("counts"))

    return measure


def scanned(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the pairs in ``todo``."""
    none = F.array().cast("array<string>")
    hits = {}
    for k, r in enumerate(rules):
        hits[f"_hits{k}"] = F.when(F.array_contains("todo", r.name), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none)
    found = todo.withColumns(hits)
    parts = []
    for k, r in enumerate(rules):
        gaps = F.when(F.size(f"_hits{k}") > 0, F.slice(F.split("text", r.pattern, -1), 1, F.size(f"_hits{k}"))).otherwise(none)
        parts.append(F.zip_with(F.col(f"_hits{k}"), gaps, _measured(r)))
    rows = found.select("blob", "todo", F.posexplode_outer(F.concat(*parts)).alias("i", "hit"))
    run = W.partitionBy("blob", "hit.rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("hit.gap") + F.col("hit.chars")).over(run))
    span = F.struct(F.col("hit.rule").alias("rule"), (F.col("end") - F.col("hit.chars")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.collect_list(F.when(F.col("hit.counts"), span)).alias("found"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks of the texts in ``versions`` and appends it; the ledger afterwards."""
    spark = versions.sparkSession
    scanned(unseen(versions, read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found: of each blob with findings of the given rules, array<struct<start, nth, end, kind>> in order."""
    nth = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), nth[s["rule"]].alias("nth"), s["end"].alias("end"), kind[s["rule"]].alias("kind")))
    own = F.filter(spans, lambda s: s["nth"].isNotNull())
    some = ledger.filter(F.size("found") > 0).select("blob", own.alias("spans")).filter(F.size("spans") > 0)
    return some.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` with its blob and found, an empty array where nothing is."""
    per = settle(blob_findings(ledger, rules).withColumnRenamed("blob", "_blob"), "secret-findings")
    keyed = versions.drop("found").withColumn("blob", _address(F.col("text")))
    got = keyed.join(per.hint("merge"), F.col("blob") == F.col("_blob"), "left").drop("_blob")
    return got.withColumn("found", F.coalesce("found", F.array().cast(per.schema["found"].dataType)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = update_ledger(docs, new_path(spark, "secret-ledger"))
    got = findings(docs, ledger)
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["nth"] < len(BASE))
    return got.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _rule_sql(k: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    keep = f"strlen(regexp_extract_all(t, '{pattern}', {r.group})[i]) >= {r.least}" if r.least else "true"
    return f"""SELECT rid, {k} AS nth, '{r.kind}' AS kind, z - length(m[i]) AS a, z FROM (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS z
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0)) WHERE {keep}"""


_TEXT = "kind || ':' || a || ':' || z"
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, string_agg({_TEXT}, ',' ORDER BY a, nth) FILTER (nth < {len(BASE)}) AS base, string_agg({_TEXT}, ',' ORDER BY a, nth) AS spans FROM s GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
