"""An idempotent upsert sink of records in namespaces, and checks of files against a manifest.

A sink is a folder with ``data``, partitioned by (commit, namespace), and ``manifest``, which says for
every version which commit holds a namespace. A batch rewrites the namespaces that it touches into a commit of its own and then appends
a whole new version of the manifest as one file; until that file is there nothing of the batch can be seen,
so an interrupted batch leaves the old state, and running it again makes it whole. A batch whose number is
not above the last one's is not applied again.

Defined results: the last write of a record counts, within a batch the one with the greatest values; a null namespace is a namespace; records
with a null id are dropped; an empty batch touches nothing but counts as applied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, batch long, commit string, namespace string, empty boolean"


def _schema(columns: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(columns).fields, T.StructField("commit", T.StringType())])


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not be there yet: an empty write begins it."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields])
    none.write.mode("append").parquet(path)
    return spark.read.schema(wanted).parquet(path)


def _latest(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(version, batch, the commit of each namespace) of the newest manifest."""
    manifest = _read(spark, f"{path}/manifest", MANIFEST)
    last = manifest.agg(F.max_by(F.struct("version", "batch"), "version").alias("v")).first().v
    if last is None:
        return 0, -1, manifest.select("commit", "namespace")
    return last.version, last.batch, manifest.filter((F.col("version") == last.version) & ~F.col("empty")).select("commit", "namespace")


def read_records(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The records of the newest version. ``columns`` as given to ``upsert``, in DDL, with record_id and namespace."""
    held = _latest(spark, path)[2].select(F.col("commit").alias("_c"), F.col("namespace").alias("_n"))
    data = spark.read.schema(_schema(columns)).parquet(f"{path}/data")
    return data.join(F.broadcast(held), (F.col("commit") == F.col("_c")) & F.col("namespace").eqNullSafe(F.col("_n")), "left_semi").drop("commit")  # a row for each namespace


def upsert(batch: DataFrame, path: str, number: int, columns: str) -> bool:
    """Applies batch ``number`` (record_id, namespace and the other columns); whether it was applied."""
    spark = batch.sparkSession
    names = [f.name for f in T.StructType.fromDDL(columns).fields]
    version, last, held = _latest(spark, path)
    if number <= last:
        return False
    new = batch.select(*names).filter(F.col("record_id").isNotNull())
    touched = new.select("namespace").distinct().withColumnRenamed("namespace", "_n")
    rows = new.withColumn("_new", F.lit(1))
    if version:
        old = read_records(spark, path, columns).join(F.broadcast(touched), F.col("namespace").eqNullSafe(F.col("_n")), "left_semi").withColumn("_new", F.lit(0))
        rows = old.unionByName(rows)
    body = F.struct("_new", *[c for c in names if c not in ("record_id", "namespace")])
    one = rows.groupBy("record_id", "namespace").agg(F.max(body).alias("_b")).select("record_id", "namespace", "_b.*").drop("_new")
    commit = uuid.uuid4().hex
    one.select(*names, F.lit(commit).alias("commit")).write.mode("append").partitionBy("commit", "namespace").parquet(f"{path}/data")
    made = spark.read.schema(_schema(columns)).parquet(f"{path}/data").filter(F.col("commit") == commit).select("commit", "namespace").distinct()
    kept = held.join(F.broadcast(touched), F.col("namespace").eqNullSafe(F.col("_n")), "left_anti")
    state = kept.unionByName(made).withColumn("empty", F.lit(False)).unionByName(spark.range(1).select(F.lit("").alias("commit"), F.lit(None).cast("string").alias("namespace"), F.lit(True).alias("empty")))
    state.select(F.lit(version + 1).cast("long").alias("version"), F.lit(number).cast("long").alias("batch"), "commit", "namespace", "empty").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def file_checks(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """relative_path, status (match, hash_differs, missing, empty_or_missing, not_listed), expected and actual SHA-256 of the files below ``root`` and of those that the manifest
    (relative_path, sha256) lists. A file is hashed where it is read; only hashes are joined. Spark's scan passes over files without bytes, so one that
    is listed with the hash of no bytes is ``empty_or_missing``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), rf"^.*\Q{root.rstrip('/').split(':')[-1].lstrip('/')}\E/", "")
    actual = found.select(relative.alias("relative_path"), F.sha2("content", 256).alias("actual"))
    both = manifest.select("relative_path", F.lower("sha256").alias("expected"), F.lit(True).alias("listed")).join(actual.hint("merge"), "relative_path", "full")
    status = F.when(F.col("listed").isNull(), "not_listed").when(F.col("actual").isNull(), F.when(F.col("expected") == F.sha2(F.lit("").cast("binary"), 256), "empty_or_missing").otherwise("missing")).when(F.col("actual").eqNullSafe(F.col("expected")), "match").otherwise("hash_differs")
    return both.select("relative_path", status.alias("status"), "expected", "actual")
