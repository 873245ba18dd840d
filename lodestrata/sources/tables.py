"""Typed scans, the table catalog, corpus checks and the artifact sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_typed_csv(spark, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; blank cells are null and only the declared columns are kept, so the tail of a row with too many goes."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").csv(path)


def typed_rows(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for a column of CSV lines."""
    row = F.from_csv(column, schema, {"nullValue": "", "mode": "PERMISSIVE"})
    return lines.select(row.alias("r")).select("r.*")


def write_artifact(df: DataFrame, path: str, run_id: str, kind: str = "parquet") -> None:
    """Writes a stage's output below ``path``, in a folder for the run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(kind).save(path)


def read_artifact(spark, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """All runs of an artifact, with their run_id."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])).format(kind).load(path)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count, columns of each table, which also becomes a temporary view."""
    out = None
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def schema_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, type, position, row_count, null_count of every column; a table is read once, for one row of counts."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
        each = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(i + 1).alias("position"), (F.col("_rows") - F.col(f"_{i}")).alias("null_count")) for i, f in enumerate(df.schema.fields)]
        one = counts.select(F.lit(name).alias("table_name"), F.col("_rows").alias("row_count"), F.explode(F.array(*each)).alias("c")).select("table_name", "c.column_name", "c.type", "c.position", "row_count", "c.null_count")
        out = one if out is None else out.unionByName(one)
    return out


def media_type(name: Column) -> Column:
    return F.when(name.endswith(".pdf"), "application/pdf").when(name.endswith(".csv"), "text/csv").otherwise("text/html")


def validate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """check_id, status, details (offending rows, or rows for ``table_not_empty``). One pass over the documents gives all their checks."""
    counts = docs.agg(
        (F.count("*") - F.count_distinct("doc_id")).alias("unique_doc_ids"),
        F.count_if(F.col("text").isNull()).alias("text_present"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("length_matches"),
        F.count("*").alias("table_not_empty"),
    )
    names = counts.columns
    long = counts.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)})").alias("check_id", "details"))
    orphan = labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.lit("labels_have_documents").alias("check_id"), F.count("*").alias("details"))
    ok = F.when(F.col("check_id") == "table_not_empty", F.col("details") > 0).otherwise(F.col("details") == 0)
    return long.unionByName(orphan).select("check_id", F.when(ok, "pass").otherwise("fail").alias("status"), "details")
