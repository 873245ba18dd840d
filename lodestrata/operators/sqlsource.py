"""Guarding and running SQL texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a read-only statement may not have.
FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "create", "attach", "pragma", "begin", "commit", "rollback", "replace", "truncate"]


def guard_reason(sql: Column) -> Column:
    """Why a statement is refused, '' if it may run."""
    bare = F.regexp_replace(sql, r"^\s+|\s+$", "")
    low = F.lower(bare)
    n = F.size(F.filter(F.split(bare, ";"), lambda x: F.trim(x) != ""))
    out = F.when(bare == "", "empty").when(n != 1, "not_single").when(~(low.startswith("select") | low.startswith("with")), "not_select")
    for word in FORBIDDEN:
        out = out.when(low.rlike(rf"\b{word}\b"), f"forbidden_{word}")
    return out.otherwise("")


def guarded_statement(sql: Column) -> Column:
    return F.trim(F.get(F.filter(F.split(sql, ";"), lambda x: F.trim(x) != ""), F.lit(0)))


def execute_limited(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """Runs one guarded statement over views of the tables; the row limit is the feature."""
    reason = spark.range(1).select(guard_reason(F.lit(sql))).first()[0]
    if reason:
        raise ValueError(reason)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql).limit(limit)
