"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one process with all tasks gets a
    temporary folder; on a cluster that is an error, as executors do not see each other's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dir[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str, **options) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: it is made once, and its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked for broadcasting up to a number of (narrow) rows, to be merged beyond it. ``df`` is written."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*cols: Column) -> Column:
    """A hash of 60 bits, the leading 15 hexadecimal digits of MD5, that any SQL engine can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])), 1, 15), 16, 10).cast("long")


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)
