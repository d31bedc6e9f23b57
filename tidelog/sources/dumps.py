"""Export and import of live rows: JSON lines, Parquet, framed binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytesx import PUT, hex_lower, text_or_null
from tidelog.operators.kv import live
from tidelog.sources import framed


def export_json(log: DataFrame, path: str) -> None:
    """Live rows of every namespace, bytes in hex, with their time to live."""
    rows = live(log).select(hex_lower(F.col("ns")).alias("ns"), hex_lower(F.col("key")).alias("key"), hex_lower(F.col("value")).alias("value"), "ts_ns", "ttl_s")
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export as puts, ready to be appended."""
    rows = spark.read.schema("ns string, key string, value string, ts_ns bigint, ttl_s bigint").json(path)
    return rows.select(F.unhex("ns").alias("ns"), F.unhex("key").alias("key"), F.unhex("value").alias("value"), F.lit(PUT).cast("tinyint").alias("op"), "ts_ns", F.coalesce("ttl_s", F.lit(0)).alias("ttl_s"))


def as_text(log: DataFrame) -> DataFrame:
    """``ns``, ``key`` and the value as text, null where it isn't valid UTF-8."""
    return live(log).select("ns", "key", text_or_null(F.col("value")).alias("value"))


def export_parquet(log: DataFrame, path: str) -> None:
    as_text(log).write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_binary(log: DataFrame, path: str, rotate_bytes: int = framed.ROTATE_BYTES) -> DataFrame:
    """Live rows of every namespace as framed files; ``file`` and ``records`` written."""
    return framed.write_log(live(log), path, rotate_bytes)


def import_binary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a binary export as puts, ready to be appended."""
    return framed.read_log(spark, path).where(F.col("op") == PUT).select("ns", "key", "value", "op", "ts_ns", F.coalesce("ttl_s", F.lit(0)).alias("ttl_s"))
