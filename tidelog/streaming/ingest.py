"""Streams over the change log: append with deduplication, current values, replica sync."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators import kv, segments
from tidelog.sources.files import Files
from tidelog.sources.store import SCHEMA


def stream_log(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_current(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64):
    """Fold a stream of changes into the current version of each key, kept as Parquet in ``buckets`` by key.

    A batch rewrites only the buckets it has keys of, each under the batch's number,
    and drops what the batch before the last superseded; a replayed batch writes
    the same files again.  So results are exact though deliveries repeat or come
    late, and a batch costs the buckets it touches.  Choose their number so that a
    bucket fits a task.
    """
    spark = stream.sparkSession
    files = Files(spark, target)
    bucket = F.pmod(F.xxhash64("ns", "key"), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        rows = kv.newest(batch).withColumn("_bucket", bucket)
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most `buckets` rows
        held = _generations(files)
        earlier = {b: max((n for n in held.get(b, []) if n < number), default=None) for b in touched}
        paths = [files.at(f"bucket={b}/{n}") for b, n in earlier.items() if n is not None]
        if paths:
            before = spark.read.schema(batch.schema).parquet(*paths)
            rows = kv.newest(rows.drop("_bucket").unionByName(before.select(*batch.columns))).withColumn("_bucket", bucket)
        staged = files.at(f"staged/{number}")
        rows.repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(staged)
        for b in touched:
            files.delete(f"bucket={b}/{number}")
            files.make(f"bucket={b}")
            files.rename(f"staged/{number}/_bucket={b}", f"bucket={b}/{number}")
            for old in held.get(b, []):
                if old < (earlier[b] or 0):
                    files.delete(f"bucket={b}/{old}")
        files.delete(f"staged/{number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def _generations(files: Files) -> dict[int, list[int]]:
    """Batch numbers held of each bucket."""
    return {int(b[7:]): sorted(int(n) for n in files.names(b) if n.isdigit()) for b in files.names() if b.startswith("bucket=")}


def latest_generation(spark: SparkSession, target: str, schema=None) -> DataFrame:
    """The current version of every key."""
    files = Files(spark, target)
    paths = [files.at(f"bucket={b}/{numbers[-1]}") for b, numbers in _generations(files).items() if numbers]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema or SCHEMA)


class NewestVersion(StatefulProcessor):
    """Per key the highest LSN seen and its row; emits a row whenever a newer version arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "lsn bigint, op int, value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best = held
        for pdf in rows:
            top = pdf.sort_values("lsn").iloc[-1]
            if best is None or top["lsn"] > best[0]:
                best = (int(top["lsn"]), int(top["op"]), top["value"])
        if best is not None and (held is None or best[0] > held[0]):
            self.best.update(best)
            yield pd.DataFrame({"ns": [key[0]], "key": [key[1]], "lsn": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def stateful_current(stream: DataFrame) -> DataFrame:
    """A stream of changes to the current values (needs the RocksDB state store)."""
    rows = stream.select("ns", "key", "lsn", F.col("op").cast("int").alias("op"), "value")
    return rows.groupBy("ns", "key").transformWithStateInPandas(NewestVersion(), "ns binary, key binary, lsn bigint, op int, value binary", "Update", "None")


def sync_once(local: DataFrame, peer_log: DataFrame, local_segments: DataFrame, peer_segments: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """One round of anti-entropy: (merged log or None if nothing differs, segments that were missing).

    The roots of ranges are compared first; only where they differ are the
    manifests, and only missing segments' records are merged.
    """
    apart = segments.differing_ranges(segments.range_roots(local_segments), segments.range_roots(peer_segments))
    nearby = peer_segments.withColumn("range_no", F.floor(F.col("segment_id") / 100).cast("bigint")).join(apart.select("range_no"), "range_no", "left_semi").drop("range_no")
    missing = segments.missing_segments(local_segments, nearby)
    if missing.isEmpty():
        return None, missing
    incoming = peer_log.join(missing.select(F.col("segment_id").alias("seg_id")).distinct(), "seg_id", "left_semi").select(*peer_log.columns)
    return segments.import_lww(local, incoming), missing


