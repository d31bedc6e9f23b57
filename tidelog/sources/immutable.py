"""A read-only engine over a fixed list of segments: folders, relations or the bytes of Parquet files.

The newest version is chosen over all of them; nothing is written anywhere.
"""

from __future__ import annotations

import io
import json

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytesx import encode_key
from tidelog.operators import kv
from tidelog.sources.store import SCHEMA, rows_digest


def segment_bytes(rows: DataFrame) -> bytes:
    """One segment as the bytes of a Parquet file, sorted by key; for a segment that fits the driver."""
    out = io.BytesIO()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pq.write_table(rows.select(*names).orderBy("ns", "key", "lsn").toArrow(), out, compression="zstd")
    return out.getvalue()


class ImmutableEngine:
    def __init__(self, spark: SparkSession, segments: list[DataFrame]):
        self.spark, self._segments = spark, list(segments)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: list[str]) -> ImmutableEngine:
        return cls(spark, [spark.read.schema(SCHEMA).parquet(p) for p in paths])

    @classmethod
    def from_bytes(cls, spark: SparkSession, blobs: list[bytes]) -> ImmutableEngine:
        """Segments in memory, each a Parquet file's bytes; broken ones are an error."""
        return cls(spark, [spark.createDataFrame(pq.read_table(io.BytesIO(b)).to_pylist(), SCHEMA) for b in blobs])

    def log(self) -> DataFrame:
        rows = self.spark.createDataFrame([], SCHEMA)
        for i, segment in enumerate(self._segments, 1):
            rows = rows.unionByName(segment.withColumn("seg_id", F.coalesce("seg_id", F.lit(i)).cast("bigint")))
        return rows

    def get(self, ns: bytes, key: bytes) -> bytes | None:
        return kv.value_of(kv.get(self.log(), ns, key))

    def get_with_stats(self, ns: bytes, key: bytes) -> DataFrame:
        return kv.get_with_stats(self.log(), ns, key)

    def range(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return kv.range_scan(self.log(), ns, start, end)

    def prefix(self, ns: bytes, prefix: bytes) -> DataFrame:
        return kv.prefix_scan(self.log(), ns, prefix)

    def page(self, ns: bytes, n: int, cursor: bytes | None = None) -> DataFrame:
        return kv.page(self.log(), ns, n, cursor=cursor)

    def page_back(self, ns: bytes, n: int, cursor: bytes | None = None) -> DataFrame:
        return kv.page_back(self.log(), ns, n, cursor=cursor)

    def manifest_json(self) -> str:
        """The segments in order, keys and hashes in hex."""
        entries = []
        for i, segment in enumerate(self._segments, 1):
            key = encode_key(F.col("ns"), F.col("key"))
            low, high, first, last, n = segment.agg(F.min(key), F.max(key), F.min("lsn"), F.max("lsn"), F.count("*")).first()
            hexed = lambda b: None if b is None else bytes(b).hex()
            entries.append({"segment_id": i, "hash": rows_digest(segment), "min_key": hexed(low), "max_key": hexed(high), "min_lsn": first, "max_lsn": last, "record_count": n})
        return json.dumps({"format_version": 1, "segments": entries})
