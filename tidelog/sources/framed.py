"""Framed change-log files: a reader and a writer that stand damage.

A frame is a body length (four bytes, little-endian), the body's CRC-32 and the
body: JSON of a record with its bytes in hex, deflated.  A frame whose checksum
or body is bad is skipped; a file that ends inside a frame ends there.  Files are
read in parallel, one task each, and are bounded by rotation.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FIELDS = ("ns", "key", "value", "op", "lsn", "ts_ns", "ttl_s", "txid")
SCHEMA = "ns binary, key binary, value binary, op tinyint, lsn bigint, ts_ns bigint, ttl_s bigint, txid bigint"
#: A file is closed once it has so many bytes.
ROTATE_BYTES = 64 << 20


def frame(record: dict) -> bytes:
    plain = {k: (bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v) for k, v in record.items()}
    body = zlib.compress(json.dumps(plain, separators=(",", ":")).encode())
    return struct.pack("<II", len(body), zlib.crc32(body)) + body


def frames(data: bytes) -> Iterator[dict]:
    at = 0
    while at + 8 <= len(data):
        size, check = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            return
        at += 8 + size
        if zlib.crc32(body) != check:
            continue
        try:
            plain = json.loads(zlib.decompress(body))
            yield {k: (bytes.fromhex(plain[k]) if k in ("ns", "key", "value") and plain.get(k) is not None else plain.get(k)) for k in FIELDS}
        except (ValueError, zlib.error, TypeError):
            continue


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All good records of the ``*.log`` files of a folder."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(frames(bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=list(FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("content")
    return files.mapInPandas(run, SCHEMA)


def write_log(rows: DataFrame, path: str, rotate_bytes: int = ROTATE_BYTES) -> DataFrame:
    """Write a log as framed files, at least one a task with rows; returns ``file``, ``records``.

    ``path`` is a folder every executor can write.  A file appears under its name
    only when it is complete, and a repeated task writes the same names.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, size, count, out = 0, 0, 0, None
        done = []

        def close():
            nonlocal out, number, size, count
            if out:
                out.close()
                name = os.path.join(path, f"wal-{part:06d}-{number:06d}.log")
                os.replace(out.name, name)
                done.append((os.path.basename(name), count))
                number, size, count, out = number + 1, 0, 0, None

        os.makedirs(path, exist_ok=True)
        for pdf in batches:
            for record in pdf.to_dict("records"):
                record = {k: (None if k == "value" and v is None else v if isinstance(v, (bytes, bytearray, type(None))) else int(v)) for k, v in record.items()}
                data = frame(record)
                if out is None:
                    out = open(os.path.join(path, f".wal-{part:06d}-{number:06d}.{os.getpid()}.tmp"), "wb")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= rotate_bytes:
                    close()
        close()
        if done:
            yield pd.DataFrame(done, columns=["file", "records"])

    return rows.select(*FIELDS).na.fill(0, ["ttl_s", "txid", "ts_ns"]).mapInPandas(run, "file string, records bigint")
