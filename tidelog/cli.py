"""Command line over a store: ``python -m tidelog.cli PATH COMMAND ...``; bytes are text, or hex after ``0x``."""

from __future__ import annotations

import argparse
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from tidelog.functions import codecs
from tidelog.functions.bytesx import hex_lower
from tidelog.functions.vectors import METRICS
from tidelog.operators import fulltext, vectors
from tidelog.session import local_session
from tidelog.sources import dumps, records
from tidelog.sources.store import Store


def as_bytes(text: str) -> bytes:
    return bytes.fromhex(text[2:]) if text.startswith("0x") else text.encode()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelog")
    top.add_argument("path")
    top.add_argument("--ns", default="default")
    sub = top.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("stats",), ("put", "key", "value"), ("get", "key"), ("delete", "key"), ("range", "--start", "--end", "--limit"), ("prefix", "prefix"),
        ("create",), ("flush",), ("compact",), ("export", "target"), ("import", "source"),
        ("vector-put", "key", "values"), ("vector-get", "key"), ("vector-search", "values"), ("text-put", "key", "text"), ("text-search", "query"),
    ):
        command = sub.add_parser(name)
        for arg in args:
            command.add_argument(arg)
        if name == "put":
            command.add_argument("--ttl", type=int, default=0)
        if name in ("vector-search", "text-search"):
            command.add_argument("--k", type=int, default=10)
        if name == "vector-search":
            command.add_argument("--metric", choices=sorted(METRICS), default="cosine")
        if name == "text-search":
            command.add_argument("--lang", default=None)
            command.add_argument("--typo", action="store_true")
        if name in ("export", "import"):
            command.add_argument("--format", choices=("json", "binary"), default="json")
    return top


def run(argv: list[str], spark=None, out=print) -> int:
    a = parser().parse_args(argv)
    store = Store(spark or local_session("*"), a.path)
    ns = as_bytes(a.ns)
    if a.command == "put":
        out(store.put(ns, as_bytes(a.key), as_bytes(a.value), a.ttl))
    elif a.command == "get":
        value = store.get(ns, as_bytes(a.key))
        if value is None:
            return 1
        out(value.decode("utf-8", "replace"))
    elif a.command == "delete":
        out(store.delete(ns, as_bytes(a.key)))
    elif a.command in ("range", "prefix"):
        if a.command == "range":
            rows = store.range(ns, as_bytes(a.start) if a.start else None, as_bytes(a.end) if a.end else None)
            rows = rows.limit(int(a.limit)) if a.limit else rows
        else:
            rows = store.prefix(ns, as_bytes(a.prefix))
        for r in rows.select(hex_lower(F.col("key")), hex_lower(F.col("value"))).toLocalIterator():
            out(f"{r[0]}\t{r[1]}")
    elif a.command == "flush":
        out(store.flush())
    elif a.command == "compact":
        out(store.compact(time.time_ns()))
    elif a.command == "create":
        out(store.create())
    elif a.command == "export":
        if a.format == "json":
            dumps.export_json(store.log(), a.target)
        else:
            out(dumps.export_binary(store.log(), a.target).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0])
    elif a.command == "import":
        out(store.append((dumps.import_json if a.format == "json" else dumps.import_binary)(store.spark, a.source)))
    elif a.command == "vector-put":
        values = np.array([float(x) for x in a.values.split(",")], dtype="<f4")
        out(records.put_vector(store, ns, as_bytes(a.key), values.tobytes(), len(values), "F32"))
    elif a.command == "vector-get":
        held = store.get(records.vector_namespace(ns), as_bytes(a.key))
        if held is None:
            return 1
        out(",".join(f"{x:g}" for x in codecs.decode_vector(held)[2]))
    elif a.command == "vector-search":
        query = [float(x) for x in a.values.split(",")]
        for r in vectors.top_k(records.vectors(store.log(), ns), query, a.k, a.metric, "key", "embedding", "F32").collect():
            out(f"{r['distance']:.6f}\t{bytes(r['key']).decode('utf-8', 'replace')}")
    elif a.command == "text-put":
        out(records.put_text(store, ns, as_bytes(a.key), a.text))
    elif a.command == "text-search":
        docs = records.texts(store.log(), ns).select(F.col("key").alias("doc_id"), "text")
        for r in fulltext.search(docs, a.query, a.k, lang=a.lang, typo=a.typo).collect():
            out(f"{r['score']:.6f}\t{bytes(r['doc_id']).decode('utf-8', 'replace')}")
    else:
        out(f"segments {len(store.segment_ids())}, batches {store.wal_batches()}, current LSN {store.current_lsn()}, confirmed LSN {store.confirmed_lsn()}")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
