"""Vectors and texts kept as records of a store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import codecs
from tidelog.operators import kv
from tidelog.sources.store import Store

_VECTORS = "key binary, dims int, dtype string, embedding array<float>"
_TEXTS = "key binary, text string, strings map<string,string>, numbers map<string,bigint>, flags map<string,boolean>"


def vector_namespace(ns: bytes) -> bytes:
    return b"__vec__" + ns


def text_namespace(ns: bytes) -> bytes:
    return b"__text__" + ns


def put_vector(store: Store, ns: bytes, key: bytes, data: bytes, dims: int, dtype: str) -> int:
    """``data`` are little-endian elements; another length than stated is an error."""
    codecs.check_vector(dims, dtype, data)
    return store.put(vector_namespace(ns), key, codecs.encode_vector(np.frombuffer(data, codecs.DTYPES[dtype]), dtype))


def get_vector(store: Store, ns: bytes, key: bytes):
    return codecs.decode_vector(store.get(vector_namespace(ns), key))


def delete_vector(store: Store, ns: bytes, key: bytes) -> int:
    return store.delete(vector_namespace(ns), key)


def vectors(log: DataFrame, ns: bytes) -> DataFrame:
    """Live vectors of a namespace; records that don't decode are left out."""

    def run(batches):
        for pdf in batches:
            rows = [(k, *d[:2], d[2].astype(np.float32).tolist()) for k, v in zip(pdf["key"], pdf["value"]) if (d := codecs.decode_vector(bytes(v)))]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "dims", "dtype", "embedding"])

    return kv.scan(log, vector_namespace(ns)).where("value is not null").select("key", "value").mapInPandas(run, _VECTORS)


def put_text(store: Store, ns: bytes, key: bytes, text: str, facets: dict | None = None) -> int:
    if key == b"__index__":
        raise ValueError("the key is reserved")
    return store.put(text_namespace(ns), key, codecs.encode_text(text, facets))


def texts(log: DataFrame, ns: bytes) -> DataFrame:
    """Live texts of a namespace with their facets by type; records that don't decode are left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf["key"], pdf["value"]):
                record = codecs.decode_text(bytes(v))
                if record:
                    text, facets = record
                    pick = lambda kind: {n: x for n, x in facets.items() if type(x) is kind}
                    rows.append((k, text, pick(str), pick(int), pick(bool)))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "text", "strings", "numbers", "flags"])

    return kv.scan(log, text_namespace(ns)).where(F.col("value").isNotNull()).select("key", "value").mapInPandas(run, _TEXTS)
