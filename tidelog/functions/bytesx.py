"""Byte-string helpers: ordered keys, prefixes, hex and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The least byte string above everything that starts with ``prefix``; None if there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def key_after(key: bytes) -> bytes:
    """The least byte string above ``key``."""
    return key + b"\x00"


def lit_bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def in_range(key: Column, start: bytes | None, end: bytes | None) -> Column:
    """``start <= key < end`` in a form that Parquet statistics can serve."""
    test = F.lit(True)
    if start is not None:
        test = key >= lit_bytes(start)
    if end is not None:
        test = test & (key < lit_bytes(end))
    return test


def has_prefix(key: Column, prefix: bytes) -> Column:
    """A prefix test written as a range: ``startswith`` on binary isn't pushed to the scan."""
    return in_range(key, prefix, prefix_upper_bound(prefix)) if prefix else key.isNotNull()


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def encode_key(ns: Column, key: Column) -> Column:
    """Length-prefixed key: two big-endian bytes of namespace length, namespace, key."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(ns)), 4, "0"))
    return F.concat(length, ns, key)


def encoded_length(ns: Column, key: Column) -> Column:
    return F.lit(2) + F.octet_length(ns) + F.octet_length(key)


def decode_key(encoded: Column) -> tuple[Column, Column]:
    """(namespace, key) of an encoded key; nulls where the bytes are too short."""
    length = F.conv(F.hex(F.substring(encoded, 1, 2)), 16, 10).cast("int")
    whole = F.octet_length(encoded) >= length + 2
    ns = F.when(whole, encoded.substr(F.lit(3), length))
    key = F.when(whole, encoded.substr(length + 3, F.octet_length(encoded)))
    return ns, key


def slug(ns: Column) -> Column:
    """A namespace as a file name: other characters than letters, digits, ``_`` and ``-`` become ``_``."""
    return F.regexp_replace(ns, "[^A-Za-z0-9_-]", "_")


def vector_namespace(ns: Column) -> Column:
    return F.concat(F.lit("__vec__"), ns)


def text_namespace(ns: Column) -> Column:
    return F.concat(F.lit("__text__"), ns)


def content_hash(value: Column) -> Column:
    """SHA-256 in lower-case hex; of no bytes where the value is null."""
    return F.sha2(F.coalesce(value, lit_bytes(b"")), 256)


def hash_text(value: Column) -> Column:
    """A hash's spelling made uniform: lower case, no ``0x``, no outer spaces."""
    return F.regexp_replace(F.lower(F.trim(value)), "^0x", "")


def undamaged(op: Column, value: Column, value_hash: Column) -> Column:
    """A change record that is a put or a delete and whose hash fits its value."""
    return op.isin(PUT, DELETE) & (content_hash(value) == hex_lower(value_hash))


def text_or_null(value: Column) -> Column:
    """Strict UTF-8 text of a binary value, else null."""
    return F.try_validate_utf8(value.cast("string"))


def merkle_root(hashes: Column) -> Column:
    """Hash of the sorted hashes, zeros where there are none (an aggregate)."""
    ordered = F.array_sort(F.collect_list(hashes))
    return F.when(F.size(ordered) == 0, F.lit("0" * 64)).otherwise(F.sha2(F.concat_ws("", ordered), 256))
