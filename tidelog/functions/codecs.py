"""Byte layouts of vector and text records.

Vector record: dimensions (two bytes, big-endian), element type (one byte),
elements (little-endian).  Text record: text length (four bytes, little-endian),
UTF-8 text, number of facets, then name, kind and value of each.  A record that
is too short or no valid UTF-8 decodes to None.
"""

from __future__ import annotations

import struct

import numpy as np

from tidelog.functions.vectors import DTYPES

#: Element type codes, in this order from zero.
CODES = ("F32", "F16", "I8")


def encode_vector(values, dtype: str) -> bytes:
    values = np.asarray(values).astype(DTYPES[dtype])
    if len(values) > 0xFFFF:
        raise ValueError("a vector has at most 65,535 dimensions")
    return struct.pack(">HB", len(values), CODES.index(dtype)) + values.tobytes()


def check_vector(dims: int, dtype: str, data: bytes) -> None:
    if len(data) != dims * np.dtype(DTYPES[dtype]).itemsize:
        raise ValueError(f"{len(data)} bytes are no {dims} elements of {dtype}")


def decode_vector(record: bytes | None) -> tuple[int, str, np.ndarray] | None:
    if record is None or len(record) < 3:
        return None
    dims, code = struct.unpack_from(">HB", record)
    if code >= len(CODES):
        return None
    dtype = CODES[code]
    data = record[3:]
    if len(data) != dims * np.dtype(DTYPES[dtype]).itemsize:
        return None
    return dims, dtype, np.frombuffer(data, dtype=DTYPES[dtype])


def encode_text(text: str, facets: dict | None = None) -> bytes:
    part = lambda b: struct.pack("<I", len(b)) + b
    out = part(text.encode()) + struct.pack("<I", len(facets or {}))
    for name, value in (facets or {}).items():
        kind = 2 if isinstance(value, bool) else 1 if isinstance(value, int) else 0
        body = part(value.encode()) if kind == 0 else struct.pack("<q", value) if kind == 1 else struct.pack("<?", value)
        out += part(name.encode()) + bytes([kind]) + body
    return out


def decode_text(record: bytes | None) -> tuple[str, dict] | None:
    try:
        at = 0

        def part() -> bytes:
            nonlocal at
            (n,) = struct.unpack_from("<I", record, at)
            at += 4 + n
            if at > len(record):
                raise ValueError("the record ends early")
            return record[at - n : at]

        text = part().decode()
        (count,) = struct.unpack_from("<I", record, at)
        at += 4
        facets: dict = {}
        for _ in range(count):
            name = part().decode()
            kind = record[at]
            at += 1
            if kind == 0:
                facets[name] = part().decode()
            elif kind == 1:
                (facets[name],) = struct.unpack_from("<q", record, at)
                at += 8
            elif kind == 2:
                (facets[name],) = struct.unpack_from("<?", record, at)
                at += 1
            else:
                return None
        return text, facets
    except (struct.error, ValueError, IndexError, TypeError):
        return None
