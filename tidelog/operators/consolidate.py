"""Consolidating small segments into few well-sized files.

Records of small segments are ordered along a Hilbert curve over (key, LSN), so
that a file covers a compact part of both.  The exact histogram of the codes
gives the file bounds: every file gets its share of bytes, and a code with more
than a file's share is split by a hash of the record.  Rows go straight to their
file's task, where copies meet and one is kept.  Afterwards the row digests of
what was read from the source are compared with those of what was written, over
all and segment by segment; a difference is an error.

A record's bytes move once.  Sampling, histogram and digests work on a narrow
table of row hashes, LSNs, keys and sizes that one scan writes.

Defined cases: copies of a record (the same content in several small segments)
are stored once; null and empty values are different content; damaged records are
kept as they are, being records too; a segment of unknown size is not small;
small segments without records are consolidated with nothing to move; no small
segment gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.bytesx import encode_key, hex_lower, lit_bytes
from tidelog.operators.segments import live_segments
from tidelog.session import materialise, scratch

#: A live segment below this many compressed bytes is small.
SMALL_BYTES = 16_384
#: Bits of each coordinate: 65,536 codes, which bounds the histogram.
BITS = 8
#: Keys sampled for the borders of the key coordinate; they shape locality only.
SAMPLED_KEYS = 4_096
#: Tells the second row hash from the first.
SECOND = 2
CONTENT = ("txid", "lsn", "ts_ns", "ttl_s", "ns_len", "ns_bytes", "key_bytes", "op", "value_hash", "value_bytes")


def _curve() -> tuple[list[int], list[int]]:
    """Next state and digit for each (state, quadrant).

    A state is (axes swapped, bits flipped).  Quadrants of the unturned curve go
    0, 1, 2, 3 along (0,0), (0,1), (1,1), (1,0); the first and the last are turned.
    """
    follow, digit = [], []
    for state in range(4):
        swapped, flipped = state >> 1, state & 1
        for quadrant in range(4):
            bits = [(quadrant >> 1) ^ flipped, (quadrant & 1) ^ flipped]
            x, y = bits[::-1] if swapped else bits
            digit.append((3 * x) ^ y)
            turn = y == 0
            follow.append((swapped ^ turn) << 1 | (flipped ^ (turn and x)))
    return follow, digit


FOLLOW, DIGIT = _curve()


def hilbert_code(x: Column, y: Column, bits: int = BITS) -> Column:
    """Position of cell (x, y) along the curve, as one expression without Python."""
    follow, digit = F.array(*map(F.lit, FOLLOW)), F.array(*map(F.lit, DIGIT))
    state, code = F.lit(0), F.lit(0)
    for i in range(bits - 1, -1, -1):
        cell = state * 4 + F.shiftright(x, i).bitwiseAND(1) * 2 + F.shiftright(y, i).bitwiseAND(1) + 1
        code = code * 4 + F.element_at(digit, cell)
        state = F.element_at(follow, cell)
    return code


def key_coordinate(key: Column, borders: list[bytes]) -> Column:
    """Number of sorted borders at or below a key: a tree of comparisons, without Python."""

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < lit_bytes(borders[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return place(0, len(borders))


@dataclass
class Consolidation:
    """``sources``: consolidated segment ids with the records each held, how many are different ones and how many of these are in the new files.

    ``files``: the new segments; ``path``: where they are; ``digest``: of all rows.
    """

    sources: DataFrame
    files: DataFrame | None
    path: str | None
    records: int
    digest: tuple


def row_hashes() -> tuple[Column, Column]:
    """128 bits of a record's content, nulls told from empty values."""
    nulls = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(CONTENT)), F.lit(0))
    return F.xxhash64(nulls, *CONTENT).alias("h1"), F.xxhash64(F.lit(SECOND), nulls, *CONTENT).alias("h2")


def digest(hashes: DataFrame) -> tuple:
    """Count and order-free digest of rows ``h1``, ``h2``."""
    return tuple(hashes.agg(F.count("*"), F.coalesce(F.bit_xor("h1"), F.lit(0)), F.coalesce(F.bit_xor("h2"), F.lit(0))).first())


def small_segments(entries: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    return live_segments(entries).where(F.col("compressed_bytes") < small_bytes)


def consolidate(entries: DataFrame, wal: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = 64 << 20, out: str | None = None) -> Consolidation:
    """Write the records of small segments into files of about ``target_bytes`` (uncompressed) and verify them."""
    spark = wal.sparkSession
    small = materialise(small_segments(entries, small_bytes).select("segment_id"), "small-ids")
    held = wal.where("segment_id is not null").join(small, "segment_id", "left_semi")
    encoded = encode_key(F.coalesce("ns_bytes", lit_bytes(b"")), F.coalesce("key_bytes", lit_bytes(b"")))
    size = F.lit(64) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("ns_bytes", "key_bytes", "value_bytes"))
    source = materialise(held.select("segment_id", "lsn", encoded.alias("ekey"), size.alias("size"), *row_hashes()), "source")
    wanted = digest(source.select("h1", "h2").distinct())
    if not wanted[0]:
        sources = small.select("segment_id", *[F.lit(0).cast("bigint").alias(c) for c in ("records", "distinct_records", "moved")])
        return Consolidation(sources, None, None, 0, wanted)

    out = out or scratch(spark, "segments")
    sample = sorted(bytes(r[0]) for r in source.select("ekey", "h1").orderBy("h1").limit(SAMPLED_KEYS).collect())
    cells = 1 << BITS
    borders = sorted({sample[i * len(sample) // cells] for i in range(1, cells)})
    low, high = source.agg(F.min("lsn"), F.max("lsn")).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0) + 1)
    y = F.least(F.lit(cells - 1), F.floor((F.coalesce("lsn", F.lit(low)) - low) * cells / span)).cast("int")
    code = lambda df, key: df.withColumn("_x", key_coordinate(key, borders)).withColumn("_code", hilbert_code(F.col("_x"), y))

    histogram = code(source, F.col("ekey")).groupBy("_code").agg(F.sum("size").alias("bytes")).orderBy("_code").collect()  # at most 4 ** BITS rows
    bounds, filled, files = [], 0, 0  # (code, first file, number of files)
    for number, amount in histogram:
        if amount > target_bytes:
            files += filled > 0
            parts = -(-amount // target_bytes)
            bounds.append((number, files, parts))
            files, filled = files + parts, 0
        else:
            if filled + amount > target_bytes:
                files, filled = files + 1, 0
            bounds.append((number, files, 1))
            filled += amount
    files += filled > 0
    lookup = F.broadcast(spark.createDataFrame([(int(c), int(f), int(p)) for c, f, p in bounds], "_code int, _file int, _parts int"))  # at most 4 ** BITS rows
    placed = code(held.select(*CONTENT), encoded).join(lookup, "_code").withColumn("_file", (F.col("_file") + F.pmod(F.xxhash64("lsn", "key_bytes", "value_bytes"), F.col("_parts"))).cast("int"))
    once = placed.select("_file", "_code", *CONTENT).repartitionById(int(files), F.col("_file")).dropDuplicates(["_file", "_code", *CONTENT])
    (
        once.sortWithinPartitions("_code", "ns_bytes", "key_bytes", "lsn")
        .select(*CONTENT).write.mode("overwrite").option("compression", "zstd").parquet(out)
    )

    written = spark.read.parquet(out)
    there = materialise(written.select(*row_hashes()), "written")
    got = digest(there)
    if got != wanted:
        raise ValueError(f"consolidated files hold {got} (records, digests), the sources {wanted}")
    copies = source.groupBy("segment_id", "h1", "h2").agg(F.count("*").alias("n"))
    found = there.groupBy("h1", "h2").agg(F.count("*").alias("stored"))
    per_source = copies.join(found, ["h1", "h2"], "left").groupBy("segment_id").agg(
        F.sum("n").alias("records"), F.count("*").alias("distinct_records"), F.count_if(F.col("stored") == 1).alias("moved")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "distinct_records", "moved")]
    sources = materialise(small.join(per_source, "segment_id", "left").select("segment_id", *zero), "sources")
    missing = sources.where("moved <> distinct_records").count()
    if missing:
        raise ValueError(f"records of {missing} small segments are not in the consolidated files")
    new = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("record_count"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"),
        hex_lower(F.min(encoded)).alias("min_key"), hex_lower(F.max(encoded)).alias("max_key"), F.max("_metadata.file_size").alias("compressed_bytes"),
    )
    return Consolidation(sources, new, out, got[0], got)


def consolidated_segments(entries: DataFrame, wal: DataFrame) -> DataFrame:
    """``segment_id`` of every small live segment all of whose different records are, once each, in the new files."""
    return consolidate(entries, wal).sources.where("moved = distinct_records").select("segment_id")


def consolidated_totals(entries: DataFrame, wal: DataFrame) -> DataFrame:
    """One row on the new files together: records, LSN and key bounds, copies left out."""
    done = consolidate(entries, wal)
    segments, given = done.sources.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    kinds = {"stored": "bigint", "min_lsn": "bigint", "max_lsn": "bigint", "min_key": "string", "max_key": "string"}
    if done.files is None:
        new = wal.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("stored"), *[F.lit(None).cast(t).alias(c) for c, t in list(kinds.items())[1:]])
    else:
        new = done.files.agg(F.sum("record_count").alias("stored"), *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in list(kinds)[1:]])
    return new.select(F.lit(segments).cast("bigint").alias("segments"), F.lit(given).cast("bigint").alias("given"), *kinds)
