"""Applying a feed of inserts, updates and deletes, newest batch first.

The feed is cut into batches by LSN.  The newest batch is resolved first: the
newest image or tombstone of each of its keys is final, so every older batch
only has to answer for keys that no newer one named (an anti-join), and rows of
a base table come last, for keys the feed never named.  Each batch is reduced
to one row a key on the map side before anything moves, so a key with a third
of all rows costs one row per task.  Resolved batches are files in the shared
folder: a lost executor repeats at most one batch.

Defined cases: rows without key part or LSN take no part; copies of one change
and any order of arrival give the same state; where one LSN carries a put and a
delete of one key, the delete stands, as in all reads; a null value of a put is
an image with a null value; an empty feed leaves the base as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.bytesx import PUT, hex_lower, undamaged
from tidelog.operators.kv import newest
from tidelog.session import drop_path, scratch

#: Rows that are resolved at once, and fewest batches.
BATCH_ROWS, LEAST_BATCHES = 2_000_000_000, 4
#: Quantiles of the LSNs that batch borders are picked from.
QUANTILES = 64


def resolve_newest_first(
    changes: DataFrame,
    keys: list[str],
    lsn: str,
    is_put: Column,
    payload: list[str] | None = None,
    base: DataFrame | None = None,
    batches: int | None = None,
) -> DataFrame:
    """Current images: ``keys``, ``lsn`` and ``payload`` of every key whose newest change is a put.

    ``base`` holds older rows with the keys and the payload; those of keys the
    feed never names are kept, with a null LSN.  The batches are even in rows,
    whatever LSNs they span: their borders are quantiles of the LSNs.  There are
    ``batches`` of them, by default one for every ``BATCH_ROWS`` and at least
    ``LEAST_BATCHES``.
    """
    payload = list(payload or [])
    spark = changes.sparkSession
    narrow = changes.where(F.col(lsn).isNotNull()).where(" and ".join(f"`{k}` is not null" for k in keys))
    cells = max(QUANTILES, 4 * (batches or 1))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    count, low, marks = narrow.agg(F.count("*"), F.min(lsn), F.percentile_approx(lsn, shares, F.lit(16 * cells))).first()
    columns = [*keys, lsn, *payload]
    if low is None:
        empty = narrow.select(*columns).limit(0)
        return empty if base is None else empty.unionByName(base.select(*keys, F.lit(None).cast("bigint").alias(lsn), *payload))
    batches = batches or max(LEAST_BATCHES, -(-count // BATCH_ROWS))
    borders = sorted({marks[max(1, i * cells // batches) - 1] for i in range(1, batches)} - {low})
    number = F.lit(0)
    for border in borders:
        number = number + (F.col(lsn) >= border).cast("int")
    staged_path, resolved_path = scratch(spark, "feed"), scratch(spark, "resolved")
    (
        narrow.select(*columns, F.coalesce(is_put, F.lit(False)).alias("_put"), number.alias("_batch"))
        .write.partitionBy("_batch").option("compression", "zstd").parquet(staged_path)
    )
    staged = spark.read.parquet(staged_path)
    fields = [f for f in staged.schema.fields if f.name != "_batch"]
    schema = staged.select(*[f.name for f in fields]).schema
    done: list[str] = []
    for batch in range(len(borders), -1, -1):
        rows = staged.where(F.col("_batch") == batch).drop("_batch")
        if payload:
            images = newest(rows, keys, [F.desc(lsn), F.asc("_put")])
        else:  # the flag rides in the lowest bit, so the buffer is one number and the aggregate hashes
            packed = rows.groupBy(*keys).agg(F.max(F.shiftleft(F.col(lsn), 1) + (~F.col("_put")).cast("int")).alias("_packed"))
            images = packed.select(*keys, F.shiftright("_packed", 1).alias(lsn), (F.col("_packed").bitwiseAND(1) == 0).alias("_put"))
        if done:
            seen = spark.read.schema(schema).parquet(*done).select(*keys)
            images = images.join(seen, keys, "left_anti")
        path = f"{resolved_path}/step={batch}"
        images.select(*[f.name for f in fields]).write.option("compression", "zstd").parquet(path)
        done.append(path)
    drop_path(spark, staged_path)
    resolved = spark.read.schema(schema).parquet(*done)
    current = resolved.where("_put").select(*columns)
    if base is None:
        return current
    untouched = base.join(resolved.select(*keys), keys, "left_anti")
    return current.unionByName(untouched.select(*keys, F.lit(None).cast("bigint").alias(lsn), *payload))


def current_values(wal: DataFrame, base: DataFrame | None = None, values: bool = True, batches: int | None = None) -> DataFrame:
    """The current (``ns_bytes``, ``key_bytes``) with LSN (and ``value_bytes``) from undamaged change records."""
    good = wal.where(undamaged(F.col("op"), F.col("value_bytes"), F.col("value_hash")))
    return resolve_newest_first(good, ["ns_bytes", "key_bytes"], "lsn", F.col("op") == PUT, ["value_bytes"] if values else [], base, batches)


def current_keys(wal: DataFrame, batches: int | None = None) -> DataFrame:
    """``ns_hex``, ``key_hex``, ``lsn`` of every key whose newest undamaged change is a put."""
    state = current_values(wal, values=False, batches=batches)
    return state.select(hex_lower(F.col("ns_bytes")).alias("ns_hex"), hex_lower(F.col("key_bytes")).alias("key_hex"), "lsn")
