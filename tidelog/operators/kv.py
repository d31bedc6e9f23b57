"""Ordered key-value reads over a change log.

A log is a DataFrame with ``ns``, ``key``, ``value``, ``op``, ``lsn`` (and
``ts_ns``, ``ttl_s``, ``txid``, ``seg_id`` where an operator says so).  The
newest version of a key wins, a delete hides it, and limits apply only after
that.  Reads never look at time to live: expired rows go with compaction.

Nulls: rows without namespace, key or LSN take no part.  Copies of one LSN are
one version.  An empty log gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.bytesx import DELETE, encoded_length, has_prefix, in_range, key_after, lit_bytes
from tidelog.session import materialise

#: Rows that one task may run over in order.
WINDOW_ROWS = 100_000

LOG = ("ns", "key", "value", "op", "lsn", "ts_ns", "ttl_s", "txid", "seg_id")


def newest(log: DataFrame, keys: Iterable[str] = ("ns", "key"), order: Iterable[Column] | None = None) -> DataFrame:
    """The winning version of each key, deletes included.

    Planned with a rank limit on both sides of the exchange: a map task sends at
    most one row a key, so a hot key costs one row per task.
    """
    ranking = list(order) if order else [F.desc("lsn"), F.desc("op")]
    window = Window.partitionBy(*keys).orderBy(*ranking)
    return log.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def live(log: DataFrame) -> DataFrame:
    """Last-write-wins view without deleted keys."""
    return newest(log.where("ns is not null and key is not null and lsn is not null")).where(F.col("op") != DELETE)


def namespace(log: DataFrame, ns: bytes) -> DataFrame:
    return log.where(F.col("ns") == lit_bytes(ns))


def get(log: DataFrame, ns: bytes, key: bytes) -> DataFrame:
    """No or one row; the key test reaches the scan, below the version choice."""
    return live(namespace(log, ns).where(F.col("key") == lit_bytes(key)))


def value_of(rows: DataFrame) -> bytes | None:
    """The value of a point read: None where the key is missing, empty where a put has none."""
    row = rows.select("value").first()
    return None if row is None else bytes(row[0] or b"")


def get_into(log: DataFrame, ns: bytes, key: bytes) -> DataFrame:
    """One row ``found``, ``value``: null where the key is missing or deleted."""
    return get(log, ns, key).agg((F.count("*") > 0).alias("found"), F.max("value").alias("value"))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Current values of many keys (``ns``, ``key``) in one job.

    The semi-join comes before the version choice; Spark broadcasts the wanted
    keys only where their size is known to be small.
    """
    return live(log.join(wanted.select("ns", "key").distinct(), ["ns", "key"], "left_semi"))


def get_with_stats(log: DataFrame, ns: bytes, key: bytes) -> DataFrame:
    """One row: value, segments holding a version, bytes of key and value, items examined (zeros on a miss)."""
    mine = namespace(log, ns).where((F.col("key") == lit_bytes(key)) & F.col("lsn").isNotNull())
    last = F.max(F.struct("lsn", "op", "value"))
    found = mine.agg(F.count_distinct("seg_id").alias("segments_scanned"), last.alias("_last"))
    hit = F.coalesce(F.col("_last.op") != DELETE, F.lit(False))
    size = 2 + len(ns) + len(key) + F.coalesce(F.octet_length("_last.value"), F.lit(0))
    return found.select("segments_scanned", F.when(hit, F.col("_last.value")).alias("value"), F.when(hit, size).otherwise(0).cast("bigint").alias("bytes_read"), hit.cast("bigint").alias("items_examined"))


def scan(log: DataFrame, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Live rows with ``start <= key < end``, in any order."""
    return live(namespace(log, ns).where(in_range(F.col("key"), start, end)))


def range_scan(log: DataFrame, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    return scan(log, ns, start, end).orderBy("key")


def prefix_scan(log: DataFrame, ns: bytes, prefix: bytes) -> DataFrame:
    return live(namespace(log, ns).where(has_prefix(F.col("key"), prefix))).orderBy("key")


def range_stats(log: DataFrame, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """What a range read costs: flushed rows after version choice, unflushed ones with their deletes."""
    rows = namespace(log, ns).where(in_range(F.col("key"), start, end))
    flushed = live(rows.where("seg_id is not null")).withColumn("_kind", F.lit("cost"))
    fresh = newest(rows.where("seg_id is null")).withColumn("_kind", F.lit("cost"))
    out = live(rows).withColumn("_kind", F.lit("row"))
    cost = F.col("_kind") == "cost"
    size = encoded_length(F.col("ns"), F.col("key")) + F.coalesce(F.octet_length("value"), F.lit(0))
    return flushed.unionByName(fresh).unionByName(out).agg(
        F.count_if(cost).alias("items_examined"), F.coalesce(F.sum(F.when(cost, size)), F.lit(0)).cast("bigint").alias("bytes_read"), F.count_if(~cost).alias("rows_returned")
    )


def budget_items(rows: DataFrame, max_items: int) -> DataFrame:
    """The first rows by key, with ``truncated`` telling whether input remained."""
    if max_items <= 0:
        return rows.where(F.lit(False)).withColumn("truncated", F.lit(True))
    head = rows.orderBy("key").limit(max_items + 1)
    window = Window.orderBy("key")  # over at most max_items + 1 rows
    return (
        head.withColumn("_n", F.row_number().over(window))
        .withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > max_items)
        .where(F.col("_n") <= max_items)
        .drop("_n")
    )


def running_total(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """A running sum over a total order without one task for all rows.

    Rows are cut into ranges of the order; each range is summed and only these
    sums (one per range) are accumulated, then each range runs on its own.  The
    ranges are written once: range borders come from a sample, so computing them
    again, in another branch or after a lost executor, could move rows.  There are
    as many ranges as the session has shuffle partitions.
    """
    cut = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount)
    parts = materialise(cut, "ranges")
    totals = parts.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = totals.withColumn(
        "_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "_before")  # one row a range
    run = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parts.withColumn("_run", F.sum("_amount").over(run))
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop("_part", "_amount", "_run", "_before")
    )


def budget_bytes(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows by key up to and with the one that reaches ``max_bytes`` in total.

    A row costs two bytes at least, so the budget bounds the rows looked at: they
    are taken as a top-k, and only a budget beyond ``WINDOW_ROWS`` of them needs the
    running sum over ranges.
    """
    cost = encoded_length(F.col("ns"), F.col("key")) + F.coalesce(F.octet_length("value"), F.lit(0))
    most = max(0, max_bytes) // 2 + 1
    if most <= WINDOW_ROWS:
        window = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most WINDOW_ROWS rows
        summed = rows.orderBy("key").limit(most).withColumn("bytes_so_far", F.sum(cost).over(window))
    else:
        summed = running_total(rows, ["key"], cost, "bytes_so_far")
    return summed.where(F.col("bytes_so_far") - cost < max_bytes)


def page(log: DataFrame, ns: bytes, n: int, start: bytes | None = None, end: bytes | None = None, cursor: bytes | None = None) -> DataFrame:
    """The next ``n`` live rows after ``cursor`` with ``next_key``, null on the last page."""
    begin = key_after(cursor) if cursor is not None else start
    return _page(scan(log, ns, begin, end), n, F.asc("key"))


def page_back(log: DataFrame, ns: bytes, n: int, start: bytes | None = None, end: bytes | None = None, cursor: bytes | None = None) -> DataFrame:
    """The ``n`` live rows before ``cursor``, highest key first."""
    return _page(scan(log, ns, start, cursor if cursor is not None else end), n, F.desc("key"))


def _page(rows: DataFrame, n: int, order: Column) -> DataFrame:
    if n <= 0:
        return rows.where(F.lit(False)).withColumn("next_key", F.lit(None).cast("binary"))
    everything = Window.partitionBy(F.lit(1))
    return (
        rows.orderBy(order)
        .limit(n + 1)  # planned as TakeOrderedAndProject
        .withColumn("_n", F.row_number().over(Window.orderBy(order)))
        .withColumn("_more", F.max("_n").over(everything) > n)
        .where(F.col("_n") <= n)
        .withColumn("next_key", F.when(F.col("_more"), F.max(F.when(F.col("_n") == n, F.col("key"))).over(everything)))
        .drop("_n", "_more")
    )


def snapshot(log: DataFrame, segment_ids: DataFrame | list[int] | None = None, as_of_lsn: int | None = None) -> DataFrame:
    """The log as a pinned set of segments (or up to an LSN) shows it; unflushed rows are no part of it."""
    pinned = log.where("seg_id is not null")
    if isinstance(segment_ids, DataFrame):
        pinned = pinned.join(segment_ids.select("seg_id").distinct(), "seg_id", "left_semi")
    elif segment_ids is not None:
        pinned = pinned.where(F.col("seg_id").isin([int(i) for i in segment_ids]))
    if as_of_lsn is not None:
        pinned = pinned.where(F.col("lsn") <= as_of_lsn)
    return pinned


def committed(log: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """The log without the transactions (``txid``) that were rolled back; 0 and null are no transaction."""
    return log.join(rolled_back.select("txid").where("txid <> 0").distinct(), "txid", "left_anti")


def retained_after_flush(log: DataFrame, flushed_max_lsn: int) -> DataFrame:
    return log.where(F.col("lsn") > flushed_max_lsn)


def confirmed_lsn(segments: DataFrame) -> DataFrame:
    return segments.agg(F.coalesce(F.max("max_lsn"), F.lit(0)).alias("confirmed_lsn"))


def strip_namespaces(log: DataFrame, prefix: bytes) -> DataFrame:
    """Rows outside the index namespaces that start with ``prefix``."""
    return log.where(~has_prefix(F.col("ns"), prefix))


def from_wal(wal: DataFrame) -> DataFrame:
    """Undamaged change records as a log; columns other than the log's are dropped."""
    from tidelog.functions.bytesx import undamaged

    return wal.where(undamaged(F.col("op"), F.col("value_bytes"), F.col("value_hash"))).select(
        F.col("ns_bytes").alias("ns"), F.col("key_bytes").alias("key"), F.col("value_bytes").alias("value"), "op", "lsn", "ts_ns", "ttl_s", "txid", F.col("segment_id").alias("seg_id")
    )
