"""Segments: manifest, metadata, merkle roots, reconciliation of replicas."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.bytesx import DELETE, content_hash, encode_key, hash_text, hex_lower, merkle_root
from tidelog.operators.cohorts import cohort_bucket, death_time
from tidelog.operators.kv import newest

#: The fields of a segment's metadata.
META = (
    "segment_hash", "min_key", "max_key", "min_lsn", "max_lsn", "record_count", "compressed_bytes", "uncompressed_bytes", "compression",
    "cohort_bucket", "death_time", "merkle_root", "text_index_stripped", "vector_index_stripped", "created_at",
)
HASHES = ("segment_hash", "merkle_root")


def live_segments(entries: DataFrame) -> DataFrame:
    """Manifest fold: a segment is live if its entry with the highest number is an ``Add``.

    Entries without segment or number take no part; of copies of an entry one counts.
    """
    known = entries.where("segment_id is not null and entry_no is not null")
    last = newest(known, ["segment_id"], [F.desc("entry_no"), F.asc("entry_type")])
    return last.where("entry_type = 'Add'").select("segment_id", *META)


def segment_metadata(log: DataFrame, window_s: int, ttl0: str = "window") -> DataFrame:
    """One row a segment: bounds, counts, bytes, cohort of its first key, latest death, merkle root."""
    bucket = cohort_bucket(F.col("ts_ns"), F.col("ttl_s"), window_s)
    death = death_time(F.col("ts_ns"), F.col("ttl_s"), window_s, ttl0)
    encoded = encode_key(F.col("ns"), F.col("key"))
    return (
        log.where("seg_id is not null").withColumn("_key", encoded).withColumn("_bucket", bucket).withColumn("_death", death)
        .groupBy("seg_id").agg(
            hex_lower(F.min("_key")).alias("min_key"), hex_lower(F.max("_key")).alias("max_key"),
            F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("record_count"),
            F.sum(F.octet_length("_key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"),
            F.min_by("_bucket", F.struct("_key", "lsn")).alias("cohort_bucket"), F.max("_death").alias("death_time"),
        )
    )


def segment_roots(log: DataFrame) -> DataFrame:
    """Merkle root of each segment's keys: hash of the sorted key hashes.

    The hashes are sorted by the exchange and run through the digest as they come,
    so a segment's size takes time but no memory.
    """
    hashed = log.where("seg_id is not null").select("seg_id", content_hash(encode_key(F.col("ns"), F.col("key"))).alias("h")).distinct()

    def run(batches):
        segment, digest = None, None
        for pdf in batches:
            for number, part in pdf.groupby("seg_id", sort=False):
                if number != segment:
                    if digest is not None:
                        yield pd.DataFrame({"seg_id": [segment], "merkle_root": [digest.hexdigest()]})
                    segment, digest = int(number), hashlib.sha256()
                digest.update("".join(part["h"]).encode())
        if digest is not None:
            yield pd.DataFrame({"seg_id": [segment], "merkle_root": [digest.hexdigest()]})

    return hashed.repartition("seg_id").sortWithinPartitions("seg_id", "h").mapInPandas(run, "seg_id bigint, merkle_root string")


def range_roots(segments: DataFrame, per_range: int = 100) -> DataFrame:
    """Root of each range of segment ids, from the raw segment hashes (at most ``per_range`` a group)."""
    return (
        segments.withColumn("range_no", F.floor(F.col("segment_id") / per_range).cast("bigint"))
        .groupBy("range_no").agg(merkle_root(hash_text(F.col("segment_hash"))).alias("root"))
    )


def store_root(segments: DataFrame) -> DataFrame:
    """One root over all segment hashes of a store (the manifest is small: one row a segment)."""
    return range_roots(segments).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("range_no", "root"))), lambda x: x["root"])), 256).alias("root"))


def latest_answers(responses: DataFrame) -> DataFrame:
    """The newest merkle answer of each host and range, hashes in one spelling."""
    last = newest(responses.where("range_no is not null"), ["host_name", "range_no"], [F.desc_nulls_last("probed_at"), F.asc_nulls_last("root")])
    return last.select("host_name", "range_no", hash_text(F.col("root")).alias("root"))


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges (``range_no``) whose roots differ or that one side lacks."""
    a, b = left.select("range_no", F.col("root").alias("left_root")), right.select("range_no", F.col("root").alias("right_root"))
    return a.join(b, "range_no", "full_outer").where(~F.col("left_root").eqNullSafe(F.col("right_root")))


def merkle_buckets(segments: DataFrame, per_group: int = 4_096) -> DataFrame:
    """Tree of sixteen ``bucket`` hashes over key ranges, all of them there, zeros for an empty one.

    A segment is in the bucket of the high four bits of its least user key.  A
    bucket is the hash of its segments' merkle roots in the order of ids, taken in
    groups of ``per_group`` ids and then over the groups, so no array grows with the
    bucket but by a row for every group.
    """
    key_hex = F.hex("min_key")
    ns_len = F.conv(F.substring(key_hex, 1, 4), 16, 10).cast("int")
    nibble = F.conv(F.substring(F.substr(key_hex, F.lit(5) + ns_len * 2), 1, 1), 16, 10).cast("int")
    placed = segments.select("segment_id", F.coalesce(hash_text(F.col("merkle_root")), F.lit("")).alias("root"), F.coalesce(nibble, F.lit(0)).alias("bucket"))
    joined = lambda order, what: F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda x: x[what])), 256)
    groups = placed.withColumn("part", F.floor(F.col("segment_id") / per_group)).groupBy("bucket", "part").agg(joined("segment_id", "root").alias("root"))
    held = groups.groupBy("bucket").agg(joined("part", "root").alias("root"))
    return segments.sparkSession.range(16).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left").select("bucket", F.coalesce("root", F.lit("0" * 64)).alias("root"))


def merkle_tree_root(buckets: DataFrame) -> DataFrame:
    """One row: the hash over the sixteen buckets in order."""
    return buckets.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "root"))), lambda x: x["root"])), 256).alias("root"))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """``bucket`` numbers whose hashes differ between two trees."""
    both = left.join(right.select("bucket", F.col("root").alias("_other")), "bucket", "full_outer")
    return both.where(~F.col("root").eqNullSafe(F.col("_other"))).select("bucket")


def missing_segments(local: DataFrame, peer: DataFrame) -> DataFrame:
    """The peer's segments (copies kept) whose hash the local store lacks; unknown hashes are missing."""
    mine = local.select(hash_text(F.col("segment_hash")).alias("_h")).where("_h is not null").distinct()
    theirs = peer.withColumn("_h", hash_text(F.col("segment_hash")))
    return theirs.join(mine, "_h", "left_anti").drop("_h")


def import_lww(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge of two logs by writer's time: an incoming version wins only if it is later; a tie stays local."""
    both = local.withColumn("_local", F.lit(True)).unionByName(incoming.withColumn("_local", F.lit(False)))
    return newest(both, order=[F.desc("ts_ns"), F.desc("_local"), F.desc("lsn")])


def import_counts(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: records ``written`` and ``skipped`` by importing the incoming newest versions."""
    mine = newest(local, order=[F.desc("ts_ns"), F.desc("lsn")]).select("ns", "key", F.col("ts_ns").alias("_mine"))
    theirs = newest(incoming, order=[F.desc("ts_ns"), F.desc("lsn")])
    wins = F.col("_mine").isNull() | (F.col("ts_ns") > F.col("_mine"))
    return theirs.join(mine, ["ns", "key"], "left").agg(
        F.coalesce(F.sum(wins.cast("bigint")), F.lit(0)).alias("written"), F.coalesce(F.sum((~wins).cast("bigint")), F.lit(0)).alias("skipped")
    )


def resequence(rows: DataFrame, last_lsn: int, order: list[Column]) -> DataFrame:
    """New local LSNs after ``last_lsn`` in the given order, without one task for all rows."""
    from tidelog.operators.kv import running_total

    keyed = rows.withColumn("_order", F.struct(*order))
    return running_total(keyed, ["_order"], F.lit(1), "_n").withColumn("lsn", F.col("_n") + last_lsn).drop("_n", "_order")


def overlapping(segments: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Segments whose key bounds meet ``start <= key < end`` (``end`` None: the point ``start``)."""
    if end is None:
        return segments.where((F.col("min_key") <= start) & (F.col("max_key") >= start))
    return segments.where((F.col("max_key") >= start) & (F.col("min_key") < end))


def prune(segments: DataFrame, gone: DataFrame) -> DataFrame:
    return segments.join(gone.select("segment_id").distinct(), "segment_id", "left_anti")


def manifest_json(segments: DataFrame) -> DataFrame:
    """The manifest as JSON lines: one object a segment, keys and hashes in hex."""
    return segments.select(
        "segment_id",
        F.to_json(
            F.struct(
                F.lit(1).alias("format_version"), "segment_id", hash_text(F.col("segment_hash")).alias("hash"),
                hex_lower(F.col("min_key")).alias("min_key"), hex_lower(F.col("max_key")).alias("max_key"), "min_lsn", "max_lsn", "record_count",
            )
        ).alias("entry"),
    )


def tiered(hot: DataFrame, cold: DataFrame, compat: bool = False) -> DataFrame:
    """Live rows of a hot and a cold log.

    By default one version choice over both, so a hot delete hides a cold put.
    ``compat`` merges live rows and lets hot ones win, which brings deleted keys back.
    """
    if not compat:
        return newest(hot.unionByName(cold)).where(F.col("op") != DELETE)
    mine = newest(hot).where(F.col("op") != DELETE)
    theirs = newest(cold).where(F.col("op") != DELETE)
    return mine.unionByName(theirs.join(mine.select("ns", "key"), ["ns", "key"], "left_anti"))


def register_archived(archived: DataFrame) -> DataFrame:
    """Archived segments, one of each hash; those of unknown hash can't be told apart by it and all stay."""
    known = archived.withColumn("_h", hash_text(F.col("segment_hash")))
    window = Window.partitionBy("_h").orderBy("segment_id", "segment_hash")
    first = known.where("_h is not null").withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
    return first.unionByName(known.where("_h is null")).drop("_h")
