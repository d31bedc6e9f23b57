"""Time to live, death-time cohorts and compaction planning.

``now`` is always an argument.  A time to live of zero or null means none:
``ttl0='window'`` lets such records die after one cohort window, ``'permanent'``
never (the default of the write paths).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.bytesx import DELETE

NANOS = 1_000_000_000
NEVER = (1 << 63) - 1


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def cohort_bucket(ts_ns: Column, ttl_s: Column, window_s: int) -> Column:
    """Window number of a record's death: whole seconds of writing plus time to live, by the window."""
    return _div(_div(ts_ns, NANOS) + F.coalesce(ttl_s, F.lit(0)), window_s)


def death_time(ts_ns: Column, ttl_s: Column, window_s: int, ttl0: str = "permanent") -> Column:
    """Nanosecond at which a record may go; sums beyond the type stop at its largest value."""
    none = F.coalesce(ttl_s, F.lit(0)) == 0
    lives = F.when(none, F.lit(window_s).cast("bigint")).otherwise(ttl_s.cast("bigint"))
    sum_ = F.coalesce(F.try_add(ts_ns, F.try_multiply(lives, F.lit(NANOS))), F.lit(NEVER))
    return sum_ if ttl0 == "window" else F.when(none, F.lit(NEVER)).otherwise(sum_)


def cohorts(segments: DataFrame, now_ns: int) -> DataFrame:
    """Segments by cohort: latest death, records, bytes, expired or not; segments of unknown cohort apart."""
    return segments.groupBy("cohort_bucket").agg(
        F.max("death_time").alias("max_death"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("bytes"),
        F.count("*").alias("n_segments"),
    ).withColumn("expired", F.coalesce(F.lit(now_ns) > F.col("max_death"), F.lit(False)))


def expired_segments(segments: DataFrame, now_ns: int) -> DataFrame:
    """Segments of wholly expired cohorts: they go without being rewritten."""
    gone = cohorts(segments, now_ns).where("expired").select("cohort_bucket")
    return segments.join(gone, "cohort_bucket", "left_semi")


def compact_survivors(log: DataFrame, window_s: int, now_ns: int, ttl0: str = "window") -> DataFrame:
    """Rows a rewrite of every cohort keeps: newest of a key within the cohort, no deletes, not yet dead."""
    rows = log.withColumn("cohort_bucket", cohort_bucket(F.col("ts_ns"), F.col("ttl_s"), window_s))
    rows = rows.withColumn("death_time", death_time(F.col("ts_ns"), F.col("ttl_s"), window_s, ttl0))
    window = Window.partitionBy("cohort_bucket", "ns", "key").orderBy(F.desc("lsn"))
    best = rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
    return best.where((F.col("op") != DELETE) & (F.col("death_time") > now_ns))


def droppable_tombstones(log: DataFrame) -> DataFrame:
    """Deletes that hide nothing any more: no older version of their key is left in the log."""
    keys = log.groupBy("ns", "key").agg(F.count_distinct("lsn").alias("_versions"), F.max_by("op", "lsn").alias("_last"))
    return keys.where((F.col("_versions") == 1) & (F.col("_last") == DELETE)).select("ns", "key")


def compact_plan(segments: DataFrame, now_ns: int, budget_bytes: int, pinned: DataFrame | None = None) -> DataFrame:
    """Cohorts in the order of work with what is written before each; those within the budget are marked.

    Expired cohorts come first and cost nothing; the budget is looked at before
    a cohort starts.  Pinned segments are left out before cohorts are formed.
    The window runs over cohorts, one row each, not over segments.
    """
    free = segments if pinned is None else segments.join(pinned.select("segment_id").distinct(), "segment_id", "left_anti")
    plan = cohorts(free.where("cohort_bucket is not null"), now_ns)
    order = [F.desc("expired"), F.asc_nulls_last("max_death"), F.asc("cohort_bucket")]
    cost = F.when(F.col("expired"), 0).otherwise(F.col("bytes"))
    window = Window.orderBy(*order)
    before = F.coalesce(F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        plan.withColumn("step", F.row_number().over(window)).withColumn("bytes_before", before)
        .withColumn("chosen", F.col("bytes_before") < budget_bytes)
    )
