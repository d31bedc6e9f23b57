"""Processing only new or changed records.

``ChangeCapture`` is a log-based change capture: the log is cut by LSN into
partitions, each with an offset, the arrival up to which it has been handled.  A
batch writes its plan (from and to of every partition with something new) before
it works, a failed batch is replayed from that very plan, and the sink leaves out
records (key and LSN) it already holds.  ``pending`` seeds the offsets from a
ledger of runs and takes one such batch; ``segments_to_read`` tells which
segments can hold it.

Defined cases: damaged records are no records; a record counts from its earliest
undamaged arrival; records without LSN take no part, those without any arrival
are handled by no run and delivered once; keys may be null; runs with null or
empty bounds, with no start or with another status than committed have handled
nothing; a segment with unknown LSN bounds is always read; empty inputs give
empty results; other columns, whatever their names, are carried or ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.bytesx import undamaged
from tidelog.operators.kv import running_total
from tidelog.session import drop_path, materialise, scratch

#: LSNs per log partition; the least width, see ``_width``.
PARTITION_WIDTH = 1024
#: Most partitions, beyond two a run.
MOST_PIECES = 1_000_000
IDENTITY = ("ns_bytes", "key_bytes", "lsn")


def handled_ranges(runs: DataFrame) -> DataFrame:
    """(``from_lsn``, ``to_lsn``] and start of the committed runs, repeated ranges by their latest start."""
    good = runs.where((F.lower(F.trim("status")) == "committed") & (F.col("from_lsn") < F.col("to_lsn")) & F.col("started_at").isNotNull())
    return good.groupBy("from_lsn", "to_lsn").agg(F.max("started_at").alias("started_at"))


def _width(span: int) -> int:
    """Partition width that keeps the number of partitions bounded whatever the LSNs span."""
    return max(PARTITION_WIDTH, span // MOST_PIECES + 1)


def run_offsets(runs: DataFrame, width: int | None = None) -> tuple[DataFrame, int]:
    """Offsets that a ledger of runs amounts to, and the partition width.

    Rows ``part``, ``lo``, ``hi``, ``done_at``: the records of ``lo < lsn <= hi``
    that arrived until ``done_at`` have been handled.  The partitions are the
    stretches between neighbouring run borders, so every run covers a partition
    wholly or not at all and one moment says it all.  The latest start over all
    runs that cover a stretch comes from dyadic intervals: a range is at most two
    of them a level, a stretch lies in one a level, so crowded or nested runs
    never meet each other in pairs.
    """
    ranges = materialise(handled_ranges(runs), "ranges")
    size = F.col("to_lsn") - F.col("from_lsn")
    total, longest = ranges.agg(F.sum(size), F.max(size)).first()
    width = width or _width(int(total or 0))
    levels = int(longest or 1).bit_length()
    spans = ranges.select((F.col("from_lsn") + 1).alias("x"), (F.col("to_lsn") + 1).alias("y"), "started_at")
    # cover of [x, y): at level l the odd ends of [ceil(x / 2^l), floor(y / 2^l))
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    edges = spans.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"a": F.expr("shiftright(x + shiftleft(1L, l) - 1, l)"), "b": F.expr("shiftright(y, l)")})
    picked = edges.where("a < b").select("l", "started_at", F.explode(F.array_compact(F.array(F.when(odd("a"), F.col("a")), F.when(odd("b"), F.col("b") - 1)))).alias("i"))
    nodes = picked.groupBy("l", "i").agg(F.max("started_at").alias("started_at"))
    ends = spans.select(F.explode(F.array("x", "y")).alias("at"))
    cuts = spans.select(F.explode(F.expr(f"sequence(floor(x / {width}), floor((y - 1) / {width}))")).alias("part")).distinct()
    points = ends.unionByName(cuts.select((F.col("part") * width).alias("at"))).distinct()
    held = (
        points.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("i", F.expr("shiftright(at, l)"))
        .join(nodes, ["l", "i"]).groupBy("at").agg(F.max("started_at").alias("done_at"))
    )
    part = F.floor(F.col("at") / width).cast("bigint")
    following = F.lead("at").over(Window.partitionBy("part").orderBy("at"))
    tiled = points.join(held, "at", "left").withColumn("part", part).withColumn("_next", following)
    return tiled.select("part", (F.col("at") - 1).alias("lo"), (F.coalesce("_next", (F.col("part") + 1) * width) - 1).alias("hi"), "done_at"), width


class ChangeCapture:
    """Exactly-once batches over an append-only log, restartable at any point.

    ``state_dir`` holds the plans written ahead, the offsets after each commit and
    the list of batches; ``sink_dir`` one folder a batch, which a replay
    overwrites.  Only the newest offsets are read and a batch is held against
    those earlier ones alone whose LSNs meet its own, so the cost of a run follows
    what is new and not the history.  Arrival is the position within a partition.
    Rows that turn up below an offset, against that order, are noticed by their
    number; their partition is read anew and the sink drops what it holds.
    """

    def __init__(self, spark: SparkSession, state_dir: str, sink_dir: str, width: int | None = None):
        self.spark, self.state, self.sink, self.fixed_width = spark, state_dir, sink_dir, width

    # -- state
    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _numbers(self, kind: str) -> list[int]:
        """Batches whose ``kind`` folder is complete."""
        fs, path = self._fs(f"{self.state}/{kind}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.state}/{kind}/{n}/_SUCCESS")[1]))

    def _committed(self) -> int | None:
        done = self._numbers("commits")
        return done[-1] if done else None

    def offsets(self) -> DataFrame | None:
        """``part``, ``lo``, ``hi``, ``done_at``, ``held`` after the last commit; ``held`` rows had arrived by then."""
        last = self._committed()
        return None if last is None else self.spark.read.parquet(f"{self.state}/offsets/{last}")

    def _batches(self) -> list[tuple]:
        """(batch, width, lowest and highest LSN) of each committed batch, one row a batch."""
        last = self._committed()
        return [] if last is None else [tuple(r) for r in self.spark.read.parquet(f"{self.state}/commits/{last}").select("batch", "width", "low", "high").collect()]

    def _commit(self, number: int, offsets: DataFrame, width: int, low: int | None, high: int | None) -> None:
        offsets.write.mode("overwrite").parquet(f"{self.state}/offsets/{number}")
        known = [b for b in self._batches() if b[0] != number] + [(number, width, low, high)]
        self.spark.createDataFrame(known, "batch bigint, width bigint, low bigint, high bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/commits/{number}")
        for kind in ("plans", "offsets", "commits"):  # the newest two are enough to restart from
            for old in self._numbers(kind):
                if old < number - 1:
                    drop_path(self.spark, f"{self.state}/{kind}/{old}")

    def seed(self, runs: DataFrame) -> None:
        """Start from the offsets that a ledger of earlier runs amounts to."""
        if self._committed() is not None:
            raise ValueError("the capture has offsets already")
        offsets, width = run_offsets(runs, self.fixed_width)
        self._commit(0, offsets.withColumn("held", F.lit(None).cast("bigint")), width, None, None)

    # -- batches
    @staticmethod
    def _within(a: str, b: str) -> Column:
        return F.expr(f"{a}.part = {b}.part and {a}.lsn > {b}.lo and {a}.lsn <= {b}.hi")

    def plan(self, log: DataFrame) -> int:
        """The number of the batch to run: an uncommitted plan if there is one, else a new one."""
        last = self._committed()
        waiting = [n for n in self._numbers("plans") if last is None or n > last]
        if waiting:
            return waiting[0]
        number = 1 if last is None else last + 1
        known, batches = self.offsets(), self._batches()
        rows = log.where("lsn is not null").select("lsn", "arrived_at")
        if batches:
            width = batches[0][1]
        elif self.fixed_width:
            width = self.fixed_width
        else:
            low, high = rows.agg(F.min("lsn"), F.max("lsn")).first()
            width = _width(int((high or 0) - (low or 0)))
        rows = rows.withColumn("part", F.floor(F.col("lsn") / width).cast("bigint"))
        if known is None:
            at = rows.schema["arrived_at"].dataType
            placed = rows.select("part", "arrived_at", *[F.lit(None).cast(t).alias(c) for c, t in (("lo", "bigint"), ("hi", "bigint"), ("done_at", at), ("held", "bigint"))])
        else:
            placed = rows.alias("r").join(known.alias("o"), self._within("r", "o"), "left").select("r.part", "r.arrived_at", "o.lo", "o.hi", "o.done_at", "o.held")
        ends = placed.groupBy("part", "lo", "hi").agg(
            F.max("arrived_at").alias("to_at"), F.max("done_at").alias("from_at"), F.max("held").alias("held"), F.count("arrived_at").alias("arrived"),
            F.count_if(F.col("arrived_at") <= F.col("done_at")).alias("below"), F.count_if(F.col("arrived_at").isNull()).alias("unplaced"),
        )
        opened = F.when(F.col("held").isNotNull() & (F.col("below") > F.col("held")), F.lit(None)).otherwise(F.col("from_at"))
        planned = ends.withColumn("from_at", opened).where("from_at is null or to_at > from_at or unplaced > 0").select(
            "part", F.coalesce("lo", F.col("part") * width - 1).alias("lo"), F.coalesce("hi", (F.col("part") + 1) * width - 1).alias("hi"),
            "from_at", "to_at", F.col("arrived").alias("held"), F.lit(width).cast("bigint").alias("width"),
        )
        planned.write.mode("overwrite").parquet(f"{self.state}/plans/{number}")
        return number

    def read(self, log: DataFrame, number: int, columns: list[str] | None = None) -> DataFrame:
        """The records between a plan's offsets, one row of each (key, LSN), with ``arrived_at`` and ``columns`` (all by default)."""
        plan = self.spark.read.parquet(f"{self.state}/plans/{number}")
        width, low, high = plan.agg(F.max("width"), F.min("lo"), F.max("hi")).first()
        columns = [c for c in log.columns if c not in (*IDENTITY, "arrived_at")] if columns is None else list(columns)
        good = log.where(undamaged(F.col("op"), F.col("value_bytes"), F.col("value_hash")))
        good = good.where(F.lit(False)) if width is None else good.where((F.col("lsn") > low) & (F.col("lsn") <= high))
        part = F.floor(F.col("lsn") / (width or 1)).cast("bigint").alias("part")
        bounds = [F.col(f"p.{c}") for c in ("from_at", "to_at")]
        narrow = good.select(*IDENTITY, "arrived_at", part).alias("r").join(plan.alias("p"), self._within("r", "p")).select(*IDENTITY, "r.arrived_at", *bounds)
        first = narrow.groupBy(*IDENTITY).agg(F.min("arrived_at").alias("arrived_at"), F.max("from_at").alias("from_at"), F.max("to_at").alias("to_at"))
        fresh = first.where("arrived_at is null or ((from_at is null or arrived_at > from_at) and arrived_at <= to_at)").select(*IDENTITY, "arrived_at")
        if not columns:
            return fresh
        order = Window.partitionBy(*IDENTITY).orderBy(F.asc_nulls_last("arrived_at"), *[F.col(c) for c, t in good.select(*columns).dtypes if not t.startswith("map")])
        copies = good.join(fresh.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY]), self._same([f"_{c}" for c in IDENTITY]), "left_semi")
        return copies.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").select(*IDENTITY, "arrived_at", *columns)

    @staticmethod
    def _same(names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) if c != "lsn" else F.col(c) == F.col(n) for c, n in zip(IDENTITY, names)))

    def run(self, log: DataFrame, transform=None, fail_before: str | None = None, columns: list[str] | None = None) -> int:
        """One batch; returns its number.  ``fail_before`` ('plan', 'write', 'offsets', 'commit') stops there, for tests.

        ``transform`` sees the new records and must keep ``ns_bytes``, ``key_bytes`` and ``lsn``.
        """

        def reach(step: str) -> None:
            if fail_before == step:
                raise RuntimeError(f"stopped before: {step}")

        reach("plan")
        number = self.plan(log)
        plan = self.spark.read.parquet(f"{self.state}/plans/{number}")
        width, low, high = plan.agg(F.max("width"), F.min("lo"), F.max("hi")).first()
        rows = self.read(log, number, columns)
        earlier = [b for b, _, lo, hi in self._batches() if lo is not None and low is not None and lo <= high and hi > low]
        if earlier:
            held = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.sink}/batch={b}" for b in earlier]).where((F.col("lsn") > low) & (F.col("lsn") <= high))
            rows = rows.join(held.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY]), self._same([f"_{c}" for c in IDENTITY]), "left_anti")
        reach("write")
        (transform(rows) if transform else rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.sink}/batch={number}")
        reach("offsets")
        done = plan.select("part", "lo", "hi", F.coalesce("to_at", "from_at").alias("done_at"), "held")
        known = self.offsets()
        if known is not None:
            done = known.join(plan, ["part", "lo", "hi"], "left_anti").select(*done.columns).unionByName(done)
        reach("commit")
        low, high = self.delivered(number).agg(F.min("lsn"), F.max("lsn")).first()
        batches = self._batches()
        self._commit(number, done, width if width is not None else batches[0][1] if batches else self.fixed_width or PARTITION_WIDTH, low, high)
        return number

    def delivered(self, number: int) -> DataFrame:
        """What the sink holds of a batch."""
        return self.spark.read.parquet(f"{self.sink}/batch={number}")


def pending(wal: DataFrame, runs: DataFrame) -> DataFrame:
    """``lsn`` and ``arrived_at`` of the records no committed run has handled: one captured batch after the ledger's offsets."""
    spark = wal.sparkSession
    job = ChangeCapture(spark, scratch(spark, "capture-state"), scratch(spark, "capture-sink"))
    job.seed(runs)
    return job.delivered(job.run(wal, columns=[])).groupBy("lsn").agg(F.min("arrived_at").alias("arrived_at"))


def segments_to_read(live: DataFrame, waiting: DataFrame) -> DataFrame:
    """Live segments whose LSN bounds can hold pending records, and how many they may hold.

    Pending LSNs and segment bounds go through one ordered running count, so no
    pair of segment and record is ever formed.
    """
    known = "min_lsn is not null and max_lsn is not null"
    lsns = waiting.select(F.col("lsn").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("segment_id"))
    opens = live.where(known).select(F.col("min_lsn").alias("at"), F.lit(0).alias("kind"), "segment_id")  # before records at the same LSN
    closes = live.where(known).select(F.col("max_lsn").alias("at"), F.lit(2).alias("kind"), "segment_id")
    counted = running_total(lsns.unionByName(opens).unionByName(closes), ["at", "kind", "segment_id"], (F.col("kind") == 1).cast("bigint"), "seen")
    held = (
        counted.where("segment_id is not null").groupBy("segment_id")
        .agg((F.max(F.when(F.col("kind") == 2, F.col("seen"))) - F.max(F.when(F.col("kind") == 0, F.col("seen")))).alias("may_hold"))
        .where("may_hold > 0")
    )
    unknown = live.where(f"not ({known})").select("segment_id", F.lit(None).cast("bigint").alias("may_hold"))
    return held.unionByName(unknown)
