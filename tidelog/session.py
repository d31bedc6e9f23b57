"""Sessions, table access and cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidelog-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Paths this process has made below the shared folder.
_MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` removes it with the rest."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate files; call it when the results that were read from them are stored."""
    while _MADE:
        drop_path(spark, _MADE.pop())


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Executors that are lost later cost nothing, the rows are in files.  Unlike
    ``checkpoint()`` the files are columnar, so later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where its files give fewer than half as many partitions; else unchanged.

    For work that costs far more per row than moving the row, on a table in a
    single small file; a table of many files is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() * 2 <= cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
