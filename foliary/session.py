"""Session helpers: configuration, the shared working folder, checked broadcasts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on (instants are UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def arrow_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and by bytes: whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def local_session(cores: int | str = "*", name: str = "foliary") -> SparkSession:
    """A single-machine session for tests and the bench."""
    parallel = "8" if cores == "*" else str(cores)
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: `spark.checkpoint.dir` of the session.

    A session without that setting uses its warehouse, which all executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/foliary-work"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark)}/foliary/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a frame used several times by writing it as a table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    written.written_at = path
    return written


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Writes into folders, a few by each task, without sorting the rows by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize`; what is computed from them must have been written before."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work a task per core when the input has fewer splits than that.

    A large input has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rows_within(df: DataFrame, limit: int) -> bool:
    """Whether the frame has at most `limit` rows; counts no further than that."""
    return df.select(F.lit(1).alias("one")).limit(limit + 1).count() <= limit


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread_by: str,
    small: bool,
    salts: int,
) -> DataFrame:
    """Join a large, possibly skewed frame with a lookup frame.

    A lookup whose row count was checked (`small`) is broadcast, so the large side stays where
    it is. A larger lookup is repeated once per salt and joined on key plus salt, so the rows
    of one hot key spread over `salts` tasks.
    """
    if small:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def hot_key_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: str, rows_per_task: int
) -> DataFrame:
    """Inner join in which only keys with many left rows are salted.

    A key with more than `rows_per_task` left rows is cut into as many pieces as it needs, and
    only its right rows are repeated. There are at most rows / rows_per_task such keys, so the
    frame that lists them stays small.
    """
    pieces = F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int")
    hot = left.groupBy(*on).agg(pieces.alias("_pieces")).filter("_pieces > 1")
    if hot.isEmpty():
        return left.join(right, on)
    cuts = F.coalesce("_pieces", F.lit(1))
    salted = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), cuts).cast("int")
    )
    repeated = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), cuts - 1))
    )
    return salted.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_salt"]).drop("_salt")


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column, counted."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def layout(total_bytes: int, target_bytes: int, low: int = 1) -> int:
    """How many directories of about `target_bytes` a table of that size needs."""
    return max(low, math.ceil(total_bytes / target_bytes))
