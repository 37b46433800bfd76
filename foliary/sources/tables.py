"""Tables as numbered versions below a folder of the shared store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from foliary.schemas import SIDECAR

def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def numbers(
    spark: SparkSession, path: str, prefix: str, written_last: str = "_SUCCESS"
) -> list[int]:
    """Numbers of the completely written folders of that prefix, ascending."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    done = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        number = name.removeprefix(prefix)
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), written_last)
        if name != number and number.isdigit() and files.exists(marker):
            done.append(int(number))
    return sorted(done)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a whole table."""
    return numbers(spark, path, "v")


def _next(spark: SparkSession, path: str) -> int:
    return max([0, *versions(spark, path), *numbers(spark, f"{path}/changes", "batch=")]) + 1


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write a whole table as its next version.

    Readers keep the version they opened; a version counts once it is complete, so a lost
    writer leaves the current one in place. A version contains all changes numbered below it.
    """
    spark = df.sparkSession
    target = f"{path}/v{_next(spark, path):08d}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def write_changes(rows: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """Write rows that replace or join those of the same hash, and hashes that lose theirs.

    A batch of changes costs what it changes, whatever the size of the table.
    """
    spark = rows.sparkSession
    changes = rows.withColumn("_gone", F.lit(False))
    if gone is not None:
        lost = gone.select("sha256", F.lit(True).alias("_gone"))
        changes = changes.unionByName(lost, allowMissingColumns=True)
    number = _next(spark, path)
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number:08d}")


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version with the changes made since.

    The changed hashes are few beside the table, so the version is read past them without a
    shuffle of its own.
    """
    done = versions(spark, path)
    newest = done[-1] if done else 0
    base = spark.createDataFrame([], schema)
    if done:
        base = spark.read.schema(schema).parquet(f"{path}/v{newest:08d}")
    pending = [n for n in numbers(spark, f"{path}/changes", "batch=") if n > newest]
    if not pending:
        return base
    columns = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    columns = columns.add("_gone", BooleanType()).add("batch", IntegerType())
    changes = (
        spark.read.schema(columns)
        .option("basePath", f"{path}/changes")
        .parquet(*[f"{path}/changes/batch={n:08d}" for n in pending])
    )
    winners = changes.groupBy("sha256").agg(F.max("batch").alias("batch"))
    latest = changes.join(winners, ["sha256", "batch"], "left_semi").filter("NOT _gone")
    kept = base.join(winners.select("sha256"), "sha256", "left_anti")
    names = schema.fieldNames()
    return kept.select(*names).unionByName(latest.select(*names))


def compact(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Fold the changes into a new version; a maintenance job, not part of any batch."""
    return publish(current(spark, path, schema), path)


def append_sidecars(rows: DataFrame, path: str) -> None:
    """Add stored texts, in folders by the first digits of the hash."""
    shard = F.concat(F.lit("h"), F.substring("sha256", 1, 2))
    rows.withColumn("shard", shard).repartition("shard", F.substring("sha256", 3, 1)).write.mode(
        "append"
    ).partitionBy("shard").parquet(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """All stored texts; reading only hashes does not touch the texts."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return spark.createDataFrame([], SIDECAR)
    return spark.read.parquet(path).select(*SIDECAR.fieldNames())
