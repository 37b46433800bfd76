"""Object listings and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.objects import bare_etag, content_type
from foliary.settings import DEFAULTS


def from_inventory(inventory: DataFrame, prefix: str = DEFAULTS.raw_prefix) -> DataFrame:
    """Listing rows of an inventory table below a prefix, with bare etags."""
    return inventory.filter(F.col("s3_key").startswith(prefix)).select(
        "s3_bucket", "s3_key", F.col("size_bytes").cast("long"), bare_etag(F.col("etag")).alias("etag")
    )


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )


def _place(root: str, bucket: str):
    # Paths come back as URIs, so the key is what follows the decoded root.
    decoded = F.col("path")
    below = F.substring_index(decoded, root.rstrip("/") + "/", -1)
    return F.lit(bucket).alias("s3_bucket"), below.alias("s3_key")


def list_directory(
    spark: SparkSession,
    root: str,
    bucket: str = DEFAULTS.bucket,
    prefix: str = DEFAULTS.raw_prefix,
) -> DataFrame:
    """List the files below a root folder; contents are not read.

    A folder has no etags, so length and modification time stand in for one.
    """
    version = F.md5(
        F.concat_ws(":", F.col("length"), F.unix_micros("modificationTime")).cast("binary")
    )
    return (
        _files(spark, root)
        .select(*_place(root, bucket), F.col("length").alias("size_bytes"), version.alias("etag"))
        .filter(F.col("s3_key").startswith(prefix))
    )


def read_objects(
    spark: SparkSession,
    root: str,
    bucket: str = DEFAULTS.bucket,
    prefix: str = DEFAULTS.raw_prefix,
) -> DataFrame:
    """The listing with the content of every file."""
    version = F.md5(
        F.concat_ws(":", F.col("length"), F.unix_micros("modificationTime")).cast("binary")
    )
    return (
        _files(spark, root)
        .select(
            *_place(root, bucket),
            F.col("length").alias("size_bytes"),
            version.alias("etag"),
            "content",
        )
        .withColumn("content_type", content_type(F.col("s3_key")))
        .filter(F.col("s3_key").startswith(prefix))
    )
