"""Queue payloads, bucket notifications and uploads as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.objects import (
    bare_etag,
    content_address,
    content_hash,
    job_payload,
    parsed_job,
)
from foliary.schemas import NOTIFICATION
from foliary.settings import DEFAULTS, Settings


def parse_notifications(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(bucket, key) of every record; records with a null or empty part are dropped."""
    parsed = F.from_json(F.col(body), NOTIFICATION)
    record = F.explode(parsed["Records"])
    return (
        bodies.select(*[c for c in bodies.columns if c != body], record.alias("_record"))
        .withColumn("s3_bucket", F.col("_record.s3.bucket.name"))
        .withColumn("s3_key", F.col("_record.s3.object.key"))
        .drop("_record")
        .filter("s3_bucket <> '' AND s3_key <> ''")
    )


def notification_jobs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Notifications as job payloads."""
    return parse_notifications(bodies, body).select(
        job_payload(F.col("s3_bucket"), F.col("s3_key")).alias("payload")
    )


def decode_jobs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads with bucket and key, or with the reason why they are set aside."""
    job = parsed_job(F.col(payload))
    reason = F.when(
        job.isNull() | (job["bucket"].isNull() & job["key"].isNull()), "not a job"
    ).when(job["bucket"].isNull() | job["key"].isNull(), "missing field")
    return payloads.select(
        "*",
        job["bucket"].alias("s3_bucket"),
        job["key"].alias("s3_key"),
        reason.alias("reason"),
    )


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted uploads, and rejected ones with a reason."""
    reason = F.when(
        F.col("filename").isNull() | (F.col("filename") == ""), "filename is required"
    ).when(F.col("content").isNull() | (F.length("content") == 0), "empty file")
    checked = uploads.withColumn("reason", reason)
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def address_uploads(uploads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Uploads with hash, content address, size and job payload.

    `etag` is taken from the upload if the store gave one, otherwise from the content.
    """
    given = bare_etag(F.col("etag")) if "etag" in uploads.columns else F.lit(None).cast("string")
    hashed = uploads.withColumn("sha256", content_hash(F.col("content").cast("binary")))
    return (
        hashed.withColumn("s3_bucket", F.lit(settings.bucket))
        .withColumn(
            "s3_key", content_address(settings.raw_prefix, F.col("sha256"), F.col("filename"))
        )
        .withColumn("size_bytes", F.octet_length(F.col("content")).cast("long"))
        .withColumn("etag", F.coalesce(given, F.md5(F.col("content").cast("binary"))))
        .withColumn("payload", job_payload(F.col("s3_bucket"), F.col("s3_key")))
    )
