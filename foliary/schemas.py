"""Row types shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per object found under a prefix.
LISTING = T.StructType(
    [
        T.StructField("s3_bucket", T.StringType(), False),
        T.StructField("s3_key", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("etag", T.StringType(), False),
    ]
)

# One row per content hash: where the content was last seen and how far it got.
REGISTRY = T.StructType(
    [
        T.StructField("sha256", T.StringType(), False),
        T.StructField("s3_bucket", T.StringType(), False),
        T.StructField("s3_key", T.StringType(), False),
        T.StructField("text_s3_key", T.StringType()),
        T.StructField("filename", T.StringType(), False),
        T.StructField("content_type", T.StringType()),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("etag", T.StringType()),
        T.StructField("extractor_version", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("seen_at", T.TimestampType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("error", T.StringType()),
    ]
)

# One sighting of a content hash at a location, in arrival order.
SIGHTING = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("s3_bucket", T.StringType(), False),
        T.StructField("s3_key", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("etag", T.StringType()),
        T.StructField("seen_at", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)

# The payload of one queued job.
JOB = T.StructType(
    [T.StructField("bucket", T.StringType()), T.StructField("key", T.StringType())]
)

# The body of one bucket notification.
NOTIFICATION = T.StructType(
    [
        T.StructField(
            "Records",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "s3",
                            T.StructType(
                                [
                                    T.StructField(
                                        "bucket",
                                        T.StructType([T.StructField("name", T.StringType())]),
                                    ),
                                    T.StructField(
                                        "object",
                                        T.StructType([T.StructField("key", T.StringType())]),
                                    ),
                                ]
                            ),
                        )
                    ]
                )
            ),
        )
    ]
)

# The stored text of one content hash, with the verdict of the text gate.
SIDECAR = T.StructType(
    [
        T.StructField("sha256", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("extractor_version", T.StringType(), False),
        T.StructField("extracted_at", T.TimestampType(), False),
        T.StructField("needs_ocr", T.BooleanType()),
    ]
)

# One searchable document.
CORPUS = T.StructType(
    [
        T.StructField("sha256", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("s3_bucket", T.StringType(), False),
        T.StructField("s3_key", T.StringType(), False),
        T.StructField("content_type", T.StringType()),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("extractor_version", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)
CORPUS_COLUMNS = CORPUS.fieldNames()
