"""Column functions on objects: hashes, addresses, names, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.schemas import JOB


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, always derived from the content itself."""
    return F.sha2(content, 256)


def extension(filename: Column) -> Column:
    """The last dot of the last path segment and what follows; none for dot files."""
    return F.regexp_extract(filename, r"[^./][^/]*?(\.[^./]*)$", 1)


def content_address(prefix: str, sha256: Column, filename: Column) -> Column:
    return F.concat(F.lit(prefix), sha256, extension(filename))


def text_address(prefix: str, sha256: Column) -> Column:
    return F.concat(F.lit(prefix), sha256, F.lit(".txt"))


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def bare_etag(etag: Column) -> Column:
    return F.btrim(etag, F.lit('"'))


def job_payload(bucket: Column, key: Column) -> Column:
    return F.to_json(F.struct(bucket.alias("bucket"), key.alias("key")))


def parsed_job(payload: Column) -> Column:
    return F.from_json(payload, JOB)


# Content types by the ending of a key, as stores note them when an object arrives.
CONTENT_TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "htm": "text/html",
    "html": "text/html",
    "xml": "application/xml",
    "json": "application/json",
    "pdf": "application/pdf",
    "rtf": "application/rtf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
    "jpg": "image/jpeg",
    "png": "image/png",
    "tif": "image/tiff",
}
UNKNOWN_TYPE = "binary/octet-stream"
UNKNOWN_VERSION = "unknown"


def content_type(key: Column, given: Column | None = None) -> Column:
    """The type an object was stored with; without one, what the ending of its key says.

    A blank type counts as none, and an unknown ending as plain bytes.
    """
    ending = F.lower(F.regexp_extract(base_name(key), r"\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    guessed = F.coalesce(types[ending], F.lit(UNKNOWN_TYPE))
    return guessed if given is None else F.coalesce(F.nullif(F.trim(given), F.lit("")), guessed)


def stored_stamp(text: Column, now: Column) -> tuple[Column, Column]:
    """When a stored text was extracted, by its ISO-8601 note, and whether that note is unreadable.

    Without a note it is now. An unreadable one gives null and is flagged, so that a caller can set the
    row aside. A note without a zone is in UTC.
    """
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    whole = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    read = F.when(text.rlike(shape), F.try_to_timestamp(whole))
    return F.when(text.isNull(), now).otherwise(read), text.isNotNull() & read.isNull()


def stored_version(version: Column) -> Column:
    """The extractor's version noted with a stored text, or that it is unknown."""
    return F.coalesce(version, F.lit(UNKNOWN_VERSION))
