"""Compare a bucket listing, or the corpus, with the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.objects import job_payload
from foliary.operators.registry import PLACE


def reconcile(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Objects to ingest: `new` ones, and `changed` ones whose etag differs.

    One equi-join on the unique (bucket, key) replaces a point read per object. A registry row
    without an etag counts as changed. If the listing carries content hashes, the result also
    tells whether the content is registered at another place.
    """
    known = registry.select(*PLACE, F.col("etag").alias("_etag"), F.lit(True).alias("_known"))
    found = (
        listing.join(known, PLACE, "left")
        .filter(F.col("_known").isNull() | ~F.col("etag").eqNullSafe(F.col("_etag")))
        .withColumn("state", F.when(F.col("_known").isNull(), "new").otherwise("changed"))
        .withColumn("payload", job_payload(F.col("s3_bucket"), F.col("s3_key")))
        .drop("_etag", "_known")
    )
    if "sha256" not in listing.columns:
        return found
    hashes = registry.select("sha256", F.lit(True).alias("known_duplicate"))
    return found.join(hashes, "sha256", "left").fillna(False, ["known_duplicate"])


def sweep_summary(listing: DataFrame, registry: DataFrame) -> DataFrame:
    return reconcile(listing, registry).groupBy("state").agg(F.count(F.lit(1)).alias("objects"))


def index_audit(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows in which corpus and registry disagree, and how many agree.

    `orphan`: in the corpus without an indexed registry row; `missing`: indexed but not in the
    corpus.
    """
    expected = registry.filter("status = 'indexed'").select("sha256", F.lit(1).alias("_row"))
    present = corpus.select("sha256", F.lit(1).alias("_doc"))
    state = (
        F.when(F.col("_row").isNull(), "orphan")
        .when(F.col("_doc").isNull(), "missing")
        .otherwise("matched")
    )
    return expected.join(present, "sha256", "full_outer").select("sha256", state.alias("state"))
