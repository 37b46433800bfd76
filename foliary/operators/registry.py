"""The registry of content hashes: sightings, status changes, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.objects import base_name
from foliary.schemas import REGISTRY
from foliary.settings import DEFAULTS

PLACE = ["s3_bucket", "s3_key"]
#: Groups of keys whose updates are counted before histories are cut into slots.
KEY_GROUPS = 4096
_KEPT = ["text_s3_key", "extractor_version", "extracted_at", "indexed_at", "status", "error"]


def _neighbour(
    events: DataFrame, keys: list[str], value: Column, name: str, ahead: bool, slotted: bool
) -> DataFrame:
    """The value of the next (or previous) event of the same key, by sequence number.

    With slots a hot key is cut into pieces of bounded size: neighbours are found inside a
    slot, and only the first (last) event of each slot is compared across slots.
    """
    group = [*keys, "_slot"] if slotted else keys
    step = F.lead if ahead else F.lag
    inside = Window.partitionBy(*group).orderBy("seq")
    events = events.withColumn("_value", F.struct(F.col("seq").alias("at"), value.alias("is")))
    found = events.withColumn(name, step("_value").over(inside))
    if not slotted:
        return found.drop("_value")
    edge = F.min("_value") if ahead else F.max("_value")
    across = Window.partitionBy(*keys).orderBy("_slot")
    edges = (
        events.groupBy(*group)
        .agg(edge.alias("_edge"))
        .withColumn("_far", step("_edge").over(across))
        .drop("_edge")
    )
    return (
        found.join(edges, group)
        .withColumn(name, F.coalesce(name, "_far"))
        .drop("_far", "_value")
    )


def most_of_a_key(updates: DataFrame) -> int:
    """A bound of the updates that one hash or one place has, from counts of groups of keys.

    Slots cost several shuffles, so many updates of many keys should not call for them.
    """
    kinds = F.array(F.xxhash64("sha256"), F.xxhash64(*PLACE))
    keys = updates.select(F.posexplode(F.transform(kinds, lambda key: F.pmod(key, F.lit(KEY_GROUPS)))).alias("kind", "group"))
    return keys.groupBy("kind", "group").count().agg(F.max("count")).first()[0] or 0


def _touched(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry rows, marked where an update names their hash or their place."""
    hashes = updates.select("sha256").distinct().withColumn("_by_hash", F.lit(True))
    places = updates.select(*PLACE).distinct().withColumn("_by_place", F.lit(True))
    return (
        registry.join(hashes, "sha256", "left")
        .join(places, PLACE, "left")
        .withColumn("_touched", F.coalesce("_by_hash", "_by_place", F.lit(False)))
        .drop("_by_hash", "_by_place")
    )


def _last_states(
    touched: DataFrame, updates: DataFrame, slot_rows: int, slotted: bool | None
) -> DataFrame:
    """The last event of every hash, with what its row holds and who took its place.

    A row lives at a place until another hash is seen there; a hash seen again after that
    starts over as `pending`. Only neighbours matter: the next event at the same place, and
    the previous event of the same hash.
    """
    columns = REGISTRY.fieldNames()
    if slotted is None:
        slotted = most_of_a_key(updates) > slot_rows
    old = touched.select(F.lit(0).cast("long").alias("seq"), *columns).withColumn(
        "source", F.lit("registry")
    )
    new = updates.withColumn("status", F.lit("pending")).withColumn(
        "filename", F.coalesce("filename", base_name(F.col("s3_key")))
    )
    events = old.unionByName(new, allowMissingColumns=True).withColumn(
        "_slot", F.floor(F.col("seq") / F.lit(slot_rows))
    )

    events = _neighbour(events, PLACE, F.col("sha256"), "_next_here", True, slotted)
    # A next event of the same hash leaves the row in place.
    taken = F.when(F.col("_next_here")["is"] != F.col("sha256"), F.col("_next_here"))
    events = events.withColumn("_taken", taken).drop("_next_here")
    events = _neighbour(events, ["sha256"], F.col("_taken"), "_before", False, slotted)

    lost = F.col("_before")["is"]["at"] < F.col("seq")
    fresh = F.col("_before").isNull() | F.coalesce(lost, F.lit(False))
    first = F.struct("seq", "filename", *_KEPT)
    uploaded = F.col("source") == "upload"
    last = F.struct(
        "seq", *PLACE, "content_type", "size_bytes", "etag", "seen_at", "_taken"
    )
    return events.groupBy("sha256").agg(
        F.max_by(F.when(fresh, first), F.when(fresh, F.col("seq"))).alias("start"),
        F.max(F.when(uploaded, F.struct("seq", "filename"))).alias("upload"),
        F.max_by(last, F.col("seq")).alias("last"),
    )


def seen_states(
    registry: DataFrame,
    updates: DataFrame,
    slot_rows: int = DEFAULTS.slot_rows,
    slotted: bool | None = None,
) -> DataFrame:
    """Where every hash the updates touch ends up; read by `surviving` and `retired`."""
    return _last_states(_touched(registry, updates).filter("_touched"), updates, slot_rows, slotted)


def surviving(states: DataFrame) -> DataFrame:
    """The registry rows of touched hashes."""
    named = F.coalesce(F.col("upload")["seq"] >= F.col("start")["seq"], F.lit(False))
    rows = states.filter(F.col("last")["_taken"].isNull()).select(
        "sha256",
        *[F.col("last")[c].alias(c) for c in PLACE],
        F.when(named, F.col("upload")["filename"])
        .otherwise(F.col("start")["filename"])
        .alias("filename"),
        *[F.col("last")[c].alias(c) for c in ("content_type", "size_bytes", "etag", "seen_at")],
        *[F.col("start")[c].alias(c) for c in _KEPT],
    )
    return rows.select(*REGISTRY.fieldNames())


def retired(states: DataFrame) -> DataFrame:
    """Touched hashes that end without a row, and the hash seen at their last place."""
    last = F.col("last")
    return states.filter(last["_taken"].isNotNull()).select(
        "sha256",
        *[last[c].alias(c) for c in PLACE],
        last["_taken"]["is"].alias("retired_by"),
        last["_taken"]["at"].alias("retired_seq"),
    )


def apply_seen(
    registry: DataFrame,
    updates: DataFrame,
    slot_rows: int = DEFAULTS.slot_rows,
    slotted: bool | None = None,
) -> DataFrame:
    """Upsert sightings into the registry, in sequence order.

    The result equals applying the updates one by one: a hash keeps its status and error when
    it is seen again, a place that now holds another hash drops the old row, and a worker
    keeps a recorded filename while an upload replaces it. Rows no update touches pass
    through without a shuffle of their own when the updates are few.
    """
    states = seen_states(registry, updates, slot_rows, slotted)
    untouched = _touched(registry, updates).filter(~F.col("_touched"))
    return untouched.select(*REGISTRY.fieldNames()).unionByName(surviving(states))


def retired_rows(
    registry: DataFrame,
    updates: DataFrame,
    slot_rows: int = DEFAULTS.slot_rows,
    slotted: bool | None = None,
) -> DataFrame:
    """Hashes that lose their row to the updates, or got none."""
    return retired(seen_states(registry, updates, slot_rows, slotted))


def apply_outcomes(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply status changes, in sequence order, to the rows of the registry.

    `outcomes` has seq, sha256, action, error, text_s3_key, extractor_version, at. The action
    `extracted` records the text and keeps an old error, `indexed` clears the error, and any
    other action is a status that replaces the error. Changes of one hash fold into one row
    before they meet the registry.
    """
    action, seq = F.col("action"), F.col("seq")
    extracted, indexed = action == "extracted", action == "indexed"

    def latest(value: Column, where: Column) -> Column:
        return F.max_by(F.when(where, value), F.when(where, seq))

    found = F.struct("text_s3_key", "extractor_version", F.col("at").alias("extracted_at"))
    fault = F.struct(F.when(~indexed, F.col("error")).alias("error"))
    folded = outcomes.groupBy("sha256").agg(
        F.max_by(action, seq).alias("_status"),
        latest(found, extracted).alias("_found"),
        latest(F.struct("at"), indexed).alias("_indexed"),
        latest(fault, ~extracted).alias("_fault"),
    )

    def replaced(marker: str, field: str, column: str) -> Column:
        return (
            F.when(F.col(marker).isNotNull(), F.col(marker)[field])
            .otherwise(F.col(column))
            .alias(column)
        )

    changed = {
        "text_s3_key": replaced("_found", "text_s3_key", "text_s3_key"),
        "extractor_version": replaced("_found", "extractor_version", "extractor_version"),
        "extracted_at": replaced("_found", "extracted_at", "extracted_at"),
        "indexed_at": replaced("_indexed", "at", "indexed_at"),
        "error": replaced("_fault", "error", "error"),
        "status": F.coalesce("_status", "status").alias("status"),
    }
    joined = registry.join(folded, "sha256", "left")
    return joined.select(*[changed.get(c, F.col(c)) for c in REGISTRY.fieldNames()])


def lookup(registry: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Registry rows for a frame of keys (hashes, or buckets and keys)."""
    return registry.join(wanted.select(*on).distinct(), on, "left_semi")


def count_by_status(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def list_by_status(registry: DataFrame, status: str) -> DataFrame:
    return registry.filter(F.col("status") == status).orderBy("seen_at", "sha256")
