"""Document ingest, registry and full-text search as Spark jobs."""

from foliary.operators.analyze import analyze, postings
from foliary.operators.corpus import rebuild
from foliary.operators.extract import builtin_extractor, python_extractor
from foliary.operators.highlight import highlights
from foliary.operators.reconcile import index_audit, reconcile, sweep_summary
from foliary.operators.registry import apply_outcomes, apply_seen, retired_rows
from foliary.plans.ingest import batch_ingest, ingest
from foliary.plans.search import (
    current_index,
    extend_index,
    open_index,
    rebuild_index,
    search,
    search_hits,
    search_totals,
    upsert_index,
    write_index,
)
from foliary.settings import Settings
from foliary.streaming.jobs import Store, ingest_batch, stream_ingest, stream_sweeps

__all__ = [
    "Settings",
    "Store",
    "analyze",
    "apply_outcomes",
    "apply_seen",
    "batch_ingest",
    "builtin_extractor",
    "current_index",
    "extend_index",
    "highlights",
    "index_audit",
    "ingest",
    "ingest_batch",
    "open_index",
    "postings",
    "python_extractor",
    "rebuild",
    "rebuild_index",
    "reconcile",
    "retired_rows",
    "search",
    "search_hits",
    "search_totals",
    "stream_ingest",
    "stream_sweeps",
    "sweep_summary",
    "upsert_index",
    "write_index",
]
