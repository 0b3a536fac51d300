"""Progress of a deletion campaign: one row per setting and the totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def status_bucket(status: Column) -> Column:
    name = F.lower(F.trim(status))
    return (
        F.when(name.isin("completed", "completed_legacy"), "completed")
        .when(name.isin("running", "failed", "interrupted"), name)
        .otherwise("not_started")
    )


def last_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest event per setting; equal timestamps are settled by the event's own content."""
    payload = F.struct(*[c for c in events.columns if c not in keys])
    return events.groupBy(*keys).agg(F.max(F.struct("timestamp_utc", payload.alias("payload"))).alias("_e")).select(
        *keys, F.col("_e.timestamp_utc").alias("last_event_utc"), F.col("_e.payload.event").alias("last_event")
    )


def setting_status(
    settings: DataFrame, subject_counts: DataFrame, documents: DataFrame, events: DataFrame, n_ks: int, finished: DataFrame | None = None
) -> DataFrame:
    """Status per expected setting: progress document first, else stored rows, else not started.

    All inputs are keyed by (model, language, roi_family, block, state); ``finished`` carries rows_written.
    """
    keys = ["model", "language", "roi_family", "block", "state"]
    rows = settings.select(*keys).distinct().join(subject_counts, "language", "left")
    docs = documents.select(
        *keys, "status", "subject_ids_total", F.size("completed_subject_ids").alias("_done"), "rows_written", "resume_count",
        "current_subject_id", "updated_utc",
    )
    rows = rows.join(docs, keys, "left").join(last_events(events, keys), keys, "left")
    if finished is None:
        rows = rows.withColumn("_stored", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(finished.select(*keys, F.col("rows_written").alias("_stored")), keys, "left")
    legacy = F.when(F.col("_stored").isNotNull(), "completed_legacy").otherwise("not_started")
    total = F.coalesce("subject_ids_total", "n_subjects", F.lit(0)).cast("bigint")
    written = F.coalesce("rows_written", "_stored", F.lit(0)).cast("bigint")
    done = F.coalesce("_done", F.lit(0)).cast("bigint")
    slots = total * n_ks
    return rows.select(
        *keys,
        F.coalesce("status", legacy).alias("status"),
        status_bucket(F.coalesce("status", legacy)).alias("status_bucket"),
        total.alias("subject_ids_total"), done.alias("completed_subjects"), F.greatest(F.lit(0).cast("bigint"), total - done).alias("pending_subjects"),
        written.alias("rows_written"), slots.alias("expected_k_slots"),
        F.coalesce(F.try_divide(written, slots), F.lit(0.0)).alias("progress_ratio"),
        F.coalesce("resume_count", F.lit(0)).cast("bigint").alias("resume_count"),
        "current_subject_id", F.coalesce("updated_utc", "last_event_utc").alias("last_updated_utc"), "last_event", "last_event_utc",
    )


BUCKETS = ("completed", "running", "interrupted", "failed", "not_started")


def campaign_totals(status: DataFrame) -> DataFrame:
    """One row: settings per bucket, sums, guarded ratios and the newest event."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    rows = status.agg(
        F.count(F.lit(1)).alias("settings_total"),
        *[F.count(F.when(F.col("status_bucket") == b, 1)).alias(f"settings_{b}") for b in BUCKETS],
        total("rows_written").alias("rows_written_total"),
        total("expected_k_slots").alias("expected_k_slots_total"),
        total("completed_subjects").alias("completed_subjects_total"),
        total("subject_ids_total").alias("subject_ids_total"),
        F.max(F.struct("last_event_utc", "last_event")).alias("_last"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.select(
        "*",
        ratio("rows_written_total", "expected_k_slots_total").alias("rows_progress_ratio"),
        ratio("completed_subjects_total", "subject_ids_total").alias("subject_progress_ratio"),
        F.col("_last.last_event_utc").alias("last_event_utc"), F.col("_last.last_event").alias("last_event"),
    ).drop("_last")


def next_settings(status: DataFrame, n: int = 5) -> DataFrame:
    """The next ``n`` settings that have not started."""
    return status.where("status_bucket = 'not_started'").orderBy("model", "language", "roi_family", "block", "state").limit(n)
