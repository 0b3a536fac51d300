"""Follow the append-only progress log of a campaign with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.plans.status import last_events
from voxelweave.schemas import PROGRESS_EVENT

SETTING = ["model", "target_language", "roi_family", "block", "state"]


def follow_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PROGRESS_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_per_setting(events: DataFrame) -> DataFrame:
    """Last event per setting. State is one row per setting, however long the log gets."""
    return last_events(events, SETTING)
