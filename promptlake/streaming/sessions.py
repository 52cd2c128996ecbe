"""Structured Streaming forms of the keyed state: running cell sums, prompt counts, session windows, duplicates in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import CELL


def running_cells(requests: DataFrame) -> DataFrame:
    """Sums of quality and counts by cell, for update or complete output; contributions commute, so batch and stream agree."""
    return requests.groupBy(*CELL).agg(F.sum("quality").alias("quality_sum"), F.count("*").alias("n_samples"))


def prompt_frequency(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("prompt_key").agg(F.count("*").alias("uses"))


def session_windows(prompts: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Prompts of a user less than ``gap`` apart form a session; sessions close once the watermark has passed them."""
    return prompts.withWatermark("created_at", late).groupBy("user_id", F.session_window("created_at", gap)).agg(F.count("*").alias("prompts"))


def first_in_an_hour(prompts: DataFrame, late: str = "1 hour") -> DataFrame:
    """A prompt is let through once within the time a cache would keep it."""
    return prompts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["prompt_key"])
