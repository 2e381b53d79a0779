"""Activity per scope in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions.ids import stable_uuid
from palaver.functions.text import utf16_length
from palaver.functions.times import seconds_text

COMPUTE_TASK_ID = "palaver-analytics"

_SCOPE = ("scope_type", "scope_id")


def check_window(size_seconds: int, slide_seconds: int | None = None) -> None:
    if size_seconds <= 0 or (slide_seconds is not None and slide_seconds <= 0):
        raise ValueError("window size and slide must be positive")
    if slide_seconds is not None and (slide_seconds > size_seconds or size_seconds % slide_seconds):
        raise ValueError("the slide must divide the window size")


def _merged() -> list[Column]:
    return [
        F.sum("messages").alias("messages"),
        F.sum("characters").alias("characters"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ]


def scope_analytics(
    events: DataFrame,
    window_seconds: int = 60,
    slide_seconds: int | None = None,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """Message, sender and character counts per scope and window.

    Rows are first merged per (window, scope, sender), then per (window, scope), so the distinct sender count
    needs no set of senders, neither in a task nor in a stream's state. Sliding windows merge per slide first
    and expand the merged rows. Works on batch frames and on watermarked streams in append mode.
    ``extra_keys`` (a tenant, say) are further grouping columns.
    """
    check_window(window_seconds, slide_seconds)
    keys = [*extra_keys, *_SCOPE]
    step = slide_seconds or window_seconds
    per_sender = events.groupBy(F.window("created_at", seconds_text(step)).alias("window"), *keys, "sender_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(utf16_length(F.col("text"))).alias("characters"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )
    if slide_seconds and slide_seconds != window_seconds:
        per_sender = (
            per_sender.withColumn("pane_time", F.window_time("window")).drop("window")
            .groupBy(F.window("pane_time", seconds_text(window_seconds), seconds_text(slide_seconds)).alias("window"),
                     *keys, "sender_id")
            .agg(*_merged())
        )
    per_scope = per_sender.groupBy("window", *keys).agg(F.count(F.lit(1)).alias("senders"), *_merged())
    return per_scope.select(
        stable_uuid(F.lit("analytics"), *[F.col(key) for key in keys], F.unix_micros("window.start"),
                    F.lit(window_seconds)).alias("analytics_id"),
        *keys,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.lit(window_seconds).cast("long").alias("window_duration_seconds"),
        F.col("messages").alias("message_count"),
        F.col("senders").alias("active_user_count"),
        F.col("senders").alias("unique_sender_count"),
        F.col("characters").cast("long").alias("total_character_count"),
        (F.col("characters").cast("double") / F.col("messages")).alias("average_message_length"),
        F.col("first_at").alias("first_event_at"),
        F.col("last_at").alias("last_event_at"),
        F.lit(COMPUTE_TASK_ID).alias("compute_task_id"),
    )


def scope_analytics_approx(events: DataFrame, window_seconds: int = 60, rsd: float = 0.02) -> DataFrame:
    """As ``scope_analytics`` in one shuffle, with an estimated sender count of bounded size."""
    check_window(window_seconds)
    return (
        events.groupBy(F.window("created_at", seconds_text(window_seconds)).alias("window"), *_SCOPE)
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.approx_count_distinct("sender_id", rsd).alias("active_user_count"),
            F.sum(utf16_length(F.col("text"))).cast("long").alias("total_character_count"),
        )
        .select(*_SCOPE, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "message_count", "active_user_count", "total_character_count")
    )


def scope_counts(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Messages per scope and window."""
    check_window(window_seconds)
    return (
        events.groupBy(F.window("created_at", seconds_text(window_seconds)).alias("window"), *_SCOPE)
        .agg(F.count(F.lit(1)).alias("message_count"))
        .select(*_SCOPE, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "message_count")
    )
