"""Streams over the batch operators: watermarks, deduplication and the running jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from palaver.operators.abuse import alerts_of_levels, check_thresholds, rate_alerts, user_rate
from palaver.operators.analytics import scope_analytics
from palaver.operators.buckets import append_buckets
from palaver.operators.decode import decode_events, quarantine
from palaver.operators.history import append_history, to_history
from palaver.sources.sinks import analytics_records, rate_limit_records
from palaver.streaming.ordered import rates_as_of_stream

LATENESS = "5 seconds"


def with_event_time(events: DataFrame, lateness: str = LATENESS, time: str = "created_at") -> DataFrame:
    """Event time with bounded disorder. Rows older than the watermark are dropped by later operators."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def dedupe_stream(events: DataFrame) -> DataFrame:
    """The first row of each message id; an id is remembered until the watermark passes it."""
    return events.dropDuplicatesWithinWatermark(["message_id"])


def analytics_stream(
    events: DataFrame, window_seconds: int = 60, slide_seconds: int | None = None, lateness: str = LATENESS
) -> DataFrame:
    return scope_analytics(with_event_time(events, lateness), window_seconds, slide_seconds)


def alerts_stream(
    events: DataFrame,
    window_seconds: int = 60,
    slide_seconds: int = 10,
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    lateness: str = LATENESS,
) -> DataFrame:
    check_thresholds(warning, throttle, flag)
    rates = user_rate(with_event_time(events, lateness), window_seconds, slide_seconds)
    return rate_alerts(rates, warning, throttle, flag)


def alerts_as_of_stream(
    events: DataFrame,
    policies: DataFrame,
    window_seconds: int = 60,
    slide_seconds: int = 10,
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    lateness: str = LATENESS,
) -> DataFrame:
    """``alerts_stream`` with thresholds that change while it runs: ``policies``, a stream, has versions per user."""
    check_thresholds(warning, throttle, flag)
    rates = user_rate(with_event_time(events, lateness), window_seconds, slide_seconds)
    return alerts_of_levels(rates_as_of_stream(rates, policies), warning, throttle, flag)


@dataclass(frozen=True)
class JobSettings:
    """What the running jobs can be told: windows and slides in seconds, thresholds, and the allowed lateness."""

    analytics_window: int = 60
    analytics_slide: int | None = None
    rate_window: int = 60
    rate_slide: int = 10
    warning: int = 80
    throttle: int = 100
    flag: int = 200
    lateness: str = LATENESS


def start_chat_jobs(
    payloads: DataFrame, start_sink: Callable[[DataFrame, str], StreamingQuery], settings: JobSettings = JobSettings()
) -> dict[str, StreamingQuery]:
    """The two analytic branches and the quarantine of one payload stream, each its own query.

    ``start_sink(records, name)`` starts a sink (see ``sources.sinks``) with a checkpoint of that name.
    """
    events = decode_events(payloads)
    activity = analytics_stream(events, settings.analytics_window, settings.analytics_slide, settings.lateness)
    alerts = alerts_stream(events, settings.rate_window, settings.rate_slide, settings.warning, settings.throttle,
                           settings.flag, settings.lateness)
    return {
        "analytics": start_sink(analytics_records(activity), "analytics"),
        "rate_limits": start_sink(rate_limit_records(alerts), "rate_limits"),
        "quarantine": start_sink(quarantine(payloads), "quarantine"),
    }


def start_history_writer(
    payloads: DataFrame, path: str, checkpoint: str, rejected: str, every: str | None = None
) -> StreamingQuery:
    """Append the events of a payload stream to the history at ``path``, and what is none to ``rejected``.

    Every payload ends in one of the two: rejected ones with their partition and offset, the reason and a preview, in a
    folder of their micro-batch. A micro-batch is committed once both are stored; a failed one is run again and adds
    nothing twice.
    """
    def store(batch: DataFrame, number: int) -> None:
        payload_rows = batch.persist()
        set_aside = quarantine(payload_rows, for_history=True)
        set_aside.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={number}")
        append_history(to_history(decode_events(payload_rows, for_history=True)), path)
        payload_rows.unpersist()

    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def start_bucket_writer(
    rows: DataFrame, path: str, checkpoint: str, job: str, every: str | None = None, **layout
) -> StreamingQuery:
    """Append a stream of history rows to the bucketed table at ``path``, exactly once.

    A micro-batch is one write, named by the job and its number. The table records it in the moment its rows show, so a
    batch that is run again after that does nothing. ``layout`` goes to ``append_buckets``.
    """
    def store(batch: DataFrame, number: int) -> None:
        append_buckets(batch, path, f"{job}-{number}", **layout)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def late_rows(events: DataFrame, watermark, time: str = "created_at") -> DataFrame:
    """Batch audit: the rows a stream at this watermark would have dropped."""
    return events.filter(F.col(time) <= F.lit(watermark).cast("timestamp"))
