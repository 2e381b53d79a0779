"""Senders who write too much: sliding counts and graded alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions.ids import stable_uuid
from palaver.functions.scope import parse_scope_key_leniently
from palaver.functions.times import add_seconds, seconds_text
from palaver.operators.analytics import check_window

DETECTOR_TASK_ID = "palaver-abuse"

# Alert levels, highest first, and the text each one carries.
LEVEL_CONTEXT = {
    "Flag": "User exceeded flag threshold",
    "Throttle": "User exceeded throttle threshold",
    "Warning": "User exceeded warning threshold",
}


def check_thresholds(warning: int, throttle: int, flag: int) -> None:
    if not 0 < warning < throttle < flag:
        raise ValueError("thresholds must be positive and rise: warning < throttle < flag")


def _panes(events: DataFrame, slide_seconds: int, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """Events merged per key and slide; ``pane_time`` places a pane in the windows over it."""
    pane = F.window("created_at", seconds_text(slide_seconds))
    return (
        events.groupBy(pane.alias("_pane"), *keys)
        .agg(F.count(F.lit(1)).alias("message_count"), *more)
        .withColumn("pane_time", F.window_time("_pane")).drop("_pane")
    )


def _over_panes(window_seconds: int, slide_seconds: int) -> Column:
    return F.window("pane_time", seconds_text(window_seconds), seconds_text(slide_seconds)).alias("window")


def user_rate(
    events: DataFrame, window_seconds: int = 60, slide_seconds: int = 10, extra_keys: tuple[str, ...] = ()
) -> DataFrame:
    """Messages per sender over all scopes in sliding windows, with the scope of the earliest one.

    The earliest is by (created_at, message_id). Events are merged per slide before they meet the windows, so it is
    the merged rows, not the events, that are repeated for each window. Batch and stream.
    """
    check_window(window_seconds, slide_seconds)
    opening = F.struct("created_at", "message_id", F.concat_ws(":", "scope_type", "scope_id").alias("scope"))
    panes = _panes(events, slide_seconds, (*extra_keys, "sender_id"), F.min("created_at").alias("first_at"),
                   F.max("created_at").alias("last_at"), F.min(opening).alias("opening"))
    return (
        panes.groupBy(_over_panes(window_seconds, slide_seconds), *extra_keys, "sender_id")
        .agg(
            F.sum("message_count").alias("message_count"),
            F.min("first_at").alias("first_event_at"),
            F.max("last_at").alias("last_event_at"),
            F.min("opening").alias("opening"),
        )
        .select(
            *extra_keys,
            F.col("sender_id").alias("user_id"),
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "message_count",
            (F.col("message_count").cast("double") / window_seconds).alias("messages_per_second"),
            F.col("opening.scope").alias("first_scope"),
            "first_event_at",
            "last_event_at",
        )
    )


def user_rate_scopes(events: DataFrame, window_seconds: int = 60, slide_seconds: int = 10) -> DataFrame:
    """The scopes behind ``user_rate``, one row per sender, window and scope."""
    check_window(window_seconds, slide_seconds)
    keys = ("sender_id", "scope_type", "scope_id")
    return (
        _panes(events, slide_seconds, keys).groupBy(_over_panes(window_seconds, slide_seconds), *keys)
        .agg(F.sum("message_count").alias("message_count"))
        .select(F.col("sender_id").alias("user_id"), F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "scope_type", "scope_id", "message_count")
    )


def rate_alerts(
    rates: DataFrame,
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    highest_only: bool = False,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each level a window of ``user_rate`` reaches, or only for the highest level.

    ``extra_keys`` are those of the rates: they stay beside the alert and are part of its id."""
    check_thresholds(warning, throttle, flag)
    thresholds = {"Flag": F.lit(flag), "Throttle": F.lit(throttle), "Warning": F.lit(warning)}
    return _alerts(rates.filter(F.col("message_count") >= warning), thresholds, highest_only, extra_keys)


def rate_alerts_by_policy(
    rates: DataFrame,
    policies: DataFrame,
    key: str = "user_id",
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    highest_only: bool = False,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """``rate_alerts`` with thresholds from ``policies`` (key, warning, throttle, flag), defaults elsewhere.

    ``key`` may be a user or a tenant column of ``rates``. Spark broadcasts ``policies`` only while it is
    below its size threshold and joins by shuffle beyond it.
    """
    check_thresholds(warning, throttle, flag)
    joined, thresholds = _with_policies(rates, policies, key, warning, throttle, flag)
    return _alerts(joined, thresholds, highest_only, extra_keys)


def policy_spans(policies: DataFrame, key: str) -> DataFrame:
    """Versions (key, valid_from, warning, throttle, flag) with the time ``_until`` at which the next one of the key
    begins. Of versions that begin together the one with the highest levels counts."""
    levels = ("warning", "throttle", "flag")
    once = policies.groupBy(key, "valid_from").agg(F.max(F.struct(*levels)).alias("_levels"))
    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return once.select(key, F.col("valid_from").alias("_from"), following.alias("_until"),
                       *[F.col(f"_levels.{name}").alias(f"_{name}") for name in levels])


def rate_alerts_as_of(
    rates: DataFrame,
    policies: DataFrame,
    key: str = "user_id",
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    highest_only: bool = False,
    extra_keys: tuple[str, ...] = (),
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """``rate_alerts`` with thresholds that change over time: each window takes the version of its key's policy that is
    valid at the window's end, defaults before the first. Batch.

    ``policies`` has (key, valid_from, warning, throttle, flag); a null level of a version falls back to the default. The
    last version of each key is joined by the key alone, as there is one. Earlier ones are joined by equality on key and
    time bucket, each repeated for the buckets it is valid in, so a key of many versions meets few of them in a bucket.
    """
    check_thresholds(warning, throttle, flag)
    size = bucket_seconds * 1_000_000
    names = ("_warning", "_throttle", "_flag")
    spans = policy_spans(policies, key)
    last = spans.filter(F.col("_until").isNull()).select(
        key, F.col("_from").alias("_last_from"), *[F.col(name).alias(f"_last{name}") for name in names])
    buckets = F.sequence(F.floor(F.unix_micros("_from") / size), F.floor((F.unix_micros("_until") - 1) / size))
    earlier = spans.filter(F.col("_until").isNotNull()).select(
        F.col(key).alias("_key"), "_from", "_until", *names, F.explode(buckets).alias("_in"))
    valid = (F.col("window_end") >= F.col("_from")) & (F.col("window_end") < F.col("_until"))
    placed = rates.withColumn("_bucket", F.floor(F.unix_micros("window_end") / size)).join(last, key, "left")
    joined = placed.join(earlier, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_in")) & valid, "left")
    in_effect = F.col("window_end") >= F.col("_last_from")
    joined = joined.withColumns({name: F.when(in_effect, F.col(f"_last{name}")).otherwise(F.col(name)) for name in names})
    return alerts_of_levels(joined, warning, throttle, flag, highest_only, extra_keys)


def alerts_of_levels(
    rates: DataFrame, warning: int, throttle: int, flag: int, highest_only: bool = False, extra_keys: tuple[str, ...] = ()
) -> DataFrame:
    """Alerts of rates that carry levels of their own (``_warning``, ``_throttle``, ``_flag``), defaults for nulls."""
    return _alerts(rates, _levels(warning, throttle, flag), highest_only, extra_keys)


def _levels(warning: int, throttle: int, flag: int) -> dict[str, Column]:
    return {
        "Flag": F.coalesce(F.col("_flag"), F.lit(flag)),
        "Throttle": F.coalesce(F.col("_throttle"), F.lit(throttle)),
        "Warning": F.coalesce(F.col("_warning"), F.lit(warning)),
    }


def _with_policies(
    rates: DataFrame, policies: DataFrame, key: str, warning: int, throttle: int, flag: int
) -> tuple[DataFrame, dict[str, Column]]:
    chosen = policies.select(key, *[F.col(name).alias(f"_{name}") for name in ("warning", "throttle", "flag")])
    return rates.join(chosen, key, "left"), _levels(warning, throttle, flag)


def detect_alerts(
    events: DataFrame,
    window_seconds: int = 60,
    slide_seconds: int = 10,
    warning: int = 80,
    throttle: int = 100,
    flag: int = 200,
    policies: DataFrame | None = None,
    highest_only: bool = False,
) -> DataFrame:
    """``rate_alerts`` straight from events. Batch.

    Counts alone are aggregated by hash, and only for the few windows that reach a level is the earliest
    message looked up, by sender and time. ``policies`` are per user.
    """
    check_window(window_seconds, slide_seconds)
    check_thresholds(warning, throttle, flag)
    panes = _panes(events.select("sender_id", "created_at"), slide_seconds, ("sender_id",),
                   F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    rates = (
        panes.select("*", _over_panes(window_seconds, slide_seconds))
        .groupBy(F.col("window.start").alias("window_start"), F.col("sender_id").alias("user_id"))
        .agg(
            F.sum("message_count").alias("message_count"),
            F.min("first_at").alias("first_event_at"),
            F.max("last_at").alias("last_event_at"),
        )
        .withColumn("messages_per_second", F.col("message_count").cast("double") / window_seconds)
    )
    if policies is None:
        thresholds = {"Flag": F.lit(flag), "Throttle": F.lit(throttle), "Warning": F.lit(warning)}
    else:
        rates, thresholds = _with_policies(rates, policies, "user_id", warning, throttle, flag)
    # The levels of a policy need not rise, so any of them may be the lowest.
    lowest = F.least(*thresholds.values())
    reached = rates.filter(F.col("message_count") >= lowest)
    openings = events.select(
        F.col("sender_id").alias("user_id"), F.col("created_at").alias("first_event_at"),
        F.struct("message_id", F.concat_ws(":", "scope_type", "scope_id").alias("scope")).alias("_opening"),
    )
    found = (
        reached.join(openings, ["user_id", "first_event_at"])
        .groupBy(*reached.columns).agg(F.min("_opening").alias("_opening"))
        .select(
            *reached.columns,
            add_seconds(F.col("window_start"), window_seconds).alias("window_end"),
            F.col("_opening.scope").alias("first_scope"),
        )
    )
    return _alerts(found, thresholds, highest_only, ())


def _alerts(
    rates: DataFrame, thresholds: dict[str, Column], highest_only: bool, extra_keys: tuple[str, ...]
) -> DataFrame:
    levels = F.array(*[
        F.struct(F.lit(level).alias("event_type"), limit.cast("long").alias("threshold"),
                 F.lit(LEVEL_CONTEXT[level]).alias("context"))
        for level, limit in thresholds.items()
    ])
    reached = F.filter(levels, lambda level: F.col("message_count") >= level["threshold"])
    if highest_only:
        reached = F.slice(reached, 1, 1)
    scope = parse_scope_key_leniently(F.col("first_scope"))
    # The length of a window is read off the window itself.
    seconds = ((F.unix_micros("window_end") - F.unix_micros("window_start")) / 1_000_000).cast("long")
    return rates.withColumn("level", F.explode(reached)).select(
        stable_uuid(F.lit("rate"), *[F.col(key) for key in extra_keys], F.col("user_id"), F.col("level.event_type"),
                    F.unix_micros("window_start"), seconds).alias("rate_limit_event_id"),
        *extra_keys,
        F.col("level.event_type").alias("event_type"),
        "user_id",
        scope["scope_type"].alias("scope_type"),
        scope["scope_id"].alias("scope_id"),
        "window_start",
        "window_end",
        seconds.alias("window_duration_seconds"),
        "message_count",
        F.col("level.threshold").alias("threshold"),
        (F.col("message_count") - F.col("level.threshold")).alias("excess_count"),
        "messages_per_second",
        "first_event_at",
        "last_event_at",
        F.lit(DETECTOR_TASK_ID).alias("detector_task_id"),
        F.col("level.context").alias("context"),
    )


def first_alerts(alerts: DataFrame, slide_seconds: int = 10, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Only the first alert of each unbroken run of windows per user and level. Batch."""
    runs = Window.partitionBy(*extra_keys, "user_id", "event_type").orderBy("window_start")
    step = F.unix_micros("window_start") - F.unix_micros(F.lag("window_start").over(runs))
    return (
        alerts.withColumn("_step", step)
        .filter(F.col("_step").isNull() | (F.col("_step") > slide_seconds * 1_000_000))
        .drop("_step")
    )
