"""Structured service logs: classify, route, search, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions.errors import is_transient_error, status_of_exception
from palaver.functions.ids import clean_correlation_id
from palaver.functions.text import contains_ignoring_case
from palaver.functions.times import index_day
from palaver.operators.skew import exact_quantiles

# What marks a log line as the application's own.
APP_COMPONENTS = ("api", "consumer", "worker", "frontend")
APP_CONTAINER_PARTS = ("consumer", "worker", "frontend")
SELF_SHIPPING_CONTAINER = "chat-api"
NAME_LABELS = ("app_kubernetes_io/name", "app_kubernetes_io_name", "app.kubernetes.io/name")
COMPONENT_LABELS = ("app_kubernetes_io/component", "app_kubernetes_io_component", "app.kubernetes.io/component")
APP, SYSTEM, DUPLICATE = "app", "system", "duplicate_to_drop"


def _label(names: tuple[str, ...]) -> Column:
    """The first label among the spellings of a name; an empty one counts as absent."""
    return F.coalesce(*[F.nullif(F.try_element_at("labels", F.lit(name)), F.lit("")) for name in names])


def classify_log(logs: DataFrame) -> DataFrame:
    """Adds ``pod_id``, ``app_name`` and ``log_type`` (app, system or duplicate_to_drop)."""
    container = F.coalesce(F.col("container_name"), F.lit(""))
    by_container = reduce(lambda a, b: a | b, [container.contains(part) for part in APP_CONTAINER_PARTS])
    log_type = (
        F.when(_label(COMPONENT_LABELS).isin(*APP_COMPONENTS), APP)
        .when(container.contains(SELF_SHIPPING_CONTAINER), DUPLICATE)
        .when(by_container, APP)
        .otherwise(SYSTEM)
    )
    return logs.withColumns({
        "pod_id": F.nullif(F.col("pod_name"), F.lit("")),
        "app_name": F.coalesce(_label(NAME_LABELS), F.nullif(F.col("container_name"), F.lit(""))),
        "log_type": log_type,
    })


def drop_duplicated_logs(classified: DataFrame) -> DataFrame:
    """Without the lines of containers that ship their logs themselves."""
    return classified.filter(F.col("log_type") != DUPLICATE)


def route_logs(classified: DataFrame, app_prefix: str = "logs-", system_prefix: str = "system-logs-") -> DataFrame:
    """Adds ``day`` and the daily index each line goes to."""
    prefix = F.when(F.col("log_type") == APP, app_prefix).when(F.col("log_type") == SYSTEM, system_prefix)
    return classified.withColumns({"day": F.to_date("ts"), "index_name": F.concat(prefix, index_day(F.col("ts")))})


def search_logs(
    logs: DataFrame,
    level: str | None = None,
    correlation_id: str | None = None,
    pod: str | None = None,
    scope: str | None = None,
    message_contains: str | None = None,
) -> DataFrame:
    """Lines that meet every given condition."""
    found = logs
    if level is not None:
        found = found.filter(F.col("level") == level)
    if correlation_id is not None:
        found = found.filter(F.col("correlation_id") == correlation_id)
    if pod is not None:
        found = found.filter(F.try_element_at("context", F.lit("OriginPodId")) == pod)
    if scope is not None:
        found = found.filter(F.try_element_at("context", F.lit("ScopeId")) == scope)
    if message_contains is not None:
        found = found.filter(contains_ignoring_case(F.col("message"), message_contains))
    return found


def recent_logs(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.orderBy(F.desc("ts"), F.desc("message")).limit(n)


def log_levels(logs: DataFrame, by: tuple[str, ...] = ("level",), split: tuple[str, ...] = ()) -> DataFrame:
    """Lines per level, optionally split into series."""
    return logs.groupBy(*by, *split).agg(F.count(F.lit(1)).alias("lines"))


def log_levels_by_series(logs: DataFrame, split: str, series: list[str]) -> DataFrame:
    """Lines per level with one column per named series."""
    return logs.groupBy("level").pivot(split, series).agg(F.count(F.lit(1))).fillna(0)


def latency_summary(
    measures: DataFrame, value: str, by: tuple[str, ...], alert_above: float = 100.0, approximate: bool = False
) -> DataFrame:
    """Median, p95 and p99 of ``value`` per group, and whether p95 is above the alert level."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approximate:
        found = measures.groupBy(*by).agg(*[F.percentile_approx(value, p).alias(name) for name, p in points.items()])
    else:
        found = exact_quantiles(measures, by, value, points)
    return found.withColumn("alert", F.col("p95") > alert_above)


def clean_correlation_ids(logs: DataFrame, *row_key: str) -> DataFrame:
    return logs.withColumn(
        "correlation_id", clean_correlation_id(F.col("correlation_id"), *[F.col(name) for name in row_key])
    )


def exception_statuses(errors: DataFrame, exception_type: str = "exception") -> DataFrame:
    """Adds status, title, detail, rfc_section, is_server_error and log_level."""
    return errors.withColumn("_status", status_of_exception(F.col(exception_type))).select(
        *errors.columns, "_status.*"
    )


def transient_errors(
    errors: DataFrame, exception_type: str = "exception", message: str = "message", inner: str = "inner_message"
) -> DataFrame:
    """Adds ``is_transient``."""
    return errors.withColumn("is_transient", is_transient_error(F.col(exception_type), F.col(message), F.col(inner)))
