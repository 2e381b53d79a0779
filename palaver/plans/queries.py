"""The registered queries. Each reads whole tables below ``sf_dir``.

Windows and limits are larger than the operators' defaults because the given events are sparse in time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.functions.ids import resolve_user_id, resolve_user_name
from palaver.functions.scope import parse_scope_key, parse_scope_key_leniently, scope_key
from palaver.functions.text import preview_bytes, preview_characters
from palaver.operators import abuse, admission, analytics, buckets, content, decode, delivery, history, logs, presence
from palaver.plans import views
from palaver.plans.views import plain
from palaver.session import shared_folder
from palaver.sources import sinks
from palaver.plans.streams import STREAM_QUERIES

HOUR, DAY = 3600, 86_400
ALERTS = {"warning": 4, "throttle": 6, "flag": 8}
PRESENCE_CUT = "2024-01-20 12:00:00"
STORED_BEFORE = "2024-01-16"
SCOPE = ("Channel", "view-3")
FROM, TO = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
BUCKET_ROWS = 20
NOW = "2026-01-15 10:31:05"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- analytics and abuse


@query
def scope_analytics(spark, sf_dir):
    return plain(analytics.scope_analytics(views.chat_events(spark, sf_dir), HOUR))


@query
def scope_analytics_sliding(spark, sf_dir):
    return plain(analytics.scope_analytics(views.chat_events(spark, sf_dir), 6 * HOUR, HOUR))


@query
def scope_analytics_by_tenant(spark, sf_dir):
    rows = views.chat_events(spark, sf_dir).withColumnRenamed("origin_pod_id", "tenant")
    return plain(analytics.scope_analytics(rows, DAY, extra_keys=("tenant",)).drop("analytics_id"))


@query
def dialogue_analytics(spark, sf_dir):
    return plain(analytics.scope_analytics(views.dialogue(spark, sf_dir)).drop("analytics_id"))


@query
def scope_analytics_approx(spark, sf_dir):
    """Whether the estimated sender count of each window is within a tenth of the exact one."""
    rows = views.chat_events(spark, sf_dir)
    keys = ["scope_type", "scope_id", "window_start"]
    exact = analytics.scope_analytics(rows, DAY).select(*keys, F.col("active_user_count").alias("exact"))
    off = F.abs(F.col("active_user_count") - F.col("exact"))
    found = analytics.scope_analytics_approx(rows, DAY).join(exact, keys)
    return plain(found.select(*keys, "message_count", "total_character_count",
                              (off <= F.greatest(F.lit(1.0), 0.1 * F.col("exact"))).alias("within_bound")))


@query
def scope_counts(spark, sf_dir):
    return plain(analytics.scope_counts(views.chat_events(spark, sf_dir), HOUR))


@query
def analytics_records(spark, sf_dir):
    rows = analytics.scope_analytics(views.chat_events(spark, sf_dir), DAY)
    return sinks.analytics_records(rows, F.lit(NOW).cast("timestamp"))


def _rates(spark, sf_dir):
    return abuse.user_rate(views.chat_events(spark, sf_dir), DAY, 6 * HOUR)


def _alerts(spark, sf_dir, **options):
    return abuse.detect_alerts(views.chat_events(spark, sf_dir), DAY, 6 * HOUR, **ALERTS, **options)


@query
def user_rate(spark, sf_dir):
    return plain(_rates(spark, sf_dir))


@query
def user_rate_by_tenant(spark, sf_dir):
    rows = views.chat_events(spark, sf_dir).withColumnRenamed("origin_pod_id", "tenant")
    return plain(abuse.user_rate(rows, DAY, 6 * HOUR, extra_keys=("tenant",)))


@query
def user_rate_scopes(spark, sf_dir):
    return plain(abuse.user_rate_scopes(views.chat_events(spark, sf_dir), DAY, 6 * HOUR))


@query
def rate_alerts(spark, sf_dir):
    return plain(_alerts(spark, sf_dir))


@query
def rate_alerts_of_rates(spark, sf_dir):
    return plain(abuse.rate_alerts(_rates(spark, sf_dir), **ALERTS))


@query
def rate_alerts_highest(spark, sf_dir):
    return plain(_alerts(spark, sf_dir, highest_only=True).drop("rate_limit_event_id"))


@query
def first_alerts(spark, sf_dir):
    return plain(abuse.first_alerts(_alerts(spark, sf_dir), 6 * HOUR).drop("rate_limit_event_id"))


@query
def rate_alerts_by_policy(spark, sf_dir):
    """Users who ever signed up have thresholds of their own."""
    policies = (
        views.presence_events(spark, sf_dir).filter(F.col("kind") == "online").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("signups"))
        .select("user_id", (F.col("signups") % 3 + 3).alias("warning"), (F.col("signups") % 3 + 5).alias("throttle"),
                (F.col("signups") % 3 + 7).alias("flag"))
    )
    return plain(_alerts(spark, sf_dir, policies=policies).drop("rate_limit_event_id"))


@query
def rate_alerts_as_of(spark, sf_dir):
    """Each sign-up of a user begins a new version of the user's thresholds."""
    rates = _rates(spark, sf_dir)
    return plain(abuse.rate_alerts_as_of(rates, views.policy_versions(views.events(spark, sf_dir)), **ALERTS).drop("rate_limit_event_id"))


@query
def rate_alerts_by_tenant(spark, sf_dir):
    """Alerts per tenant and user; as many ids as alerts."""
    rows = views.chat_events(spark, sf_dir).withColumnRenamed("origin_pod_id", "tenant")
    rates = abuse.user_rate(rows, DAY, 6 * HOUR, extra_keys=("tenant",))
    return plain(abuse.rate_alerts(rates, **ALERTS, extra_keys=("tenant",)))


@query
def rate_limit_records(spark, sf_dir):
    """The records, their JSON read back into fields."""
    records = sinks.rate_limit_records(_alerts(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    fields = F.from_json("value", """rateLimitEventId string, eventType string, userId string, scopeType string,
        scopeId string, windowStartUtc string, windowEndUtc string, windowDurationSeconds long, messageCount long,
        threshold long, excessCount long, messagesPerSecond double, detectedAtUtc string, detectorTaskId string,
        context string""")
    return records.select("key", fields.alias("record")).select("key", "record.*")


# --- decoding


@query
def decode_events(spark, sf_dir):
    return plain(decode.decode_events(views.wire(spark, sf_dir)))


@query
def classify_payload(spark, sf_dir):
    return decode.classify_payload(views.wire(spark, sf_dir)).select("partition", "offset", "status", "reason")


@query
def quarantine(spark, sf_dir):
    return decode.quarantine(views.wire(spark, sf_dir))


@query
def publish_events(spark, sf_dir):
    return decode.encode_events(views.chat_events(spark, sf_dir))


@query
def payload_preview(spark, sf_dir):
    payload = F.col("text").cast("binary")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", preview_bytes(payload).alias("by_bytes"), preview_characters(payload).alias("by_characters")
    )


# --- scope keys and users


def _keys(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", F.concat(F.lit("Channel"), user))
        .when(kind == "click", F.concat(F.lit("Group:"), user))
        .when(kind == "error", F.when(user % 2 == 0, F.lit("Channel:")).otherwise(F.lit(":general")))
        .when(kind == "signup", F.concat(F.lit("Channel:a:"), user))
        .otherwise(scope_key(F.lit("DirectMessage"), F.concat(F.lit("conv-"), user))).alias("scope_key"),
    )


@query
def scope_key_roundtrip(spark, sf_dir):
    parsed, lenient = parse_scope_key(F.col("scope_key")), parse_scope_key_leniently(F.col("scope_key"))
    return _keys(spark, sf_dir).select(
        "event_id", "scope_key", parsed["scope_type"].alias("scope_type"), parsed["scope_id"].alias("scope_id"),
        parsed["error"].alias("error"), lenient["scope_type"].alias("lenient_type"),
        lenient["scope_id"].alias("lenient_id"),
    )


@query
def resolve_users(spark, sf_dir):
    kind = F.col("event_type")
    user = F.concat(F.lit("user-"), F.col("user_id"))
    connection = F.concat(F.lit("conn-"), F.col("event_id"))
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        resolve_user_id(F.when(kind == "purchase", user), F.when(kind == "signup", user), connection).alias("user"),
        resolve_user_name(F.when(kind == "purchase", user)).alias("user_name"),
    )


# --- admission


@query
def validate_message(spark, sf_dir):
    return admission.validate_message(views.requests(spark, sf_dir)).select(
        "message_id", "request_problem", "pod_problem"
    )


@query
def persistable(spark, sf_dir):
    return admission.persistable(views.requests(spark, sf_dir)).select("message_id", "sender_id")


@query
def admission_outcome(spark, sf_dir):
    return admission.admit(views.requests(spark, sf_dir), 12, 60).select("message_id", "code", "problem")


@query
def admission_outcome_rolling(spark, sf_dir):
    found = admission.admit(views.requests(spark, sf_dir), 12, 60, gate=admission.gate_rolling)
    return found.select("message_id", "code", "problem")


@query
def gate_fixed(spark, sf_dir):
    return admission.gate_fixed(views.chat_events(spark, sf_dir), 3, DAY).select("message_id", "sender_id", "allowed")


@query
def gate_rolling(spark, sf_dir):
    calls = views.chat_events(spark, sf_dir).select("message_id", "sender_id", "created_at")
    return admission.gate_rolling(calls, 3, DAY).select("message_id", "sender_id", "allowed")


# --- history


def _history(spark, sf_dir):
    return history.to_history(views.consumed(spark, sf_dir))


@query
def append_history(spark, sf_dir):
    """What an at-least-once replay adds to a history that already holds the first half of the month."""
    incoming = history.to_history(views.redelivered(spark, sf_dir))
    stored = _history(spark, sf_dir).filter(F.col("created_at") < F.lit(STORED_BEFORE).cast("timestamp"))
    return plain(history.rows_to_append(incoming, stored))


@query
def append_history_table(spark, sf_dir):
    """A table below the shared folder that got the same replay twice, read back."""
    path = shared_folder(spark, "history")
    incoming = history.to_history(views.redelivered(spark, sf_dir))
    early = incoming.filter(F.col("created_at") < F.lit(STORED_BEFORE).cast("timestamp"))
    for batch in (early, incoming, incoming):
        history.append_history(batch, path)
    return plain(history.read_history(spark, path).drop("day"))


@query
def delete_history_table(spark, sf_dir):
    """A table below the shared folder from which old messages were deleted, first all, then those of one scope."""
    path = shared_folder(spark, "history")
    history.write_history(history.to_history(views.chat_events(spark, sf_dir)), path)
    history.delete_before(spark, path, "2024-01-11 07:30:00")
    history.delete_before(spark, path, "2024-01-20 18:00:00", "Channel:view-3")
    return plain(history.read_history(spark, path).drop("day", "broker_partition", "broker_offset"))


@query
def distinct_messages(spark, sf_dir):
    return plain(history.distinct_messages(views.redelivered(spark, sf_dir)).drop("partition", "offset"))


@query
def history_all(spark, sf_dir):
    return plain(history.history(_history(spark, sf_dir), *SCOPE, limit=25))


@query
def history_from(spark, sf_dir):
    return plain(history.history(_history(spark, sf_dir), *SCOPE, from_time=FROM, limit=25))


@query
def history_to(spark, sf_dir):
    return plain(history.history(_history(spark, sf_dir), *SCOPE, to_time=TO, limit=25))


@query
def history_range(spark, sf_dir):
    return plain(history.history(_history(spark, sf_dir), *SCOPE, from_time=FROM, to_time=TO, limit=25))


@query
def history_events(spark, sf_dir):
    return plain(history.from_history(_history(spark, sf_dir)))


@query
def next_page(spark, sf_dir):
    return plain(history.next_page(_history(spark, sf_dir), *SCOPE, after=(FROM, "0"), limit=25))


@query
def browse(spark, sf_dir):
    """How many of any ten rows are history rows: all."""
    keys = list(history.KEY)
    rows = _history(spark, sf_dir)
    return history.browse(rows, 10).join(rows.select(*keys), keys, "left_semi").agg(F.count(F.lit(1)).alias("found"))


@query
def latest_per_scope(spark, sf_dir):
    return plain(history.latest_per_scope(_history(spark, sf_dir), 3))


@query
def scope_sizes(spark, sf_dir):
    return history.scope_sizes(_history(spark, sf_dir), wide_rows=70)


@query
def scope_size_distribution(spark, sf_dir):
    return history.scope_size_distribution(_history(spark, sf_dir), wide_rows=70)


@query
def time_bucket_sizes(spark, sf_dir):
    return plain(history.time_bucket_sizes(_history(spark, sf_dir)))


@query
def bucket_widths(spark, sf_dir):
    return buckets.bucket_widths(_history(spark, sf_dir), BUCKET_ROWS)


@query
def bucketed_history_table(spark, sf_dir):
    """A bucketed table below the shared folder after two writes, replays of both, and compaction, read back."""
    path = shared_folder(spark, "buckets")
    incoming = history.to_history(views.redelivered(spark, sf_dir))
    early = incoming.filter(F.col("created_at") < F.lit(STORED_BEFORE).cast("timestamp"))
    for batch, write in ((early, "early"), (incoming, "all"), (early, "early"), (incoming, "again")):
        buckets.append_buckets(batch, path, write, BUCKET_ROWS)
    buckets.compact_buckets(spark, path, "compact", BUCKET_ROWS)
    return plain(buckets.read_buckets(spark, path).drop("bucket_seconds", "bucket_start"))


def _bucketed(spark, sf_dir):
    path = shared_folder(spark, "buckets")
    buckets.append_buckets(_history(spark, sf_dir), path, "all", BUCKET_ROWS)
    return path


@query
def bucketed_history_range(spark, sf_dir):
    return plain(buckets.find_history(spark, _bucketed(spark, sf_dir), *SCOPE, from_time=FROM, to_time=TO, limit=25))


@query
def bucketed_next_page(spark, sf_dir):
    return plain(buckets.find_history(spark, _bucketed(spark, sf_dir), *SCOPE, after=(FROM, "0"), limit=25))


@query
def retention_by_scope(spark, sf_dir):
    return plain(history.retained(_history(spark, sf_dir), TO, scope=":".join(SCOPE)).select("scope_key", "created_at",
                                                                                              "message_id"))


@query
def retention_by_age(spark, sf_dir):
    rows = history.retained_by_age(_history(spark, sf_dir), "2024-01-31 00:00:00", 14 * DAY)
    return plain(rows.select("scope_key", "created_at", "message_id"))


@query
def by_message_id(spark, sf_dir):
    return plain(history.by_message_id(_history(spark, sf_dir)))


@query
def pending(spark, sf_dir):
    """Event types and days as input batches; those before the middle of the month are in the ledger."""
    items = views.events(spark, sf_dir).select(
        F.col("event_type").alias("module_name"), F.date_format("ts", "yyyy-MM-dd").alias("migration_id")
    ).distinct()
    return history.pending(items, items.filter(F.col("migration_id") < STORED_BEFORE))


# --- delivery


def _pairs(spark, sf_dir):
    return delivery.fan_out(views.chat_events(spark, sf_dir), views.memberships(spark, sf_dir)).select(
        "message_id", "scope_type", "scope_id", "user_id"
    )


@query
def fan_out(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def fan_out_by_scope_id(spark, sf_dir):
    pairs = delivery.fan_out(
        views.chat_events(spark, sf_dir), views.memberships(spark, sf_dir), by_scope_id_only=True
    )
    return pairs.groupBy("message_id").agg(F.count(F.lit(1)).alias("recipients"))


@query
def fan_out_counts(spark, sf_dir):
    return delivery.fan_out_counts(views.chat_events(spark, sf_dir), views.memberships(spark, sf_dir))


def _live(spark, sf_dir):
    return presence.presence_state(views.presence_events(spark, sf_dir), PRESENCE_CUT, DAY)


@query
def route_to_pods(spark, sf_dir):
    found = delivery.deliver_to_pods(
        views.chat_events(spark, sf_dir), views.memberships(spark, sf_dir), _live(spark, sf_dir))
    return found.select("message_id", "user_id", "pod_id", "connection_id")


@query
def route_given_pairs(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select("message_id", "user_id")
    return delivery.route_to_pods(pairs, _live(spark, sf_dir))


@query
def undelivered(spark, sf_dir):
    found = delivery.missed_by(views.chat_events(spark, sf_dir), views.memberships(spark, sf_dir), _live(spark, sf_dir))
    return found.select("message_id", "user_id")


@query
def assign_offsets(spark, sf_dir):
    return delivery.assign_offsets(views.chat_events(spark, sf_dir)).select(
        "message_id", "scope_id", "partition", "offset"
    )


@query
def partition_counts(spark, sf_dir):
    return delivery.partition_counts(delivery.assign_offsets(views.chat_events(spark, sf_dir)))


@query
def ordering_audit(spark, sf_dir):
    """Messages reach the broker ``value`` minutes after they were written, so some overtake others."""
    delay = F.make_dt_interval(mins=F.col("value").cast("int"))
    sent = views.as_chat_events(views.events(spark, sf_dir), (F.col("ts") + delay).alias("arrived_at"))
    return delivery.ordering_audit(delivery.assign_offsets(sent, arrival="arrived_at"))


# --- presence


@query
def presence_state(spark, sf_dir):
    return plain(_live(spark, sf_dir))


@query
def presence_state_by_connection(spark, sf_dir):
    rows = views.presence_events(spark, sf_dir)
    return plain(presence.presence_state(rows, PRESENCE_CUT, DAY, expiry="connection"))


@query
def connection_counts(spark, sf_dir):
    return presence.connection_counts(views.presence_events(spark, sf_dir), PRESENCE_CUT, DAY)


@query
def connections(spark, sf_dir):
    return presence.connections(_live(spark, sf_dir))


@query
def online_intervals(spark, sf_dir):
    return plain(presence.online_intervals(views.presence_events(spark, sf_dir), 6 * HOUR))


# --- logs


def _classified(spark, sf_dir):
    return logs.classify_log(views.logs(spark, sf_dir))


@query
def classify_log(spark, sf_dir):
    return _classified(spark, sf_dir).select("line_id", "pod_id", "app_name", "log_type")


@query
def route_logs(spark, sf_dir):
    kept = logs.route_logs(logs.drop_duplicated_logs(_classified(spark, sf_dir)))
    return kept.groupBy("index_name", "log_type").agg(F.count(F.lit(1)).alias("lines"))


@query
def search_logs(spark, sf_dir):
    found = logs.search_logs(views.logs(spark, sf_dir), level="Error", pod="pod-1", message_contains="CONNECTION")
    return plain(found.select("line_id", "ts", "message"))


@query
def search_logs_by_scope(spark, sf_dir):
    found = logs.search_logs(views.logs(spark, sf_dir), level="Information", scope="view-3")
    return plain(found.select("line_id", "ts", "message"))


@query
def recent_logs(spark, sf_dir):
    return plain(logs.recent_logs(views.logs(spark, sf_dir)).select("line_id", "ts", "level", "message"))


@query
def log_levels(spark, sf_dir):
    return logs.log_levels(views.logs(spark, sf_dir), split=("machine_name",))


@query
def log_levels_by_series(spark, sf_dir):
    return logs.log_levels_by_series(views.logs(spark, sf_dir), "machine_name", ["pod-0", "pod-1", "pod-2"])


@query
def latency_summary(spark, sf_dir):
    found = logs.latency_summary(views.logs(spark, sf_dir), "latency_ms", ("machine_name",))
    return found.select("machine_name", "alert", *[F.round(name, 6).alias(name) for name in ("p50", "p95", "p99")])


@query
def latency_summary_approx(spark, sf_dir):
    """Whether each estimate lies between the exact values one percent of the rows below and above its rank."""
    rows = views.logs(spark, sf_dir)
    near = {"low50": 0.49, "high50": 0.51, "low95": 0.94, "high95": 0.96, "low99": 0.98, "high99": 1.0}
    exact = rows.groupBy("machine_name").agg(*[F.percentile("latency_ms", p).alias(name) for name, p in near.items()])
    found = logs.latency_summary(rows, "latency_ms", ("machine_name",), approximate=True).join(exact, "machine_name")
    return found.select("machine_name", *[
        F.col(f"p{p}").between(F.col(f"low{p}"), F.col(f"high{p}")).alias(f"p{p}_within_bound") for p in (50, 95, 99)])


@query
def clean_correlation_ids(spark, sf_dir):
    return logs.clean_correlation_ids(views.logs(spark, sf_dir), "line_id").select("line_id", "correlation_id")


@query
def exception_statuses(spark, sf_dir):
    errors = views.logs(spark, sf_dir).filter(F.col("exception").isNotNull()).select("line_id", "exception")
    return logs.exception_statuses(errors)


@query
def transient_errors(spark, sf_dir):
    errors = views.logs(spark, sf_dir).filter(F.col("exception").isNotNull())
    return logs.transient_errors(errors).select("line_id", "exception", "is_transient")


# --- content


@query
def word_frequency(spark, sf_dir):
    return plain(content.word_frequency(views.documents_as_messages(spark, sf_dir), 7 * DAY))


@query
def emoji_counts(spark, sf_dir):
    return plain(content.emoji_counts(views.chat_events(spark, sf_dir), DAY))


QUERIES.update(STREAM_QUERIES)
