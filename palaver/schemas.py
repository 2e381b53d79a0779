"""Fixed schemas of the records this library reads and writes."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

CHAT_EVENT = _struct(
    ("message_id", _S), ("scope_type", _S), ("scope_id", _S), ("sender_id", _S),
    ("text", _S), ("created_at", _TS), ("origin_pod_id", _S),
)

# Names as they stand in the JSON payload. scopeType and createdAtUtc are text here because
# producers spell the first in three ways and the second needs a tolerant parse.
WIRE_EVENT = _struct(
    ("messageId", _S), ("scopeType", _S), ("scopeId", _S), ("senderId", _S),
    ("text", _S), ("createdAtUtc", _S), ("originPodId", _S),
)

WIRE_RECORD = T.StructType([
    T.StructField("value", T.BinaryType(), True),
    T.StructField("partition", _I, True),
    T.StructField("offset", _L, True),
])

SEND_REQUEST = _struct(
    ("message_id", _S), ("sender_id", _S), ("scope_type", _S), ("scope_id", _S),
    ("text", _S), ("origin_pod_id", _S), ("requested_at", _TS),
)

HISTORY_ROW = _struct(
    ("scope_key", _S), ("created_at", _TS), ("message_id", _S), ("sender_id", _S), ("text", _S),
    ("origin_pod_id", _S), ("broker_partition", _I), ("broker_offset", _L),
)

MEMBERSHIP = _struct(
    ("scope_type", _S), ("scope_id", _S), ("user_id", _S), ("joined_at", _TS), ("left_at", _TS),
)

PRESENCE_EVENT = _struct(
    ("user_id", _S), ("pod_id", _S), ("connection_id", _S), ("kind", _S), ("ts", _TS),
)

LOG_RECORD = _struct(
    ("ts", _TS), ("level", _S), ("message", _S), ("correlation_id", _S),
    ("context", T.MapType(_S, _S)), ("exception", _S), ("machine_name", _S), ("application", _S),
)

SHIPPED_LOG = T.StructType(
    LOG_RECORD.fields
    + _struct(("pod_name", _S), ("container_name", _S), ("labels", T.MapType(_S, _S))).fields
)

ANALYTICS_EVENT = _struct(
    ("analytics_id", _S), ("scope_type", _S), ("scope_id", _S), ("window_start", _TS), ("window_end", _TS),
    ("window_duration_seconds", _L), ("message_count", _L), ("active_user_count", _L),
    ("unique_sender_count", _L), ("total_character_count", _L), ("average_message_length", _D),
    ("first_event_at", _TS), ("last_event_at", _TS), ("compute_task_id", _S),
)

RATE_LIMIT_EVENT = _struct(
    ("rate_limit_event_id", _S), ("event_type", _S), ("user_id", _S), ("scope_type", _S), ("scope_id", _S),
    ("window_start", _TS), ("window_end", _TS), ("window_duration_seconds", _L), ("message_count", _L),
    ("threshold", _L), ("excess_count", _L), ("messages_per_second", _D), ("first_event_at", _TS),
    ("last_event_at", _TS), ("detector_task_id", _S), ("context", _S),
)
