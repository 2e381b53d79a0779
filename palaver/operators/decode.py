"""Payloads to events: decode, classify, set bad ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from palaver.functions.scope import CHANNEL, normalize_scope_type
from palaver.functions.text import is_blank, preview_bytes
from palaver.functions.times import iso_micros
from palaver.schemas import WIRE_EVENT

SUCCESS = "Success"
PERMANENT_FAILURE = "PermanentFailure"

# A date, a time of day and, if given, a fraction and a zone. Anything shorter would be filled up from today's date.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)?$"
_EVENTS = T.ArrayType(WIRE_EVENT)


def _parsed(df: DataFrame, value: str) -> DataFrame:
    """The payload as ``_events``, the list of what it holds. A payload that is no single document does not give one
    event: a second document makes the list longer, any other text makes it null."""
    text = F.concat(F.lit("["), F.col(value).cast("string"), F.lit("]"))
    events = F.from_json(text, _EVENTS, {"allowSingleQuotes": "false"})
    # One-element explode: keeps the optimizer from copying the parse into every filter and column that uses it.
    return df.withColumn("_events", F.explode(F.array(events)))


def _event(name: str) -> Column:
    return F.get(F.col("_events"), F.lit(0))[name]


def _holds_container(value: str) -> Column:
    """Whether an object or a list stands under one of the text fields, which the parse would hand over as text.

    Only a field whose text looks like one is looked at a second time."""
    document = F.try_parse_json(F.col(value).cast("string"))
    tests = F.lit(False)
    for field in WIRE_EVENT.fields:
        kind = F.schema_of_variant(F.try_variant_get(document, f"$.{field.name}", "variant"))
        suspect = F.coalesce(_event(field.name).rlike(r"^[\[{]"), F.lit(False))
        tests = tests | F.when(suspect, F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))).otherwise(F.lit(False))
    return tests


def _reason(value: str) -> Column:
    """Why a payload holds no event; null when it does. The one list of reasons, in order."""
    payload, text = F.col(value), F.col(value).cast("string")
    any_missing = F.lit(False)
    for field in WIRE_EVENT.fields:
        any_missing = any_missing | _event(field.name).isNull()
    created = _event("createdAtUtc")
    return (
        F.when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "empty")
        .when(~F.is_valid_utf8(text), "bad_json")
        .when(F.trim(text) == "null", "null_event")
        .when(F.col("_events").isNull() | (F.size("_events") != 1) | F.get("_events", F.lit(0)).isNull(), "bad_json")
        .when(_holds_container(value), "bad_json")
        .when(any_missing, "missing_field")
        .when(is_blank(_event("scopeId")), "blank_scope")
        .when(normalize_scope_type(_event("scopeType")).isNull(), "bad_scope_type")
        .when(~created.rlike(INSTANT) | F.try_to_timestamp(created).isNull(), "bad_timestamp")
    )


def _storing_reason(value: str) -> Column:
    """``_reason``, and what the history does not store though it is an event."""
    return F.coalesce(_reason(value), F.when(is_blank(_event("senderId")), "blank_sender"),
                      F.when(is_blank(_event("text")), "blank_text"))


def _judged(df: DataFrame, value: str, reason: Column) -> DataFrame:
    return _parsed(df, value).withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), SUCCESS).otherwise(PERMANENT_FAILURE)
    )


def classify_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """The history writer's verdict on each payload: ``status`` and, for failures, the first ``reason``."""
    return _judged(df, value, _storing_reason(value)).drop("_events")


def decode_events(df: DataFrame, value: str = "value", for_history: bool = False) -> DataFrame:
    """The payloads that hold a whole event, as event columns; other columns of ``df`` are kept.

    ``for_history`` leaves out what the history does not store."""
    kept = [name for name in df.columns if name != value]
    judged = _judged(df, value, _storing_reason(value) if for_history else _reason(value))
    return judged.filter(F.col("status") == SUCCESS).select(
        _event("messageId").alias("message_id"),
        normalize_scope_type(_event("scopeType")).alias("scope_type"),
        _event("scopeId").alias("scope_id"),
        _event("senderId").alias("sender_id"),
        _event("text").alias("text"),
        F.try_to_timestamp(_event("createdAtUtc")).alias("created_at"),
        _event("originPodId").alias("origin_pod_id"),
        *kept,
    )


def quarantine(df: DataFrame, value: str = "value", for_history: bool = False) -> DataFrame:
    """The payloads ``decode_events`` leaves out, with the reason and a preview."""
    kept = [name for name in df.columns if name != value]
    judged = _judged(df, value, _storing_reason(value) if for_history else _reason(value))
    return judged.filter(F.col("status") != SUCCESS).select(*kept, "reason", preview_bytes(F.col(value)).alias("preview"))


def event_json(scope_type: Column) -> Column:
    """An event as camelCase JSON, with the given spelling of its scope type."""
    return F.to_json(F.struct(
        F.col("message_id").alias("messageId"),
        scope_type.alias("scopeType"),
        F.col("scope_id").alias("scopeId"),
        F.col("sender_id").alias("senderId"),
        F.col("text").alias("text"),
        iso_micros(F.col("created_at")).alias("createdAtUtc"),
        F.col("origin_pod_id").alias("originPodId"),
    ))


def encode_events(events: DataFrame) -> DataFrame:
    """Events as broker records: key = scope id, value = JSON with numeric scope type."""
    number = F.when(F.col("scope_type") == CHANNEL, 0).otherwise(1)
    return events.select(F.col("scope_id").alias("key"), event_json(number).alias("value"))
