"""Chat data derived from the given tables.

Each view exists twice, here in Spark and in ``oracles`` as SQL. All of a table's rows are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palaver.functions.ids import stable_uuid
from palaver.functions.times import iso_micros
from palaver.operators.decode import event_json
from palaver.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with its time as an instant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# The emoji each event type adds to its message.
EMOJI_BY_EVENT = {"purchase": "\U0001F389", "signup": "\U0001F44B", "error": "⚠"}


def as_chat_events(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows of ``events`` as chat messages, with ``more`` columns of those rows."""
    kind = F.col("event_type")
    emoji = F.lit("")
    for name, symbol in EMOJI_BY_EVENT.items():
        emoji = F.when(kind == name, symbol).otherwise(emoji)
    return rows.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.when(kind == "purchase", "DirectMessage").otherwise("Channel").alias("scope_type"),
        F.concat_ws("-", kind, F.col("user_id") % 30).alias("scope_id"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("sender_id"),
        F.concat(kind, F.lit(":"), F.col("props"), emoji).alias("text"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("pod-"), F.col("event_id") % 3).alias("origin_pod_id"),
        *more,
    )


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chat_events(events(spark, sf_dir))


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages with the broker partition and offset they were read from."""
    number = F.col("message_id").cast("long")
    return chat_events(spark, sf_dir).withColumns({
        "partition": (number % 3).cast("int"), "offset": F.floor(number / 3).cast("long"),
    })


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as send requests, one a second; some ids are blank, some texts too long."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("message_id"),
        F.when(doc % 41 == 0, " \t").otherwise(F.col("lang")).alias("sender_id"),
        F.lit("Channel").alias("scope_type"),
        F.when(doc % 43 == 0, "").when(doc % 47 == 0, F.lit(None)).otherwise(F.col("source")).alias("scope_id"),
        F.col("text"),
        F.when(doc % 37 == 0, F.repeat(F.lit("p"), 257)).otherwise(F.col("source")).alias("origin_pod_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + doc).alias("requested_at"),
    )


def documents_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages of their source, an hour apart."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"),
        F.lit("Channel").alias("scope_type"),
        F.col("source").alias("scope_id"),
        F.col("lang").alias("sender_id"),
        F.col("text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("created_at"),
        F.col("source").alias("origin_pod_id"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: a conversation an hour, a turn every 17 seconds."""
    seconds = F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 17
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.lit("DirectMessage").alias("scope_type"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("scope_id"),
        F.col("role").alias("sender_id"),
        F.col("text"),
        F.timestamp_seconds(seconds).alias("created_at"),
        F.lit("pod-0").alias("origin_pod_id"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are members of a scope from their first message there until their last."""
    return chat_events(spark, sf_dir).groupBy("scope_type", "scope_id", F.col("sender_id").alias("user_id")).agg(
        F.min("created_at").alias("joined_at"), F.max("created_at").alias("left_at")
    )


def presence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_presence_events(events(spark, sf_dir))


def as_presence_events(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rows.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("pod-"), F.col("user_id") % 3).alias("pod_id"),
        F.concat(F.lit("conn-"), F.col("event_id") % 2).alias("connection_id"),
        F.when(kind == "signup", "online").when(kind == "error", "offline").otherwise("heartbeat").alias("kind"),
        "ts",
    )


def policy_versions(rows: DataFrame) -> DataFrame:
    """A version of a user's alert levels from each sign-up on."""
    shift = F.col("event_id") % 3
    return rows.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("user_id"), F.col("ts").alias("valid_from"),
        *[(shift + least).cast("int").alias(name) for name, least in (("warning", 3), ("throttle", 5), ("flag", 7))])


def membership_changes(memberships: DataFrame) -> DataFrame:
    """Joining and leaving as events."""
    both = F.array(F.struct(F.lit("joined").alias("kind"), F.col("joined_at").alias("ts")),
                   F.struct(F.lit("left").alias("kind"), F.col("left_at").alias("ts")))
    return memberships.select("scope_type", "scope_id", "user_id", F.explode(both).alias("change")).select(
        "scope_type", "scope_id", "user_id", "change.kind", "change.ts")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log lines with shipper metadata, in a mix of label spellings, containers and ids."""
    number, kind = F.col("event_id"), F.col("event_type")
    corr = F.concat(F.lit("corr_"), stable_uuid(number))
    kept = ["ts", "level", "message", "correlation_id", "context", "exception", "machine_name", "application",
            "pod_name", "container_name", "labels", "inner_message", "latency_ms", "line_id"]
    none = F.lit(None).cast("string")
    return events(spark, sf_dir).withColumns({
        "line_id": number,
        "level": F.when(kind == "error", "Error").when(kind == "signup", "Warning").otherwise("Information"),
        "message": F.concat(
            kind,
            F.when(kind == "error", F.element_at(F.array(
                F.lit(" no host AVAILABLE "), F.lit(" query timeout "), F.lit(" bad input "), F.lit(" lost connection ")
            ), (number % 4 + 1).cast("int"))).otherwise(" "),
            F.col("props"),
        ),
        "correlation_id": F.when(number % 10 == 0, F.concat(F.lit("broken-"), number))
        .when(number % 10 == 1, F.upper(corr)).otherwise(corr),
        "context": F.create_map(
            F.lit("ScopeId"), F.concat_ws("-", kind, F.col("user_id") % 30),
            F.lit("OriginPodId"), F.concat(F.lit("pod-"), F.col("user_id") % 3),
        ),
        "exception": F.when(kind == "error", F.element_at(F.array(*[F.lit(name) for name in (
            "UnauthorizedAccessException", "KeyNotFoundException", "InvalidOperationException", "TimeoutException",
            "ArgumentNullException", "ArgumentException", "IOException")]), (number % 7 + 1).cast("int"))),
        "inner_message": F.when((kind == "error") & (number % 3 == 0), "Connection refused").otherwise(none),
        "machine_name": F.concat(F.lit("pod-"), F.col("user_id") % 3),
        "application": F.lit("chat"),
        "pod_name": F.concat(F.lit("pod-"), F.col("user_id") % 3),
        "container_name": F.element_at(F.array(*[F.lit(name) for name in (
            "chat-api", "history-consumer", "fan-worker", "redis", "web-frontend")]), (number % 5 + 1).cast("int")),
        "labels": F.when(number % 3 == 0, F.create_map(
            F.lit("app_kubernetes_io/name"), F.concat(F.lit("app-"), kind),
            F.lit("app.kubernetes.io/component"), F.element_at(F.array(F.lit("api"), F.lit("db")), (number % 2 + 1).cast("int")),
        )).when(number % 3 == 1, F.create_map(F.lit("app.kubernetes.io/name"), F.lit(""))),
        "latency_ms": F.col("value"),
    }).select(*kept)


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages as broker payloads in all spellings of the scope type, with some bad ones among them."""
    source = events(spark, sf_dir)
    chat = as_chat_events(source)
    number = F.col("message_id").cast("long")
    channel = F.col("scope_type") == "Channel"
    spelled = F.when(number % 3 == 0, F.when(channel, "0").otherwise("1")).when(
        number % 3 == 1, F.col("scope_type")
    ).otherwise(F.when(channel, "CHANNEL").otherwise("DIRECT_MESSAGE"))
    spelled = F.when(number % 50 == 6, "Group").otherwise(spelled)
    altered = chat.withColumns({
        "sender_id": F.when(number % 50 == 3, "\u2003 ").when(number % 50 == 5, F.lit(None)).otherwise(F.col("sender_id")),
        "text": F.when(number % 50 == 4, "\t").when(number % 50 == 10, "nested").otherwise(F.col("text")),
        "scope_id": F.when(number % 50 == 13, "\u2003").otherwise(F.col("scope_id")),
    })
    payloads = altered.withColumn("_json", event_json(spelled))
    body = (
        F.when(number % 50 == 0, F.substring("_json", 1, 40))
        .when(number % 50 == 1, "")
        .when(number % 50 == 2, "null")
        .when(number % 50 == 7, F.concat("_json", F.lit("{}")))
        .when(number % 50 == 8, F.concat("_json", F.lit(" end")))
        .when(number % 50 == 9, F.replace("_json", F.lit('"'), F.lit("'")))
        .when(number % 50 == 10, F.replace("_json", F.lit('"nested"'), F.lit('{"a":1}')))
        .when(number % 50 == 11, F.replace("_json", iso_micros(F.col("created_at")), F.lit("10:30")))
        .when(number % 50 == 12, F.replace("_json", iso_micros(F.col("created_at")), F.lit("2026")))
        .when(number % 50 == 14, F.concat("_json", F.lit(","), F.col("_json")))
        .otherwise(F.col("_json"))
    )
    return payloads.select(
        body.cast("binary").alias("value"),
        (number % 3).cast("int").alias("partition"),
        F.floor(number / 3).cast("long").alias("offset"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message twice, the second time later in the broker and with another text."""
    chat = chat_events(spark, sf_dir)
    number = F.col("message_id").cast("long")
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    return chat.select("*", copies).select(
        "message_id", "scope_type", "scope_id", "sender_id",
        F.when(F.col("copy") == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" (again)"))).alias("text"),
        "created_at", "origin_pod_id",
        F.lit(0).alias("partition"),
        (number + F.col("copy") * 1_000_000_000_000).alias("offset"),
    )


def plain(df: DataFrame) -> DataFrame:
    """Instants as ISO text, so results compare by value whatever the time type of the other engine."""
    return df.select(*[
        iso_micros(F.col(field.name)).alias(field.name) if isinstance(field.dataType, T.TimestampType)
        else F.col(field.name)
        for field in df.schema.fields
    ])
