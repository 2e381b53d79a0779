import json

from pyspark.sql import functions as F

from palaver.functions.errors import is_transient_error, status_of_exception
from palaver.functions.ids import clean_correlation_id, resolve_user_id
from palaver.functions.scope import normalize_scope_type, parse_scope_key, parse_scope_key_leniently, scope_key
from palaver.operators.decode import classify_payload, decode_events, encode_events, quarantine
from palaver.schemas import WIRE_RECORD

EVENT = {
    "messageId": "550e8400-e29b-41d4-a716-446655440000", "scopeType": "Channel", "scopeId": "general",
    "senderId": "user-123", "text": "Hello, world!", "createdAtUtc": "2026-01-15T10:30:00Z",
    "originPodId": "chat-api-7d9f4c5b6d-abc12",
}


def wire(spark, payloads):
    return spark.createDataFrame([(p, 0, n) for n, p in enumerate(payloads)], WIRE_RECORD)


def event(**changes):
    body = {**EVENT, **changes}
    return json.dumps({k: v for k, v in body.items() if v is not ...}).encode()


BAD = [
    (b"", "empty"), (None, "empty"), (b'{"messageId": "1', "bad_json"), (b"null", "null_event"), (b"[]", "bad_json"),
    (b"\xff\xfe{}", "bad_json"), (event(senderId=...), "missing_field"), (event(text=None), "missing_field"),
    (event(scopeType="Group"), "bad_scope_type"), (event(scopeType=2), "bad_scope_type"),
    (event(createdAtUtc="yesterday"), "bad_timestamp"), (event(createdAtUtc="10:30"), "bad_timestamp"),
    (event(createdAtUtc="2026"), "bad_timestamp"), (event(createdAtUtc="2026-01-15"), "bad_timestamp"),
    (event(createdAtUtc="2026-13-15T10:30:00Z"), "bad_timestamp"), (event(scopeId=" "), "blank_scope"),
    (event() + b"{}", "bad_json"), (event() + b" end", "bad_json"), (event() + b"," + event(), "bad_json"),
    (event().replace(b'"', b"'"), "bad_json"), (event(text={"a": 1}), "bad_json"), (event(senderId=[1]), "bad_json"),
    (b"5", "bad_json"), (b'"x"', "bad_json"), (b"  ", "bad_json"), (b"]", "bad_json"), (b"{},", "bad_json"),
]


def test_every_spelling_of_the_scope_type(spark):
    payloads = [event(scopeType=kind) for kind in (0, 1, "Channel", "DirectMessage", "CHANNEL", "DIRECT_MESSAGE")]
    kinds = [r.scope_type for r in decode_events(wire(spark, payloads)).orderBy("offset").collect()]
    assert kinds == ["Channel", "DirectMessage"] * 3


def test_unknown_fields_and_long_fractions(spark):
    row = decode_events(wire(spark, [event(extra={"a": 1}, createdAtUtc="2026-01-15T10:30:00.1234567Z")])).first()
    assert row.sender_id == "user-123" and row.created_at.microsecond == 123456


def test_bad_payloads_are_set_aside(spark):
    rows = wire(spark, [p for p, _ in BAD] + [event()])
    assert [r.reason for r in quarantine(rows).orderBy("offset").collect()] == [reason for _, reason in BAD]
    assert decode_events(rows).count() == 1


def test_verdicts_of_the_history_writer(spark):
    payloads = [event(), b"", b"{", b"null", event(senderId="  "), event(text="\t"), event(senderId=...)]
    rows = classify_payload(wire(spark, payloads)).orderBy("offset").collect()
    assert [r.reason for r in rows] == [None, "empty", "bad_json", "null_event", "blank_sender", "blank_text",
                                        "missing_field"]
    assert rows[0].status == "Success" and rows[1].status == "PermanentFailure"


def test_texts_that_look_like_json_are_texts(spark):
    rows = decode_events(wire(spark, [event(text='{"a": 1}'), event(text="[x"), event(text=5)])).orderBy("offset").collect()
    assert [r.text for r in rows] == ['{"a": 1}', "[x", "5"]


def test_every_payload_is_accepted_or_set_aside(spark):
    payloads = wire(spark, [p for p, _ in BAD] + [event(), event(senderId=" "), event(text="")])
    for for_history, good in ((False, 3), (True, 1)):
        assert decode_events(payloads, for_history=for_history).count() == good
        assert quarantine(payloads, for_history=for_history).count() == len(BAD) + 3 - good
    assert classify_payload(payloads).filter("status = 'Success'").count() == 1


def test_encode_and_decode(spark, chat):
    events = chat([("u1", "s", 0, 'say "hi" \U0001F600'), ("u2", "d", 1.5, "x", "DirectMessage")])
    payloads = encode_events(events).select(
        F.col("value").cast("binary"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset")
    )
    back = decode_events(payloads).drop("partition", "offset")
    assert sorted(back.collect()) == sorted(events.collect())


def test_scope_keys(spark):
    keys = ["Channel:general", "DirectMessage:a:b", "general", ":x", "Channel:", "Group:x", "Channel:  ", "", None]
    rows = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "n int, k string")
    strict = rows.select("n", parse_scope_key(F.col("k")).alias("p")).select("n", "p.*").orderBy("n").collect()
    assert [(r.scope_type, r.scope_id, r.error) for r in strict] == [
        ("Channel", "general", None), ("DirectMessage", "a:b", None), (None, None, "format"), (None, None, "format"),
        (None, None, "format"), (None, None, "scope_type"), (None, None, "scope_id"), (None, None, "blank"),
        (None, None, "blank"),
    ]
    soft = rows.select("n", parse_scope_key_leniently(F.col("k")).alias("p")).select("n", "p.*").orderBy("n").collect()
    assert [(r.scope_type, r.scope_id) for r in soft][:3] == [("Channel", "general"), ("DirectMessage", "a:b"),
                                                             ("Channel", "general")]
    assert soft[-1].scope_id == "unknown"


def test_scope_key_needs_an_id(spark):
    row = spark.range(1).select(
        scope_key(F.lit("Channel"), F.lit(" ")).alias("a"), scope_key(F.lit("Channel"), F.lit("x")).alias("b"),
        normalize_scope_type(F.lit("channel")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (None, "Channel:x", None)


def test_correlation_ids(spark):
    good = "corr_550E8400-E29B-41D4-A716-446655440000"
    rows = spark.createDataFrame([(1, good), (2, "corr_123"), (3, None), (4, good + " ")], "n long, c string")
    found = [r.c for r in rows.select("n", clean_correlation_id(F.col("c"), F.col("n")).alias("c")).orderBy("n").collect()]
    assert found[0] == good.lower()
    assert all(len(c) == 41 and c.startswith("corr_") for c in found) and len(set(found)) == 4


def test_user_ids(spark):
    rows = spark.createDataFrame([("s", "u", "c"), (None, "u", "c"), (None, None, "c")], "s string, u string, c string")
    found = [r.id for r in rows.select(resolve_user_id(F.col("s"), F.col("u"), F.col("c")).alias("id")).collect()]
    assert found == ["s", "u", "anon_c"]


def test_exceptions(spark):
    rows = spark.createDataFrame([("TimeoutException", "x", None), ("ArgumentNullException", "lost CONNECTION", None),
                                  ("Odd", "x", "no host AVAILABLE now"), ("Odd", "x", None), (None, None, None)],
                                 "t string, m string, i string")
    found = rows.select(status_of_exception(F.col("t")).alias("s"),
                        is_transient_error(F.col("t"), F.col("m"), F.col("i")).alias("again")).collect()
    assert [r.s.status for r in found] == [504, 400, 500, 500, 500]
    assert [r.s.log_level for r in found] == ["Error", "Warning", "Error", "Error", "Error"]
    told = rows.select(status_of_exception(F.col("t"), F.col("m"))["detail"].alias("d")).first()
    assert told.d == "x"
    assert [r.again for r in found] == [True, True, True, False, False]
