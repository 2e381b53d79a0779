import pytest
from pyspark.sql import functions as F

from palaver.functions.text import is_blank, preview_bytes, preview_characters, utf16_length
from palaver.operators.admission import admit, id_problem, persistable, rate_key, text_problem, validate_message
from palaver.schemas import SEND_REQUEST
from conftest import at

GRIN = "\U0001F600"

GOOD_IDS = ["general", "random", "550e8400-e29b-41d4-a716-446655440000", "user-12345", "a", "a" * 256,
            "chat-api-7d9f4c5b6d-abc12", GRIN * 128]
BAD_IDS = [(None, "null"), ("", "blank"), ("   ", "blank"), ("\t", "blank"), ("\n", "blank"), (" \t\n ", "blank"),
           (" \u0085", "blank"), ("x" * 257, "too_long"), (GRIN * 128 + "a", "too_long")]
TEXTS = [("Hello, world!", None), ("", None), ("   ", None), ("\t\n", None), (GRIN * 3, None),
         ("Hi 你好 Привет مرحبا", None), ("a" * 4096, None), (GRIN * 2048, None), (None, "null"),
         ("x" * 4097, "too_long"), (GRIN * 2049, "too_long")]


def values(spark, items, column):
    rows = spark.createDataFrame([(n, item) for n, item in enumerate(items)], "n int, v string")
    return [row.r for row in rows.select("n", column.alias("r")).orderBy("n").collect()]


def test_ids(spark):
    assert values(spark, GOOD_IDS, id_problem(F.col("v"))) == [None] * len(GOOD_IDS)
    assert values(spark, [v for v, _ in BAD_IDS], id_problem(F.col("v"))) == [reason for _, reason in BAD_IDS]


def test_texts(spark):
    assert values(spark, [v for v, _ in TEXTS], text_problem(F.col("v"))) == [reason for _, reason in TEXTS]


def test_utf16_length(spark):
    words = ["", "abc", "é", GRIN, "a" + GRIN + "你"]
    assert values(spark, words, utf16_length(F.col("v"))) == [len(w.encode("utf-16-le")) // 2 for w in words]


def test_blank(spark):
    assert values(spark, [None, "", "  ", " a "], is_blank(F.col("v"))) == [True, True, True, False]


def test_previews(spark):
    payloads = [b"", None, b"short", b"a" * 256, b"a" * 257, b"a" * 255 + "é".encode() + b"b", b"\xff\xfe"]
    rows = spark.createDataFrame([(n, p) for n, p in enumerate(payloads)], "n int, v binary")
    found = rows.select("n", preview_bytes(F.col("v")).alias("b"), preview_characters(F.col("v")).alias("c"))
    by_bytes, by_characters = zip(*[(r.b, r.c) for r in found.orderBy("n").collect()])
    assert by_bytes[2:6] == ("short", "a" * 256, "a" * 256 + "...", "a" * 255 + "�...")
    assert by_characters[:6] == ("<empty>", "<empty>", "short", "a" * 256, "a" * 256 + "...",
                                 "a" * 255 + "é" + "...")
    assert by_characters[6] == "��"


def request(spark, rows):
    """(id, sender, scope, text, pod, seconds)"""
    full = [(m, s, "Channel", scope, t, pod, at(sec)) for m, s, scope, t, pod, sec in rows]
    return spark.createDataFrame(full, SEND_REQUEST)


@pytest.mark.parametrize("row, code", [
    (("1", "user-123", "general", "Hello, world!", "chat-api-pod-123", 0), "ACCEPTED"),
    (("1", None, "general", "hi", "pod", 0), "VALIDATION_ERROR"),
    (("1", "user", "", "hi", "pod", 0), "VALIDATION_ERROR"),
    (("1", "user", "general", "x" * 4097, "pod", 0), "VALIDATION_ERROR"),
    (("1", "user", "general", "hi", "", 0), "CONFIGURATION_ERROR"),
    (("1", "user", "conv-user123-user456", "", "pod", 0), "ACCEPTED"),
])
def test_single_requests(spark, row, code):
    assert admit(request(spark, [row])).first().code == code


def test_rejected_requests_use_no_quota_but_bad_pods_do(spark):
    rows = [("1", "u", "", "hi", "pod", 0), ("2", "u", "s", "hi", "", 1), ("3", "u", "s", "hi", "pod", 2),
            ("4", "u", "s", "hi", "pod", 3)]
    codes = {r.message_id: r.code for r in admit(request(spark, rows), limit=2).collect()}
    assert codes == {"1": "VALIDATION_ERROR", "2": "CONFIGURATION_ERROR", "3": "ACCEPTED", "4": "RATE_LIMIT_EXCEEDED"}


def test_first_failing_rule_wins(spark):
    found = validate_message(request(spark, [("1", " ", "", None, "", 0)])).first()
    assert (found.request_problem, found.pod_problem) == ("sender_id:blank", "origin_pod_id:blank")


def test_history_is_stricter_than_sending(spark):
    rows = [("1", "u", "s", "  ", "p", 0), ("2", "u", "s", "hi", "p", 0), ("3", "\t", "s", "hi", "p", 0)]
    assert [r.message_id for r in persistable(request(spark, rows)).collect()] == ["2"]


def test_rate_key(spark):
    assert values(spark, ["user-9"], rate_key(F.col("v"))) == ["rl:user-9:SendMessage:60"]
