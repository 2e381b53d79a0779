import pytest
from pyspark.sql import functions as F

from palaver.operators import abuse, analytics, content
from palaver.sources.sinks import analytics_records, rate_limit_records
from conftest import at

GRIN = "\U0001F600"


def naive(ts):
    return ts.replace(tzinfo=None)


def test_windows_senders_and_lengths(chat):
    rows = chat([("a", "s", 0, "abc"), ("b", "s", 59.9, GRIN), ("a", "s", 60, ""), ("a", "t", 5, "x"),
                 ("a", "s", 5, "y", "DirectMessage")])
    found = {(r.scope_type, r.scope_id, r.window_start): r for r in analytics.scope_analytics(rows).collect()}
    first = found[("Channel", "s", naive(at(0)))]
    assert (first.message_count, first.active_user_count, first.total_character_count) == (2, 2, 5)
    assert first.average_message_length == 2.5 and first.window_end == naive(at(60))
    assert (first.first_event_at, first.last_event_at) == (naive(at(0)), naive(at(59.9)))
    assert found[("Channel", "s", naive(at(60)))].average_message_length == 0.0
    assert len(found) == 4


def test_sliding_windows_count_each_sender_once(chat):
    rows = chat([("a", "s", 0), ("a", "s", 10), ("a", "s", 20), ("b", "s", 20)])
    found = {r.window_start: (r.message_count, r.active_user_count)
             for r in analytics.scope_analytics(rows, 30, 10).collect()}
    assert found == {naive(at(-20)): (1, 1), naive(at(-10)): (2, 1), naive(at(0)): (4, 2), naive(at(10)): (3, 2),
                     naive(at(20)): (2, 2)}


def test_ids_are_the_same_on_replay(chat):
    rows = chat([("a", "s", 0), ("b", "t", 0)])
    ids = [{r.analytics_id for r in analytics.scope_analytics(rows).collect()} for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 2


@pytest.mark.parametrize("size, slide", [(0, None), (60, 0), (60, 70), (60, 25)])
def test_bad_windows(chat, size, slide):
    with pytest.raises(ValueError):
        analytics.scope_analytics(chat([]), size, slide)


@pytest.mark.parametrize("levels", [(0, 1, 2), (80, 80, 200), (80, 300, 200)])
def test_bad_thresholds(chat, levels):
    with pytest.raises(ValueError):
        abuse.check_thresholds(*levels)


@pytest.mark.parametrize("count, levels", [
    (79, []), (80, ["Warning"]), (99, ["Warning"]), (100, ["Throttle", "Warning"]), (199, ["Throttle", "Warning"]),
    (200, ["Flag", "Throttle", "Warning"]),
])
def test_level_edges(chat, count, levels):
    rows = chat([("a", "s", n * 0.001) for n in range(count)])
    for alerts in (abuse.detect_alerts(rows, 60, 60), abuse.rate_alerts(abuse.user_rate(rows, 60, 60))):
        assert sorted(r.event_type for r in alerts.collect()) == levels


def test_alert_fields(chat):
    rows = chat([("a", "late", 2), ("a", "early", 1)] + [("a", "x", 3)] * 103)
    alert = abuse.detect_alerts(rows, 60, 60).filter("event_type = 'Throttle'").first()
    assert (alert.scope_id, alert.message_count, alert.threshold, alert.excess_count) == ("early", 105, 100, 5)
    assert alert.messages_per_second == 1.75 and alert.context == "User exceeded throttle threshold"


def test_both_alert_paths_agree(chat):
    rows = chat([(f"u{n % 3}", f"s{n % 5}", (n * 37) % 400) for n in range(300)])
    rates = abuse.user_rate(rows, 60, 10)
    one = abuse.rate_alerts(rates, 5, 10, 20).collect()
    two = abuse.detect_alerts(rows, 60, 10, 5, 10, 20).collect()
    assert sorted(one) == sorted(two) and one


def test_alerts_are_the_union_of_the_levels(chat):
    rates = abuse.user_rate(chat([("a", "s", n * 0.01) for n in range(150)]), 60, 60)
    alerts = abuse.rate_alerts(rates)
    by_level = [alerts.filter(F.col("event_type") == level) for level in abuse.LEVEL_CONTEXT]
    assert sorted(by_level[0].unionByName(by_level[1]).unionByName(by_level[2]).collect()) == sorted(alerts.collect())
    assert [rows.count() for rows in by_level] == [0, 1, 1]


def test_scopes_behind_a_rate(chat):
    rows = chat([("a", "s", 0), ("a", "t", 1), ("a", "t", 2)])
    found = {(r.scope_id, r.message_count) for r in abuse.user_rate_scopes(rows, 60, 60).collect()}
    assert found == {("s", 1), ("t", 2)}


def test_highest_and_first_only(chat):
    rows = chat([("a", "s", n * 0.1) for n in range(200)])
    rates = abuse.user_rate(rows, 60, 10)
    assert {r.event_type for r in abuse.rate_alerts(rates, highest_only=True).collect()} >= {"Flag"}
    firsts = abuse.first_alerts(abuse.rate_alerts(rates)).collect()
    assert len(firsts) == 3 and len({r.event_type for r in firsts}) == 3


def test_policies_replace_the_defaults(spark, chat):
    rows = chat([("a", "s", n) for n in range(5)] + [("b", "s", n) for n in range(5)])
    policies = spark.createDataFrame([("a", 2, 4, 50)], "user_id string, warning int, throttle int, flag int")
    by_rates = abuse.rate_alerts_by_policy(abuse.user_rate(rows, 60, 60), policies).collect()
    direct = abuse.detect_alerts(rows, 60, 60, policies=policies).collect()
    assert {(r.user_id, r.event_type) for r in by_rates} == {("a", "Warning"), ("a", "Throttle")}
    assert sorted(r.rate_limit_event_id for r in by_rates) == sorted(r.rate_limit_event_id for r in direct)


def test_versions_take_effect_at_the_end_of_a_window(spark, chat):
    rows = chat([("a", "s", 60 * minute + n) for minute in range(5) for n in range(5)] + [("b", "s", n) for n in range(5)])
    versions = [("a", at(100), 2, 3, 50), ("a", at(180), 3, 40, 50), ("a", at(180), 1, 2, 3), ("a", at(10_000_000), 1, 2, 3),
                ("a", at(240), None, None, None), ("c", at(0), 1, 2, 3), ("b", at(61), 1, 2, 3)]
    policies = spark.createDataFrame(versions, "user_id string, valid_from timestamp, warning int, throttle int, flag int")
    rates = abuse.user_rate(rows, 60, 60)
    for bucket in (86_400, 50):
        found = abuse.rate_alerts_as_of(rates, policies, warning=4, throttle=6, flag=8, bucket_seconds=bucket).collect()
        got = {(r.user_id, int(r.window_end.timestamp() - at(0).timestamp()), r.event_type, r.threshold) for r in found}
        # Windows end at 60, 120, ...; of the two versions of 180 the higher levels count; nulls are defaults.
        assert got == {("a", 60, "Warning", 4), ("a", 120, "Warning", 2), ("a", 120, "Throttle", 3), ("a", 180, "Warning", 3),
                       ("a", 240, "Warning", 4), ("a", 300, "Warning", 4), ("b", 60, "Warning", 4)}


def test_records(chat):
    rows = chat([("a", "s", n * 0.01, "abc") for n in range(80)])
    stamp = F.lit("2026-01-15 10:31:05").cast("timestamp")
    record = analytics_records(analytics.scope_analytics(rows), stamp).first()
    assert record.key == "s" and '"windowStartUtc":"2026-01-15T10:30:00Z"' in record.value
    assert '"averageMessageLength":3.0' in record.value and '"computedAtUtc":"2026-01-15T10:31:05Z"' in record.value
    alert = rate_limit_records(abuse.detect_alerts(rows, 60, 60), stamp).first()
    assert alert.key == "a" and '"eventType":"Warning"' in alert.value


def test_words_and_emoji(chat):
    rows = chat([("a", "s", 0, "Hi, hi there! " + GRIN + GRIN), ("b", "s", 1, "été 你好 HI ⚠")])
    words = {r.word: r.occurrences for r in content.word_frequency(rows).collect()}
    assert words == {"hi": 3, "there": 1, "été": 1, "你好": 1}
    emoji = {r.emoji: r.occurrences for r in content.emoji_counts(rows).collect()}
    assert emoji == {GRIN: 2, "⚠": 1}
