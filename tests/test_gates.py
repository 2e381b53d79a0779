import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from palaver.operators.admission import apply_chunk, chunk_table, fold_calls, gate_fixed, gate_rolling
from conftest import at


def call_by_call(times, limit, window, count=0, last=0):
    """The counter as written: a key with an expiry that each allowed call renews."""
    allowed = []
    for time in times:
        if count and time - last >= window:
            count = 0
        if count < limit:
            count, last = count + 1, time
            allowed.append(True)
        else:
            allowed.append(False)
    return allowed, count, last


times_of_calls = st.lists(st.integers(0, 60), max_size=60).map(sorted)


@given(times_of_calls, st.integers(1, 5), st.integers(1, 12), st.integers(0, 5))
@settings(max_examples=400, deadline=None)
def test_fold_is_the_counter(times, limit, window, count):
    count, shifted = min(count, limit), np.array([t + 5 for t in times], dtype="int64")
    last = 3 if count else 0
    allowed, *state = fold_calls(shifted, count, last, limit, window)
    expected, *expected_state = call_by_call(shifted.tolist(), limit, window, count, last)
    assert allowed.tolist() == expected and state == expected_state


@given(times_of_calls.filter(len), st.integers(1, 5), st.integers(1, 12), st.data())
@settings(max_examples=600, deadline=None)
def test_chunk_tables_know_the_counter_after_a_chunk(times, limit, window, data):
    shifted = np.array([t + 20 for t in times], dtype="int64")
    count = data.draw(st.integers(0, limit))
    last = data.draw(st.integers(1, int(shifted[0]))) if count else 0
    _, *expected = call_by_call(shifted.tolist(), limit, window, count, last)
    assert list(apply_chunk(chunk_table(shifted, limit, window), count, last, limit, window)) == expected


def random_calls(seed, size, users, span):
    pick = random.Random(seed)
    hot = lambda: "hot" if pick.random() < 0.5 else f"u{pick.randrange(users)}"
    return [(hot(), "s", round(pick.random() * span, 3)) for _ in range(size)]


def expected_rolling(rows, limit, window):
    by_user, out = {}, {}
    for row in sorted(rows, key=lambda r: (r.created_at, r.message_id)):
        by_user.setdefault(row.sender_id, []).append(row)
    for calls in by_user.values():
        seconds = [round(c.created_at.timestamp() * 1e6) for c in calls]
        allowed, *_ = call_by_call(seconds, limit, window * 1_000_000)
        out.update({c.message_id: a for c, a in zip(calls, allowed)})
    return out


@pytest.mark.parametrize("chunk_rows", [1_000_000, 20])
def test_rolling_gate_with_and_without_chunks(chat, chunk_rows):
    events = chat(random_calls(7, 600, 5, 900))
    found = gate_rolling(events, 3, 7, chunk_rows=chunk_rows)
    assert found.columns == [*events.columns, "allowed"]
    assert {r.message_id: r.allowed for r in found.collect()} == expected_rolling(events.collect(), 3, 7)


def test_hot_users_are_cut_into_chunks(chat):
    events = chat(random_calls(7, 600, 5, 900))
    plan = gate_rolling(events, 3, 7, chunk_rows=20)
    keys = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in keys and "MapInArrow" in keys


def test_texts_of_a_busy_user_do_not_go_through_the_fold(chat):
    events = chat([("a", "s", n, "long " * 200) for n in range(50)])
    checked = gate_rolling(events, 3, 7, counted=F.length("text") > 0)
    plan = checked.select("message_id", "allowed")._jdf.queryExecution().optimizedPlan().toString()
    folded = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert folded and not any(name in line for line in folded for name in ("text#", "origin_pod_id#"))
    assert {r.text for r in checked.collect()} == {"long " * 200}


def test_calls_alike_pass_as_often_as_the_counter_lets_them(chat):
    events = chat([("a", "s", 0, "no"), ("a", "s", 0, "1"), ("a", "s", 0, "2"), ("a", "s", 0, "3"), (None, "s", 0, "4"),
                   (None, "s", 0, "5"), ("a", "s", 90, "6")]).withColumn("message_id", F.when(F.col("text") == "6", "m"))
    for chunk_rows in (1_000_000, 1):
        rows = gate_rolling(events, 2, 60, counted=F.col("text") != "no", chunk_rows=chunk_rows).collect()
        assert sorted(r.text for r in rows) == ["1", "2", "3", "4", "5", "6", "no"]
        passed = [r.text for r in rows if r.allowed]
        assert len(passed) == 5 and {"4", "5", "6"} < set(passed) and "no" not in passed


def test_rolling_gate_edge(chat):
    events = chat([("a", "s", 0), ("a", "s", 1), ("a", "s", 60.9), ("a", "s", 61)])
    found = {r.message_id: r.allowed for r in gate_rolling(events, 2, 60).collect()}
    assert list(found[k] for k in sorted(found)) == [True, True, False, True]


def test_rolling_gate_leaves_out_uncounted_calls(chat):
    events = chat([("a", "s", 0, "no"), ("a", "s", 1), ("a", "s", 2)])
    found = {r.message_id: r.allowed for r in gate_rolling(events, 1, 60, counted=F.col("text") != "no").collect()}
    assert found == {"m0000": False, "m0001": True, "m0002": False}


def test_fixed_gate(chat):
    events = chat(random_calls(3, 500, 4, 300))
    found = {r.message_id: r.allowed for r in gate_fixed(events, 4, 60).collect()}
    used, expected = {}, {}
    for row in sorted(events.collect(), key=lambda r: (r.created_at, r.message_id)):
        key = (row.sender_id, int(row.created_at.timestamp()) // 60)
        used[key] = used.get(key, 0) + 1
        expected[row.message_id] = used[key] <= 4
    assert found == expected


def test_fixed_gate_sends_on_only_the_first_calls(chat):
    plan = gate_fixed(chat([("a", "s", 0)]), 100, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("gate", [gate_fixed, gate_rolling])
def test_calls_without_a_user_share_a_counter(chat, gate):
    events = chat([(None, "s", 0), (None, "s", 1), ("a", "s", 2), (None, "s", 3)])
    found = {r.message_id: r.allowed for r in gate(events, 2, 60).collect()}
    assert found == {"m0000": True, "m0001": True, "m0002": True, "m0003": False}


@pytest.mark.parametrize("gate", [gate_fixed, gate_rolling])
def test_bad_limits(chat, gate):
    with pytest.raises(ValueError):
        gate(chat([]), 0, 60)


def test_missing_users_and_bursts_are_cut(chat):
    steps = [0.01 * n for n in range(300)] + [40 + 3.3 * n for n in range(60)]
    events = chat([(user, "s", second) for user in (None, "burst", "calm") for second in (steps if user != "calm" else steps[-9:])])
    whole = {r.message_id: r.allowed for r in gate_rolling(events, 3, 7).collect()}
    cut = gate_rolling(events, 3, 7, chunk_rows=40)
    assert {r.message_id: r.allowed for r in cut.collect()} == whole
    for user in (None, "burst"):
        ids = [f"m{n + (0 if user is None else 360):04d}" for n in range(360)]
        times = np.array([round(second * 1_000_000) for second in steps])
        assert [whole[i] for i in ids] == fold_calls(times, 0, 0, 3, 7_000_000)[0].tolist()
