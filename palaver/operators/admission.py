"""Message rules and the per-user counters that admit or refuse a message."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palaver.functions.text import is_blank, utf16_length
from palaver.functions.times import time_bucket

# Limits and result codes of the message rules.
MAX_ID_LENGTH = 256
MAX_TEXT_LENGTH = 4096
DEFAULT_LIMIT = 100
DEFAULT_WINDOW_SECONDS = 60
VALIDATION_ERROR = "VALIDATION_ERROR"
RATE_LIMIT_EXCEEDED = "RATE_LIMIT_EXCEEDED"
CONFIGURATION_ERROR = "CONFIGURATION_ERROR"
ACCEPTED = "ACCEPTED"


def id_problem(value: Column) -> Column:
    """``null``, ``blank``, ``too_long`` or null: the rule for scope, sender and pod ids."""
    return (
        F.when(value.isNull(), "null")
        .when(is_blank(value), "blank")
        .when(utf16_length(value) > MAX_ID_LENGTH, "too_long")
    )


def text_problem(value: Column) -> Column:
    """``null``, ``too_long`` or null; empty and blank text may be sent."""
    return F.when(value.isNull(), "null").when(utf16_length(value) > MAX_TEXT_LENGTH, "too_long")


def _first_problem(*named: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(problem.isNotNull(), F.concat(F.lit(f"{field}:"), problem)) for field, problem in named])


def validate_message(requests: DataFrame) -> DataFrame:
    """Adds ``request_problem`` (first of sender, scope, text) and ``pod_problem``, as ``field:problem``."""
    return requests.withColumn(
        "request_problem",
        _first_problem(
            ("sender_id", id_problem(F.col("sender_id"))),
            ("scope_id", id_problem(F.col("scope_id"))),
            ("text", text_problem(F.col("text"))),
        ),
    ).withColumn("pod_problem", _first_problem(("origin_pod_id", id_problem(F.col("origin_pod_id")))))


def persistable(events: DataFrame) -> DataFrame:
    """Events the history keeps: stricter than sending, neither sender nor text may be blank."""
    return events.filter(~is_blank(F.col("sender_id")) & ~is_blank(F.col("text")))


def rate_key(user: Column, endpoint: str = "SendMessage", window_seconds: int = DEFAULT_WINDOW_SECONDS) -> Column:
    return F.concat_ws(":", F.lit("rl"), user, F.lit(endpoint), F.lit(window_seconds))


def _check_gate(limit: int, window_seconds: int) -> None:
    if limit <= 0 or window_seconds <= 0:
        raise ValueError("limit and window must be positive")


def gate_fixed(
    calls: DataFrame,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    user: str = "sender_id",
    time: str = "created_at",
    row_id: str = "message_id",
    counted: Column | None = None,
) -> DataFrame:
    """Adds ``allowed``: the first ``limit`` calls of a user per aligned window, by (time, row_id).

    Only the limit-th call of each full window is looked for, so each task sends on at most ``limit`` rows per
    user and window; the calls then compare themselves with that cut. Ids must be unique.
    Calls where ``counted`` is false use no quota and are not allowed.
    """
    _check_gate(limit, window_seconds)
    counts = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    marked = calls.withColumn("_window", time_bucket(F.col(time), window_seconds)).withColumn("_counts", counts)
    order = Window.partitionBy(user, "_window").orderBy(time, row_id)
    cuts = (
        marked.filter("_counts").select(user, "_window", time, row_id)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == limit)
        .select(F.col(user).alias("_cut_user"), F.col("_window").alias("_cut_window"),
                F.col(time).alias("_cut_time"), F.col(row_id).alias("_cut_id"))
    )
    same_window = F.col(user).eqNullSafe(F.col("_cut_user")) & (F.col("_window") == F.col("_cut_window"))
    within = F.col("_cut_time").isNull() | (F.col(time) < F.col("_cut_time")) | (
        (F.col(time) == F.col("_cut_time")) & (F.col(row_id) <= F.col("_cut_id"))
    )
    return (
        marked.join(cuts, same_window, "left")
        .withColumn("allowed", F.col("_counts") & within)
        .drop("_window", "_counts", "_cut_user", "_cut_window", "_cut_time", "_cut_id")
    )


# --- rolling gate --------------------------------------------------------------------------------------------
#
# Each allowed call starts the expiry anew, a blocked one does not; the counter is gone once ``window`` passes
# without an allowed call. The decision depends on all calls before, so calls are folded in order:
# rows are shuffled by (user, chunk), sorted, and read as Arrow batches with only the counter carried along.
# Most users have one chunk. A user with many calls is cut into chunks of time; for each chunk a small table
# says in which state it is left for every state it could be entered in, these tables are chained per user,
# and then all chunks are folded side by side.


def fold_calls(times: np.ndarray, count: int, last: int, limit: int, window: int) -> tuple[np.ndarray, int, int]:
    """Which of the sorted calls pass, and the counter (count, last allowed time) after them."""
    calls = times.tolist()
    allowed = np.zeros(len(calls), dtype=bool)
    passed, at = [], 0
    while at < len(calls):
        time = calls[at]
        if count and time - last >= window:
            count = 0
        if count < limit:
            passed.append(at)
            count, last, at = count + 1, time, at + 1
        else:
            at = bisect_left(calls, last + window, at + 1)
    allowed[passed] = True
    return allowed, count, last


def _fold_batches(
    batches: Iterator[pa.RecordBatch], user: str, time: str, limit: int, window: int
) -> Iterator[pa.RecordBatch]:
    current, count, last = None, 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        users, chunks = batch.column(user), batch.column("_chunk")
        times = pc.cast(batch.column(time), pa.int64()).to_numpy(zero_copy_only=False)
        counted = batch.column("_counts").to_numpy(zero_copy_only=False)
        is_call = batch.column("_is_call")
        # Two missing users are the same one.
        only_one = pc.not_equal(pc.is_null(users[1:]), pc.is_null(users[:-1]))
        other_user = pc.or_(pc.fill_null(pc.not_equal(users[1:], users[:-1]), False), only_one)
        changed = pc.or_(other_user, pc.not_equal(chunks[1:], chunks[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        allowed = np.zeros(batch.num_rows, dtype=bool)
        for start, stop in zip(edges, edges[1:]):
            group = (users[start].as_py(), chunks[start].as_py())
            if group != current:
                current, count, last = group, 0, 0
                if not is_call[start].as_py():
                    count = batch.column("_entry_count")[start].as_py()
                    last = batch.column("_entry_last")[start].as_py()
            rows = start + np.flatnonzero(counted[start:stop])
            allowed[rows], count, last = fold_calls(times[rows], count, last, limit, window)
        names = [name for name in batch.schema.names if name not in _WORK_COLUMNS]
        columns = [batch.column(name) for name in names] + [pa.array(allowed)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "allowed"]).filter(is_call)


_WORK_COLUMNS = ("_chunk", "_counts", "_is_call", "_entry_count", "_entry_last")

def chunk_table(times: np.ndarray, limit: int, window: int) -> dict:
    """The counter after a chunk of sorted calls, for every counter it may be entered with.

    ``start_*`` lists it for a fresh counter beginning at each call an older full counter could expire at;
    ``carry_*[k - 1]`` for a live counter with ``k`` calls left.
    """
    size = len(times)
    index = np.arange(size)
    gaps = np.append(np.flatnonzero(np.diff(times) >= window) + 1, size)
    next_gap = gaps[np.searchsorted(gaps, index, side="right")]
    full = index + limit - 1
    resumed = np.searchsorted(times, times[np.minimum(full, size - 1)] + window, side="left")
    following = np.where(next_gap <= np.minimum(full, size - 1), next_gap, np.where(full < size, resumed, size))
    jump = np.where(following < size, following, index)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    end_count = np.minimum(limit, size - jump)
    end_last = times[np.minimum(jump + limit, size) - 1]

    starts = int(np.searchsorted(times, times[0] + window, side="right")) + 1
    carry_count, carry_last = [], []
    for left in range(1, limit):
        if gaps[0] <= min(left, size) - 1:
            then = int(gaps[0])
        elif left > size:
            carry_count.append(limit - left + size)
            carry_last.append(int(times[-1]))
            continue
        else:
            then = int(np.searchsorted(times, times[left - 1] + window, side="left"))
        if then < size:
            carry_count.append(int(end_count[then]))
            carry_last.append(int(end_last[then]))
        else:
            carry_count.append(limit)
            carry_last.append(int(times[left - 1]))
    return {
        "first_time": int(times[0]),
        "start_time": times[:starts].tolist(),
        "start_count": end_count[:starts].tolist(),
        "start_last": end_last[:starts].tolist(),
        "carry_count": carry_count,
        "carry_last": carry_last,
    }


def apply_chunk(table: dict, count: int, last: int, limit: int, window: int) -> tuple[int, int]:
    """The counter after a chunk entered with (count, last)."""
    if count == 0 or table["first_time"] - last >= window:
        return int(table["start_count"][0]), int(table["start_last"][0])
    if count < limit:
        left = limit - count
        return int(table["carry_count"][left - 1]), int(table["carry_last"][left - 1])
    at = int(np.searchsorted(np.asarray(table["start_time"]), last + window, side="left"))
    if at < len(table["start_time"]):
        return int(table["start_count"][at]), int(table["start_last"][at])
    return count, last


_FIRST, _CARRY, _START = 0, 1, 2


def _as_rows(table: dict) -> pd.DataFrame:
    """A chunk's table with one row per entry state."""
    parts = [
        (_FIRST, [table["first_time"]], [0], [0]),
        (_CARRY, range(1, len(table["carry_count"]) + 1), table["carry_count"], table["carry_last"]),
        (_START, table["start_time"], table["start_count"], table["start_last"]),
    ]
    return pd.concat([
        pd.DataFrame({"kind": kind, "at": list(at), "count": counts, "last": lasts}, dtype="int64")
        for kind, at, counts, lasts in parts
    ])


def _as_table(rows: pd.DataFrame) -> dict:
    carry, start = rows[rows["kind"] == _CARRY], rows[rows["kind"] == _START]
    return {
        "first_time": int(rows["at"].iloc[0]),
        "start_time": start["at"].to_numpy(), "start_count": start["count"].to_numpy(),
        "start_last": start["last"].to_numpy(), "carry_count": carry["count"].to_numpy(),
        "carry_last": carry["last"].to_numpy(),
    }


def _chain(frames: Iterator[pd.DataFrame], user: str, limit: int, window: int) -> Iterator[pd.DataFrame]:
    """The entry state of each chunk from sorted table rows; only one chunk's table is held."""
    names = [user, "_chunk", "_entry_count", "_entry_last"]
    current, pieces, count, last = None, [], 0, 0
    for frame in frames:
        entries = []
        for key, piece in frame.groupby([user, "_chunk"], sort=False, dropna=False):
            key = (None if pd.isna(key[0]) else key[0], key[1])
            if key != current:
                if current is not None:
                    count, last = apply_chunk(_as_table(pd.concat(pieces)), count, last, limit, window)
                    if key[0] != current[0]:
                        count, last = 0, 0
                entries.append((*key, count, last))
                current, pieces = key, []
            pieces.append(piece)
        yield pd.DataFrame(entries, columns=names)


def _chunk_entries(keys: DataFrame, user: str, time: str, limit: int, window: int) -> DataFrame:
    """The counter each chunk of a hot user is entered with."""
    key_schema = f"{user} {keys.schema[user].dataType.simpleString()}, _chunk long"

    def tabulate(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = _as_rows(chunk_table(np.sort(frame["_micros"].to_numpy()), limit, window))
        rows.insert(0, "_chunk", key[1])
        rows.insert(0, user, key[0])
        return rows

    return (
        keys.select(user, "_chunk", F.unix_micros(time).alias("_micros"))
        .groupBy(user, "_chunk")
        .applyInPandas(tabulate, f"{key_schema}, kind long, at long, count long, last long")
        .repartition(user)
        .sortWithinPartitions(user, "_chunk", "kind", "at")
        .mapInPandas(
            lambda frames: _chain(frames, user, limit, window), f"{key_schema}, _entry_count int, _entry_last long"
        )
    )


def gate_rolling(
    calls: DataFrame,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    user: str = "sender_id",
    time: str = "created_at",
    row_id: str = "message_id",
    counted: Column | None = None,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Adds ``allowed`` by a per-user counter whose expiry each allowed call renews. Batch.

    Only user, time and id are folded; other columns meet the outcome afterwards, those of them that are asked for.
    Calls without a user are counted as one user's. Users with more than ``chunk_rows`` calls are cut into chunks by
    their measured counts: whole windows of time are taken together until a chunk holds that many calls. Calls of one
    user within one window stay in one chunk.
    """
    _check_gate(limit, window_seconds)
    window = window_seconds * 1_000_000
    counts = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    whole_calls = calls.withColumn("_counts", counts)
    marked = whole_calls.select(user, time, row_id, "_counts")

    micros = F.unix_micros(time)
    slots = (
        marked.groupBy(F.col(user).alias("_user"), F.floor(micros / window).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    whole = Window.partitionBy("_user")
    before = F.sum("_rows").over(whole.orderBy("_slot")) - F.col("_rows")
    cuts = (
        slots.withColumn("_chunk", F.floor(before / chunk_rows).cast("long"))
        .withColumn("_all", F.sum("_rows").over(whole)).filter(F.col("_all") > chunk_rows)
        .select("_user", "_slot", "_chunk")
    )
    same = F.col(user).eqNullSafe(F.col("_user")) & (F.floor(micros / window) == F.col("_slot"))
    chunked = (
        marked.join(cuts, same, "left").drop("_user", "_slot").withColumn("_chunk", F.coalesce("_chunk", F.lit(-1).cast("long")))
    )
    entries = _chunk_entries(
        chunked.filter(F.col("_counts") & (F.col("_chunk") >= 0)), user, time, limit, window
    )
    # The entries travel as rows ahead of their chunk's calls: one shuffle brings both together.
    ready = (
        chunked.withColumn("_is_call", F.lit(True))
        .unionByName(
            entries.withColumns({"_is_call": F.lit(False), "_counts": F.lit(False)}), allowMissingColumns=True
        )
        .repartition(user, "_chunk")
        .sortWithinPartitions(user, "_chunk", "_is_call", time, row_id)
    )
    out = [name for name in ready.columns if name not in _WORK_COLUMNS]
    schema = T.StructType([*ready.select(*out).schema.fields, T.StructField("allowed", T.BooleanType(), True)])
    folded = ready.mapInArrow(lambda batches: _fold_batches(batches, user, time, limit, window), schema)
    if set(calls.columns) == {user, time, row_id}:
        return folded.select(*calls.columns, "allowed")
    return _with_outcomes(whole_calls, folded, [user, time, row_id]).select(*calls.columns, "allowed")


def _with_outcomes(calls: DataFrame, folded: DataFrame, key: list[str]) -> DataFrame:
    """The calls with all their columns, which do not go through the fold: they are dealt by user, time and id, so that
    the texts of a busy user are not read by one task. Of calls alike in these, as many are allowed as were."""
    outcomes = folded.groupBy(*key).agg(F.count_if("allowed").alias("_passed"))
    alike = Window.partitionBy(*key)
    return (
        calls.unionByName(outcomes, allowMissingColumns=True)
        .withColumn("_rank", F.row_number().over(alike.orderBy(F.col("_passed").isNotNull(), F.col("_counts").desc())))
        .withColumn("_most", F.max("_passed").over(alike))
        .filter(F.col("_passed").isNull())
        .withColumn("allowed", F.col("_counts") & (F.col("_rank") <= F.col("_most")))
    )


def admit(
    requests: DataFrame,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    gate=gate_fixed,
    time: str = "requested_at",
) -> DataFrame:
    """The outcome of each send request, as ``code`` and ``problem``.

    Rules run in the order sender, scope, text, gate, pod. A request stopped by the first three uses no quota,
    one stopped by its pod id has used it.
    """
    checked = validate_message(requests)
    gated = gate(checked, limit, window_seconds, time=time, counted=F.col("request_problem").isNull())
    code = (
        F.when(F.col("request_problem").isNotNull(), VALIDATION_ERROR)
        .when(~F.col("allowed"), RATE_LIMIT_EXCEEDED)
        .when(F.col("pod_problem").isNotNull(), CONFIGURATION_ERROR)
        .otherwise(ACCEPTED)
    )
    problem = F.when(code == VALIDATION_ERROR, F.col("request_problem")).when(
        code == CONFIGURATION_ERROR, F.col("pod_problem")
    )
    return gated.withColumn("code", code).withColumn("problem", problem).drop(
        "request_problem", "pod_problem", "allowed"
    )
