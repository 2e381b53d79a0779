"""Stored history in time buckets whose width is chosen for each scope by its measured rows.

A table is three folders. ``rows`` has the messages, by write, bucket width and bucket. ``buckets`` has the catalogue: the
rows of each bucket of those scopes that need narrower buckets than the widest; as each of them overfills a wider bucket,
they are at most one for every ``bucket_rows`` rows of a write. ``commits`` has one row for each finished write. Readers see
finished writes alone, so a write that failed halfway shows nothing and its replay starts anew, and a write whose id is
committed is not done again. One writer at a time.

Rows without a scope key are not stored; rows without a time are, in the widest bucket of none, and are found by lookups
without bounds.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from palaver.operators import history as stored_history
from palaver.operators.history import KEY, first_writer
from palaver.schemas import HISTORY_ROW
from palaver.session import configure

# Seconds of a bucket, widest first; each is a multiple of the next.
WIDTHS = (604_800, 86_400, 21_600, 3_600)
BUCKET_ROWS = 1_000_000

_WRITE = T.StructField("write_id", T.StringType())
_PLACE = [T.StructField("bucket_seconds", T.IntegerType()), T.StructField("bucket_start", T.LongType())]
_ROWS = T.StructType([*HISTORY_ROW.fields, _WRITE, *_PLACE])
_BUCKETS = T.StructType([T.StructField("scope_key", T.StringType()), *_PLACE, T.StructField("rows", T.LongType()), _WRITE])
_COMMITS = T.StructType([
    T.StructField("widest", T.IntegerType()), T.StructField("replaces", T.ArrayType(T.StringType())), _WRITE,
])


def check_widths(widths: tuple[int, ...]) -> None:
    if not widths or min(widths) <= 0 or any(wide <= narrow or wide % narrow for wide, narrow in zip(widths, widths[1:])):
        raise ValueError("widths must fall, each a multiple of the next")


def _start(seconds: Column, width: Column) -> Column:
    return seconds - F.pmod(seconds, width)


def _bucket_rows(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Rows of every bucket of every width. The wider ones are summed from the narrowest, which are hash-aggregated, so a
    busy scope reaches the shuffle as one row a task and bucket."""
    check_widths(widths)
    narrow = F.lit(widths[-1])
    slots = rows.filter(F.col("created_at").isNotNull()).groupBy(
        "scope_key", _start(F.unix_seconds("created_at"), narrow).alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
    every = slots.select("scope_key", "slot", "rows", F.explode(F.array(*map(F.lit, widths))).alias("bucket_seconds"))
    start = _start(F.col("slot"), F.col("bucket_seconds")).alias("bucket_start")
    return every.groupBy("scope_key", "bucket_seconds", start).agg(F.sum("rows").alias("rows"))


def bucket_widths(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(scope_key, bucket_seconds, rows, largest): the widest buckets of a scope that hold at most ``bucket_rows`` each, or
    the narrowest where none do, with the scope's rows and those of its largest bucket."""
    by_width = _bucket_rows(rows, widths).groupBy("scope_key", "bucket_seconds").agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("largest"))
    fits = (F.col("largest") <= bucket_rows) | (F.col("bucket_seconds") == widths[-1])
    return by_width.filter(fits).groupBy("scope_key").agg(
        F.max("bucket_seconds").alias("bucket_seconds"), F.first("rows").alias("rows"),
        F.max_by("largest", "bucket_seconds").alias("largest"))


def wide_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(scope_key, bucket_seconds, bucket_start, rows): the buckets of the scopes that need narrower ones than the widest."""
    chosen = bucket_widths(rows, bucket_rows, widths).filter(F.col("bucket_seconds") < widths[0])
    return _bucket_rows(rows, widths).join(chosen.select("scope_key", "bucket_seconds"), ["scope_key", "bucket_seconds"])


def append_buckets(
    incoming: DataFrame, path: str, write_id: str, bucket_rows: int = BUCKET_ROWS, widths: tuple[int, ...] = WIDTHS
) -> bool:
    """Insert-if-absent as one write; false where ``write_id`` is committed already and nothing is done.

    Only stored buckets that reach into the times of the incoming rows are read. A scope may have buckets of other widths
    in other writes; ``compact_buckets`` gives it one.
    """
    spark = configure(incoming.sparkSession)
    _check_write(write_id, widths)
    if write_id in _commits(spark, path):
        return False
    rows = first_writer(incoming.filter(F.col("scope_key").isNotNull())).persist()
    try:
        first, last = rows.agg(F.min("created_at"), F.max("created_at")).first()
        stored = read_buckets(spark, path)
        near = F.col("bucket_start").isNull()
        if first is not None:
            near = near | (_ends_after(F.lit(first)) & _begins_by(F.lit(last)) & F.col("created_at").between(F.lit(first), F.lit(last)))
        known = stored.filter(near).select(*[F.col(name).alias(f"_{name}") for name in KEY])
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in KEY]
        _store(rows.join(known, same, "left_anti"), path, write_id, [], bucket_rows, widths)
    finally:
        rows.unpersist()
    return True


def compact_buckets(
    spark: SparkSession, path: str, write_id: str, bucket_rows: int = BUCKET_ROWS, widths: tuple[int, ...] = WIDTHS
) -> bool:
    """Write all rows anew as one write, each scope in the width that its rows of all writes call for.

    The new write takes the place of the others in the moment it is committed; their files stay until ``remove_replaced``.
    """
    _check_write(write_id, widths)
    commits = _commits(configure(spark), path)
    if write_id in commits:
        return False
    rows = read_buckets(spark, path).select(*HISTORY_ROW.names)
    _store(rows, path, write_id, _visible(commits), bucket_rows, widths)
    return True


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Delete the files of writes that were replaced or never finished, and say which; their commits stay on record."""
    visible, gone = set(_visible(_commits(spark, path))), set()
    for part in ("rows", "buckets"):
        for name in stored_history._file_system(spark, f"{path}/{part}", lambda system, folder: [
                one.getPath().getName() for one in system.listStatus(folder)] if system.exists(folder) else []):
            if name.startswith("write_id=") and (write := name.removeprefix("write_id=")) not in visible:
                stored_history._file_system(spark, f"{path}/{part}/{name}", lambda system, folder: system.delete(folder, True))
                gone.add(write)
    return sorted(gone)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of finished writes, with ``bucket_seconds`` and ``bucket_start`` (seconds since 1970)."""
    return _finished(spark, path, "rows", _ROWS, _commits(spark, path)).drop("write_id")


def find_history(
    spark: SparkSession,
    path: str,
    scope_type: str,
    scope_id: str,
    from_time: datetime | str | None = None,
    to_time: datetime | str | None = None,
    limit: int = 100,
    upper: str = "inclusive",
    after: tuple[datetime | str, str] | None = None,
) -> DataFrame:
    """What ``history.history`` finds, or with ``after`` what ``history.next_page`` finds, from the buckets that may hold it.

    Besides the bounds, the catalogue says by which time a wide scope has ``limit`` rows; later buckets are not read.
    """
    configure(spark)
    commits = _commits(spark, path)
    rows = _finished(spark, path, "rows", _ROWS, commits)
    catalogue = _finished(spark, path, "buckets", _BUCKETS, commits).filter(F.col("scope_key") == f"{scope_type}:{scope_id}")
    lower = after[0] if after is not None else from_time
    whole = F.lit(True)
    if lower is not None:
        begin = F.lit(lower).cast("timestamp")
        rows = rows.filter(_ends_after(begin))
        whole = F.timestamp_seconds("bucket_start") > begin
    if to_time is not None:
        rows = rows.filter(_begins_by(F.lit(to_time).cast("timestamp")))
    used, until = _reach(catalogue, whole, limit)
    rows = rows.filter(F.col("bucket_seconds").isin(*{*used, *(widest for widest, _ in commits.values())}))
    if until is not None:
        rows = rows.filter(F.col("bucket_start").isNull() | (F.col("bucket_start") < until))
    rows = rows.select(*HISTORY_ROW.names)
    if after is not None:
        return stored_history.next_page(rows, scope_type, scope_id, after, limit)
    return stored_history.history(rows, scope_type, scope_id, from_time, to_time, limit, upper)


def _reach(catalogue: DataFrame, whole: Column, limit: int) -> tuple[list[int], int | None]:
    """The widths of one scope's buckets, and the second by which its buckets that count as a whole hold ``limit`` rows."""
    end = (F.col("bucket_start") + F.col("bucket_seconds")).alias("end")
    by_end = catalogue.groupBy(end).agg(
        F.sum(F.when(whole, F.col("rows")).otherwise(0)).alias("rows"), F.collect_set("bucket_seconds").alias("widths"))
    # One scope's buckets: an hour each at the least, so the calendar bounds the rows in this window.
    running = by_end.withColumn("held", F.sum("rows").over(Window.orderBy("end")))
    found = running.agg(
        F.array_distinct(F.flatten(F.collect_set("widths"))).alias("widths"),
        F.min(F.when(F.col("held") >= limit, F.col("end"))).alias("until")).first()
    return found["widths"], found["until"]


def _ends_after(time: Column) -> Column:
    return F.col("bucket_start") + F.col("bucket_seconds") > F.unix_seconds(time)


def _begins_by(time: Column) -> Column:
    return F.col("bucket_start") <= F.unix_seconds(time)


def _check_write(write_id: str, widths: tuple[int, ...]) -> None:
    check_widths(widths)
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", write_id):
        raise ValueError("a write id has letters, digits, _, . and -")


def _store(rows: DataFrame, path: str, write_id: str, replaces: list[str], bucket_rows: int, widths: tuple[int, ...]) -> None:
    """The catalogue, then the rows, then the commit, each replacing what a failed try of the same write has left."""
    spark, place = rows.sparkSession, f"write_id={write_id}"
    rows = rows.persist()
    try:
        wide_buckets(rows, bucket_rows, widths).write.mode("overwrite").parquet(f"{path}/buckets/{place}")
        written = spark.read.schema(T.StructType(_BUCKETS.fields[:-1])).parquet(f"{path}/buckets/{place}")
        narrow = written.select("scope_key", "bucket_seconds").distinct()
        laid = rows.join(narrow, "scope_key", "left").withColumn(
            "bucket_seconds", F.coalesce("bucket_seconds", F.lit(widths[0])))
        laid = laid.withColumn("bucket_start", _start(F.unix_seconds("created_at"), F.col("bucket_seconds")))
        order = ["bucket_seconds", "bucket_start", *KEY]
        laid.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("bucket_seconds", "bucket_start").parquet(f"{path}/rows/{place}")
    finally:
        rows.unpersist()
    replaced = F.array(*map(F.lit, replaces)).cast("array<string>").alias("replaces")
    spark.range(1).select(F.lit(widths[0]).alias("widest"), replaced).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/{place}")


def _commits(spark: SparkSession, path: str) -> dict[str, tuple[int, list[str]]]:
    """The finished writes with their widest bucket and what they replace: a row for each write."""
    if not stored_history._exists(spark, f"{path}/commits"):
        return {}
    return {row["write_id"]: (row["widest"], row["replaces"]) for row in spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect()}


def _visible(commits: dict[str, tuple[int, list[str]]]) -> list[str]:
    replaced = {write for _, others in commits.values() for write in others}
    return sorted(set(commits) - replaced)


def _finished(spark: SparkSession, path: str, part: str, schema: T.StructType, commits: dict[str, tuple[int, list[str]]]) -> DataFrame:
    visible = _visible(commits)
    if not visible:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{part}").filter(F.col("write_id").isin(*visible))
