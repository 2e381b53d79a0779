"""The message history: idempotent append, lookups, paging, layout and retention."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from palaver.functions.scope import parse_scope_key, scope_key
from palaver.schemas import HISTORY_ROW
from palaver.session import configure

KEY = ("scope_key", "created_at", "message_id")
WIDE_SCOPE_ROWS = 100_000_000

_STORED = T.StructType([*HISTORY_ROW.fields, T.StructField("day", T.DateType(), True)])


def to_history(events: DataFrame) -> DataFrame:
    """Events as history rows; broker partition and offset are kept where the source has them."""
    def broker(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)

    return events.select(
        scope_key(F.col("scope_type"), F.col("scope_id")).alias("scope_key"),
        "created_at", "message_id", "sender_id", "text", "origin_pod_id",
        broker("partition", "int").alias("broker_partition"),
        broker("offset", "long").alias("broker_offset"),
    )


def from_history(rows: DataFrame) -> DataFrame:
    """History rows as events, the composite key parsed back."""
    scope = parse_scope_key(F.col("scope_key"))
    return rows.select(
        "message_id", scope["scope_type"].alias("scope_type"), scope["scope_id"].alias("scope_id"),
        "sender_id", "text", "created_at", "origin_pod_id", "broker_partition", "broker_offset",
    )


def first_writer(rows: DataFrame, arrival: tuple[str, ...] = ("broker_partition", "broker_offset")) -> DataFrame:
    """One row per history key: the one that arrived first.

    The rank filter runs inside each task before the shuffle, so many copies of one key shrink to one per task.
    """
    order = Window.partitionBy(*KEY).orderBy(*[F.col(name).asc_nulls_last() for name in arrival], "text")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def rows_to_append(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming rows whose key is not stored yet, first writer of each."""
    return first_writer(incoming).join(stored.select(*KEY), list(KEY), "left_anti")


def distinct_messages(events: DataFrame) -> DataFrame:
    """One event per message id, the earliest by time, then text."""
    order = Window.partitionBy("message_id").orderBy("created_at", "text")
    return events.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def with_layout(rows: DataFrame, bucket: str | None = None) -> DataFrame:
    """Adds ``day``, the partition column, and for wide scopes a ``time_bucket`` (``hour``, say)."""
    laid = rows.withColumn("day", F.to_date("created_at"))
    return laid if bucket is None else laid.withColumn("time_bucket", F.date_trunc(bucket, "created_at"))


def write_history(rows: DataFrame, path: str) -> None:
    """Append history rows as Parquet by day, clustered and sorted by the history key.

    Rows are partitioned by ranges of (day, key): tasks are of even size however rows are spread over days and
    scopes, and a scope's messages of a day lie in few files, which a lookup finds by their statistics.
    """
    _clustered(rows).write.mode("append").partitionBy("day").parquet(path)


def _clustered(rows: DataFrame) -> DataFrame:
    configure(rows.sparkSession)
    return with_layout(rows).repartitionByRange("day", *KEY).sortWithinPartitions("day", *KEY)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def append_history(incoming: DataFrame, path: str) -> None:
    """Insert-if-absent into the table at ``path``. A repeated run adds nothing.

    Rows without a scope key are no history rows and are not written. Only the stored days that the batch itself holds
    are read, however far apart they lie, and of those the files that reach into the batch's times: a row's day and time
    are part of its key. The batch is worked out once.
    One writer at a time.
    """
    spark = incoming.sparkSession
    rows = first_writer(incoming.filter(F.col("scope_key").isNotNull())).persist()
    try:
        # The days of a batch with its first and last time in each: a calendar bounds their number.
        times = rows.filter(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(
            F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        days = {row["day"]: (row["first"], row["last"]) for row in times.collect()}
        if not days:
            return
        if not _exists(spark, path):
            write_history(rows, path)
            return
        stored = read_history(spark, path).filter(_within(day_ranges(sorted(days)), days))
        write_history(rows.join(stored.select(*KEY), list(KEY), "left_anti"), path)
    finally:
        rows.unpersist()


def day_ranges(days: list[date]) -> list[tuple[date, date]]:
    """Sorted days as runs of days that follow each other."""
    runs: list[tuple[date, date]] = []
    for day in days:
        if runs and day - runs[-1][1] <= timedelta(days=1):
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def _within(runs: list[tuple[date, date]], times: dict[date, tuple[datetime, datetime]] | None = None) -> Column:
    """Rows of the runs of days, given ``times`` only those between the first and the last time of each run. Files of
    other times of those days, of earlier batches say, are skipped by their statistics."""
    test = F.lit(False)
    for first, last in runs:
        inside = F.col("day").between(F.lit(first), F.lit(last))
        if times is not None:
            inside = inside & F.col("created_at").between(F.lit(times[first][0]), F.lit(times[last][1]))
        test = test | inside
    return test


def _exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path, lambda system, target: system.exists(target))


def _file_system(spark: SparkSession, path: str, use: Callable):
    """What ``use`` makes of the file system that holds ``path`` and of the path there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return use(target.getFileSystem(spark._jsc.hadoopConfiguration()), target)


def history(
    rows: DataFrame,
    scope_type: str,
    scope_id: str,
    from_time: datetime | str | None = None,
    to_time: datetime | str | None = None,
    limit: int = 100,
    upper: str = "inclusive",
) -> DataFrame:
    """The first ``limit`` messages of a scope in order of (created_at, message_id).

    Both bounds are optional and inclusive; ``upper="exclusive"`` leaves the upper one out.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    chosen = rows.filter(F.col("scope_key") == f"{scope_type}:{scope_id}")
    if from_time is not None:
        lower = F.lit(from_time).cast("timestamp")
        chosen = _on_days(chosen.filter(F.col("created_at") >= lower), lambda day: day >= F.to_date(lower))
    if to_time is not None:
        until = F.lit(to_time).cast("timestamp")
        within = F.col("created_at") <= until if upper == "inclusive" else F.col("created_at") < until
        chosen = _on_days(chosen.filter(within), lambda day: day <= F.to_date(until))
    return chosen.orderBy("created_at", "message_id").limit(limit)


def _on_days(rows: DataFrame, test) -> DataFrame:
    return rows.filter(test(F.col("day"))) if "day" in rows.columns else rows


def next_page(
    rows: DataFrame, scope_type: str, scope_id: str, after: tuple[datetime | str, str], limit: int = 100
) -> DataFrame:
    """The page after the message ``(created_at, message_id)``; ties in time are neither lost nor repeated."""
    time, message = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
    later = (F.col("created_at") > time) | ((F.col("created_at") == time) & (F.col("message_id") > message))
    return history(rows.filter(later), scope_type, scope_id, from_time=after[0], limit=limit)


def browse(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Any ``limit`` rows."""
    return rows.limit(limit)


def latest_per_scope(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent messages of every scope. Each task keeps at most ``n`` rows per scope."""
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), F.desc("message_id"))
    return rows.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def scope_sizes(rows: DataFrame, wide_rows: int = WIDE_SCOPE_ROWS) -> DataFrame:
    """Rows per scope, wide ones marked."""
    return rows.groupBy("scope_key").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "is_wide", F.col("rows") > wide_rows
    )


def scope_size_distribution(rows: DataFrame, wide_rows: int = WIDE_SCOPE_ROWS) -> DataFrame:
    """How scope sizes are spread, in one row.

    Scopes are counted per size first. Different sizes are few (at most the root of twice the rows), so the
    last step sees a small table.
    """
    sizes = scope_sizes(rows, wide_rows).groupBy("rows", "is_wide").agg(F.count(F.lit(1)).alias("scopes"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return sizes.agg(
        F.sum("scopes").alias("scopes"),
        F.sum(F.col("rows") * F.col("scopes")).alias("total_rows"),
        F.max("rows").alias("max_rows"),
        F.sum(F.when(F.col("is_wide"), F.col("scopes")).otherwise(0)).alias("wide_scopes"),
        *[F.percentile("rows", p, F.col("scopes")).alias(name) for name, p in points.items()],
    )


def time_bucket_sizes(rows: DataFrame, bucket: str = "day") -> DataFrame:
    """Rows per scope and time bucket: the partitions a wide scope would be cut into."""
    return with_layout(rows, bucket).groupBy("scope_key", "time_bucket").agg(F.count(F.lit(1)).alias("rows"))


def retained(rows: DataFrame, before: datetime | str, scope: str | None = None) -> DataFrame:
    """The rows that stay when messages older than ``before`` go, in one scope or in all."""
    keep = F.col("created_at") >= F.lit(before).cast("timestamp")
    return rows.filter(keep if scope is None else keep | (F.col("scope_key") != scope))


def retained_by_age(rows: DataFrame, now: datetime | str, seconds: int = 31_536_000) -> DataFrame:
    """The rows younger than ``seconds`` at ``now``."""
    return rows.filter(
        F.col("created_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    )


def expire_history(spark: SparkSession, path: str, target: str, before: datetime | str) -> None:
    """Write the table at ``path`` without messages older than ``before`` to ``target``.

    Days wholly before it are not even read.
    """
    first_day = F.to_date(F.lit(before).cast("timestamp"))
    rows = read_history(spark, path).filter(F.col("day") >= first_day)
    write_history(retained(rows, before).drop("day"), target)


def delete_before(spark: SparkSession, path: str, before: datetime | str, scope: str | None = None) -> None:
    """Delete the messages older than ``before`` from the table at ``path``, in one scope or in all.

    Days that lose all their rows go as folders, unread where no scope is given. Of the others only those that lose rows
    are written anew, each replaced as a whole when its rows stand, so the files of all other days stay as they are and
    a failed run is run again. One writer at a time; rows without a day stay.
    """
    limit = F.lit(before).cast("timestamp")
    last = spark.range(1).select(F.to_date(limit)).first()[0]
    days = [day for day in stored_days(spark, path) if day <= last]
    gone, cut = [day for day in days if day < last and scope is None], [day for day in days if day == last or scope is not None]
    doomed = F.col("created_at") < limit
    if scope is not None:
        doomed = doomed & (F.col("scope_key") == scope)
    if cut:
        stored = read_history(spark, path).filter(F.col("day").between(F.lit(cut[0]), F.lit(cut[-1])))
        touched = sorted(row[0] for row in stored.filter(doomed).select("day").distinct().collect())
        if touched:
            rows = stored.filter(F.col("day").isin(touched))
            kept = rows.filter(~F.coalesce(doomed, F.lit(False)))
            left = {row[0] for row in kept.select("day").distinct().collect()}
            if left:
                _clustered(kept.drop("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                    "day").parquet(path)
            gone += [day for day in touched if day not in left]
    for day in gone:
        _file_system(spark, f"{path.rstrip('/')}/day={day}", lambda system, folder: system.delete(folder, True))


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days of the table at ``path``, by its folders."""
    names = _file_system(spark, path, lambda system, folder: [
        one.getPath().getName() for one in system.listStatus(folder)] if system.exists(folder) else [])
    days = (name.removeprefix("day=") for name in names if name.startswith("day="))
    return sorted(date.fromisoformat(day) for day in days if day[:1].isdigit())


def by_message_id(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """The projection for lookups by message id; ``id_bucket`` is its partition column."""
    bucket = F.pmod(F.conv(F.substring(F.md5("message_id"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return rows.select("message_id", "scope_key", "created_at", "sender_id", "text", bucket.alias("id_bucket"))


def write_by_message_id(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Add rows to the projection at ``path``; an id that is stored already is not stored again. One writer at a time."""
    order = Window.partitionBy("id_bucket", "message_id").orderBy("created_at", "scope_key", "text")
    fresh = (
        by_message_id(rows, buckets).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")
    )
    if _exists(rows.sparkSession, path):
        stored = rows.sparkSession.read.schema(fresh.schema).parquet(path).select("id_bucket", "message_id")
        fresh = fresh.join(stored, ["id_bucket", "message_id"], "left_anti")
    (
        fresh.repartitionByRange("id_bucket", "message_id").sortWithinPartitions("id_bucket", "message_id")
        .write.mode("append").partitionBy("id_bucket").parquet(path)
    )


def find_message(table: DataFrame, message_id: str, buckets: int = 256) -> DataFrame:
    """One message from the projection; only its bucket is read."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.lit(message_id)), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    return table.filter((F.col("id_bucket") == bucket.cast("int")) & (F.col("message_id") == message_id))


def pending(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """The items whose (module_name, migration_id) is not in the ledger, in order."""
    return items.join(ledger, ["module_name", "migration_id"], "left_anti").orderBy("module_name", "migration_id")
