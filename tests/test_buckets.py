import pytest
from pyspark.sql import functions as F

from palaver.operators import buckets as b, history as h
from palaver.streaming.pipelines import start_bucket_writer
from conftest import at

WIDTHS = (86_400, 3_600, 600)


@pytest.fixture
def rows(chat):
    # A busy scope, a message a minute for ten hours; a quiet one; one busy for a single minute.
    return h.to_history(chat(
        [("a", "busy", 60 * n) for n in range(600)] + [("a", "quiet", 7200 * n) for n in range(5)] + [("a", "burst", 9)] * 40))


def keys(frame):
    return sorted((r.scope_key, r.created_at, r.message_id) for r in frame.collect())


def files(frame):
    return {name.split("/rows/")[1] for name in frame.inputFiles()}


def test_widths_follow_the_rows(rows):
    found = {r.scope_key: (r.bucket_seconds, r.rows, r.largest) for r in b.bucket_widths(rows, 20, WIDTHS).collect()}
    assert found == {"Channel:busy": (600, 600, 10), "Channel:quiet": (86_400, 5, 5), "Channel:burst": (600, 40, 40)}
    found = {r.scope_key: r.bucket_seconds for r in b.bucket_widths(rows, 60, WIDTHS).collect()}
    assert found == {"Channel:busy": 3600, "Channel:quiet": 86_400, "Channel:burst": 86_400}
    for wrong in ((), (600, 3600), (3600, 700), (600, 0)):
        with pytest.raises(ValueError):
            b.check_widths(wrong)


def test_catalogue_has_the_wide_scopes_alone(rows):
    found = b.wide_buckets(rows, 60, WIDTHS).collect()
    assert {r.scope_key for r in found} == {"Channel:busy"} and sum(r.rows for r in found) == 600
    assert all(r.bucket_start % 3600 == 0 and r.rows <= 60 for r in found)


def test_writes_are_done_once_and_add_what_is_new(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    early = rows.filter(F.col("created_at") < F.lit(at(7200)))
    assert b.read_buckets(spark, path).count() == 0
    assert b.append_buckets(early, path, "w1", 20, WIDTHS)
    assert not b.append_buckets(rows, path, "w1", 20, WIDTHS)
    assert keys(b.read_buckets(spark, path)) == keys(early)
    assert b.append_buckets(rows.unionByName(rows), path, "w2", 60, WIDTHS)
    assert b.append_buckets(rows.limit(0), path, "w3")
    assert keys(b.read_buckets(spark, path)) == keys(rows)
    assert b.compact_buckets(spark, path, "c1", 60, WIDTHS) and not b.compact_buckets(spark, path, "c1", 60, WIDTHS)
    assert b.remove_replaced(spark, path) == ["w1", "w2", "w3"]
    assert keys(b.read_buckets(spark, path)) == keys(rows)
    widths = {(r.scope_key, r.bucket_seconds) for r in b.read_buckets(spark, path).collect()}
    assert widths == {("Channel:busy", 3600), ("Channel:quiet", 86_400), ("Channel:burst", 86_400)}
    assert not b.append_buckets(rows, path, "w2") and b.append_buckets(rows, path, "w4", 20, WIDTHS)
    assert keys(b.read_buckets(spark, path)) == keys(rows)
    with pytest.raises(ValueError):
        b.append_buckets(rows, path, "a/b")


def test_unfinished_writes_do_not_show(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    b.append_buckets(rows.filter("scope_key = 'Channel:quiet'"), path, "w1", 20, WIDTHS)
    (tmp_path / "t" / "lost").mkdir()
    b._store(rows, path, "w2", [], 20, WIDTHS)
    (tmp_path / "t" / "commits" / "write_id=w2").rename(tmp_path / "t" / "lost" / "w2")
    assert b.read_buckets(spark, path).count() == 5
    assert b.find_history(spark, path, "Channel", "busy").count() == 0
    assert b.append_buckets(rows, path, "w2", 60, WIDTHS)
    assert keys(b.read_buckets(spark, path)) == keys(rows)


def test_lookups_equal_those_of_the_plain_history(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    b.append_buckets(rows.filter(F.col("created_at") < F.lit(at(9000))), path, "w1", 20, WIDTHS)
    b.append_buckets(rows, path, "w2", 60, WIDTHS)
    for scope in ("busy", "quiet", "burst", "none"):
        for bounds in ({}, {"from_time": at(3599.5)}, {"to_time": at(8000)}, {"from_time": at(600), "to_time": at(20_000)},
                       {"to_time": at(7200), "upper": "exclusive"}):
            for limit in (25, 1000):
                want = h.history(rows, "Channel", scope, limit=limit, **bounds)
                found = b.find_history(spark, path, "Channel", scope, limit=limit, **bounds)
                assert found.select(*want.columns).collect() == want.collect()
    seen, after = [], (at(-1), "")
    while page := b.find_history(spark, path, "Channel", "burst", limit=7, after=after).collect():
        seen += [r.message_id for r in page]
        after = (page[-1].created_at, page[-1].message_id)
    assert seen == [f"m{n:04d}" for n in range(605, 645)]


def test_lookups_read_only_the_buckets_they_need(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    b.append_buckets(rows, path, "w1", 60, WIDTHS)

    def read(**options):
        plan = b.find_history(spark, path, "Channel", "busy", **options)
        scan = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
        plan.collect()
        return scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters()).size()

    # The busy scope lies in eleven folders of an hour, the others in that of the day, which is always read.
    assert read(limit=1000) == 12
    # 30, 60 and 60 messages are enough for a hundred.
    assert read(limit=100) == 4
    assert read(limit=30) == 2
    assert read(from_time=at(7200), to_time=at(7300)) == 2
    catalogue = b._finished(spark, path, "buckets", b._BUCKETS, b._commits(spark, path)).filter("scope_key = 'Channel:busy'")
    widths, until = b._reach(catalogue, F.lit(True), 30)
    # 10:30 to 11:00 holds 30 messages, so nothing from 11:00 on is read.
    assert widths == [3600] and until == int(at(1800).timestamp())
    assert b._reach(catalogue, F.lit(True), 31)[1] == int(at(5400).timestamp())
    assert b._reach(catalogue, F.lit(True), 601)[1] is None


def test_rows_without_key_or_time(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    odd = rows.limit(1).select(*[F.lit(None).alias(c) if c == "created_at" else F.col(c) for c in rows.columns])
    odd = odd.unionByName(rows.limit(2).withColumn("scope_key", F.lit(None).cast("string")))
    for write in ("w1", "w2"):
        b.append_buckets(odd, path, write)
    (row,) = b.read_buckets(spark, path).collect()
    assert row.created_at is None and row.bucket_start is None
    assert b.find_history(spark, path, *row.scope_key.split(":")).count() == 1
    assert b.find_history(spark, path, *row.scope_key.split(":"), from_time=at(0)).count() == 0


def test_a_batch_that_fails_after_its_write_adds_nothing_twice(spark, rows, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    rows.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    append, calls = b.append_buckets, []

    def fails_once(*args, **options):
        done = append(*args, **options)
        calls.append(done)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")
        return done

    monkeypatch.setattr("palaver.streaming.pipelines.append_buckets", fails_once)
    with pytest.raises(Exception, match="lost after the write"):
        start_bucket_writer(stream, path, str(tmp_path / "c"), "job").awaitTermination()
    start_bucket_writer(stream, path, str(tmp_path / "c"), "job").awaitTermination()
    assert calls == [True, False, True]
    assert keys(b.read_buckets(spark, path)) == keys(rows)
