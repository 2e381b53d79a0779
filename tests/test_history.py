import pytest
from pyspark.sql import functions as F

from palaver.operators import history as h
from conftest import at


def with_broker(events, start=0):
    number = F.substring("message_id", 2, 4).cast("long")
    return events.withColumn("partition", F.lit(0)).withColumn("offset", number + start)


def ids(rows):
    return [r.message_id for r in rows.collect()]


@pytest.fixture
def rows(chat):
    return h.to_history(chat([("a", "s", n // 2) for n in range(10)] + [("a", "t", 3), ("a", "s", 3, "x", "DirectMessage")]))


def test_four_shapes_of_lookup(rows):
    assert ids(h.history(rows, "Channel", "s", limit=3)) == ["m0000", "m0001", "m0002"]
    assert ids(h.history(rows, "Channel", "s", from_time=at(3))) == ["m0006", "m0007", "m0008", "m0009"]
    assert ids(h.history(rows, "Channel", "s", to_time=at(0))) == ["m0000", "m0001"]
    assert ids(h.history(rows, "Channel", "s", at(1), at(2))) == ["m0002", "m0003", "m0004", "m0005"]
    assert ids(h.history(rows, "Channel", "s", at(1), at(2), upper="exclusive")) == ["m0002", "m0003"]
    assert ids(h.history(rows, "DirectMessage", "s")) == ["m0011"]
    with pytest.raises(ValueError):
        h.history(rows, "Channel", "s", limit=0)


def test_pages_meet_without_loss_at_ties(rows):
    seen, page = [], h.history(rows, "Channel", "s", limit=3).collect()
    while page:
        seen += [r.message_id for r in page]
        page = h.next_page(rows, "Channel", "s", (page[-1].created_at, page[-1].message_id), 3).collect()
    assert seen == [f"m{n:04d}" for n in range(10)]


def test_lookup_is_a_top_k(rows):
    plan = h.history(rows, "Channel", "s", limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_per_scope(rows):
    found = h.latest_per_scope(rows, 2)
    assert {(r.scope_key, r.message_id) for r in found.collect()} == {
        ("Channel:s", "m0009"), ("Channel:s", "m0008"), ("Channel:t", "m0010"), ("DirectMessage:s", "m0011")}
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()


def test_first_writer_and_repeats(spark, chat, tmp_path):
    path = str(tmp_path / "history")
    events = with_broker(chat([("a", "s", n, f"first {n}") for n in range(6)]))
    copies = with_broker(events.withColumn("text", F.lit("again")).drop("partition", "offset"), 100)
    h.append_history(h.to_history(copies.unionByName(events)), path)
    stored = h.read_history(spark, path)
    assert sorted(r.text for r in stored.collect()) == [f"first {n}" for n in range(6)]
    h.append_history(h.to_history(copies), path)
    assert h.read_history(spark, path).count() == 6
    later = with_broker(chat([("a", "s", 100_000, "next day")]))
    h.append_history(h.to_history(later), path)
    h.append_history(h.to_history(later), path)
    assert h.read_history(spark, path).count() == 7
    h.append_history(h.to_history(later).filter("false"), path)
    day = h.history(h.read_history(spark, path), "Channel", "s", from_time=at(90_000))
    assert [r.text for r in day.collect()] == ["next day"]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(scope_key,Channel:s)" in plan


def test_empty_first_batch_is_no_table(spark, chat, tmp_path):
    h.append_history(h.to_history(chat([])), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_events_come_back(chat):
    events = chat([("a", "x:y", 0, "hi", "DirectMessage")])
    back = h.from_history(h.to_history(events)).drop("broker_partition", "broker_offset")
    assert back.select(events.columns).collect() == events.collect()


def test_distinct_messages(chat):
    events = chat([("a", "s", 1), ("a", "s", 2)])
    copies = events.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    assert sorted(h.distinct_messages(copies.unionByName(events)).collect()) == sorted(events.collect())


def test_sizes(rows):
    sizes = {r.scope_key: (r.rows, r.is_wide) for r in h.scope_sizes(rows, 5).collect()}
    assert sizes == {"Channel:s": (10, True), "Channel:t": (1, False), "DirectMessage:s": (1, False)}
    spread = h.scope_size_distribution(rows, 5).first()
    assert (spread.scopes, spread.total_rows, spread.max_rows, spread.wide_scopes, spread.p50) == (3, 12, 10, 1, 1.0)
    assert {r.rows for r in h.time_bucket_sizes(rows, "minute").collect()} == {10, 1}


def test_retention(spark, rows, chat, tmp_path):
    assert h.retained(rows, at(3)).count() == 6
    assert h.retained(rows, at(3), scope="Channel:s").count() == 6
    assert h.retained(rows, at(100), scope="Channel:s").count() == 2
    assert h.retained_by_age(rows, at(4), 2).count() == 6
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    h.write_history(h.to_history(chat([("a", "s", n * 40_000) for n in range(6)])), source)
    h.expire_history(spark, source, target, at(80_000))
    kept = h.read_history(spark, target)
    assert kept.count() == 4 and kept.select("day").distinct().count() == 2


def files(folder):
    return {str(one.relative_to(folder)) for one in folder.rglob("*.parquet")}


def test_delete_before_leaves_other_days_alone(spark, chat, tmp_path):
    path = tmp_path / "stored"
    rows = h.to_history(chat([(f"u{n}", ("s", "t")[n % 2], n * 20_000) for n in range(24)]))
    h.write_history(rows, str(path))
    before = files(path)
    days = sorted({name.split("/")[0] for name in before})
    assert len(days) == 6
    h.delete_before(spark, str(path), at(2 * 86_400))
    after, kept = files(path), h.read_history(spark, str(path)).drop("day")
    assert sorted(kept.collect()) == sorted(h.retained(rows, at(2 * 86_400)).collect())
    cut = {name.split("/")[0] for name in before ^ after}
    assert cut == set(days[:3]) and {name.split("/")[0] for name in after} == set(days[2:])
    h.delete_before(spark, str(path), at(3 * 86_400), "Channel:s")
    scoped = files(path)
    assert {name.split("/")[0] for name in after ^ scoped} == set(days[2:4])
    expected = h.retained(h.retained(rows, at(2 * 86_400)), at(3 * 86_400), "Channel:s")
    assert sorted(h.read_history(spark, str(path)).drop("day").collect()) == sorted(expected.collect())
    h.delete_before(spark, str(path), at(3 * 86_400), "Channel:s")
    assert files(path) == scoped
    h.delete_before(spark, str(path), at(30 * 86_400), "Channel:s")
    h.delete_before(spark, str(path), at(30 * 86_400))
    assert files(path) == set() and h.stored_days(spark, str(path)) == []
    h.delete_before(spark, str(tmp_path / "nothing"), at(0))


def test_append_skips_files_of_other_times(spark, chat, tmp_path):
    """The stored side of the anti-join is read between the batch's first and last time of a day only."""
    path = str(tmp_path / "stored")
    rows = h.to_history(chat([("a", f"s{n % 7}", n * 60) for n in range(400)]))
    for part in range(4):
        h.append_history(rows.filter(F.floor((F.unix_timestamp("created_at") - F.lit(int(at(0).timestamp()))) / 6_000) == part), path)
    assert sorted(h.read_history(spark, path).drop("day").collect()) == sorted(rows.collect())
    stored = h.read_history(spark, path)
    days = {at(0).date(): (at(18_000), at(18_060))}
    chosen = stored.filter(h._within(h.day_ranges(sorted(days)), days)).select(*h.KEY)
    assert len(chosen.collect()) == 2
    scan = chosen._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 100 < stored.filter(F.col("day") == F.lit(at(0).date())).count()


def test_by_message_id(spark, rows, tmp_path):
    path = str(tmp_path / "ids")
    h.write_by_message_id(rows, path, 8)
    found = h.find_message(spark.read.parquet(path), "m0010", 8)
    assert [r.scope_key for r in found.collect()] == ["Channel:t"]
    assert "PartitionFilters: [isnotnull(id_bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_pending(spark):
    columns = "module_name string, migration_id string"
    items = spark.createDataFrame([("Users", "0001"), ("Chat", "0002"), ("Chat", "0001")], columns)
    ledger = spark.createDataFrame([("Chat", "0001"), ("Old", "0009")], columns)
    assert [tuple(r) for r in h.pending(items, ledger).collect()] == [("Chat", "0002"), ("Users", "0001")]


def test_blank_scopes_are_not_stored(spark, chat, tmp_path):
    path = str(tmp_path / "blank")
    for _ in range(3):
        h.append_history(h.to_history(chat([("a", "s", 1), ("a", " ", 2)])), path)
    assert ids(h.read_history(spark, path)) == ["m0000"]


def test_only_the_days_of_the_batch_are_read():
    days = [at(86_400 * n).date() for n in (0, 1, 2, 400, 800, 801)]
    assert h.day_ranges(days) == [(days[0], days[2]), (days[3], days[3]), (days[4], days[5])]


def test_an_outlier_prunes_the_days_between(spark, chat, tmp_path):
    path = str(tmp_path / "days")
    h.append_history(h.to_history(chat([("a", "s", 86_400 * n) for n in range(6)])), path)
    stored = h.read_history(spark, path).filter(h._within(h.day_ranges([at(0).date(), at(86_400 * 5).date()])))
    assert len({f for f in stored.inputFiles()}) >= 1 and stored.count() == 2
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    h.append_history(h.to_history(chat([("a", "s", 0, "again"), ("b", "s", 86_400 * 5.5), ("b", "s", 86_400 * 5.5)])), path)
    assert h.read_history(spark, path).count() == 8


def test_projection_by_message_id_is_written_once(spark, rows, tmp_path):
    path = str(tmp_path / "ids")
    for _ in range(2):
        h.write_by_message_id(rows, path, buckets=4)
    assert spark.read.parquet(path).count() == rows.count()
