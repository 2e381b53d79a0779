import pytest

from palaver.operators import logs
from palaver.schemas import SHIPPED_LOG
from palaver.sources.sinks import write_log_indices
from conftest import at


@pytest.fixture
def lines(spark):
    def build(rows):
        base = dict(ts=at(0), level="Information", message="m", correlation_id=None, context={}, exception=None,
                    machine_name="pod-1", application="chat", pod_name="pod-1", container_name=None, labels=None)
        return spark.createDataFrame([tuple({**base, **row}[f.name] for f in SHIPPED_LOG.fields) for row in rows],
                                     SHIPPED_LOG)

    return build


@pytest.mark.parametrize("row, kind, app", [
    ({"labels": {"app.kubernetes.io/component": "api"}, "container_name": "chat-api"}, "app", "chat-api"),
    ({"container_name": "my-chat-api-1"}, "duplicate_to_drop", "my-chat-api-1"),
    ({"container_name": "history-consumer"}, "app", "history-consumer"),
    ({"container_name": "frontend", "labels": {"app_kubernetes_io_name": "web"}}, "app", "web"),
    ({"container_name": "redis", "labels": {"app_kubernetes_io/component": "db"}}, "system", "redis"),
    ({"labels": {"app_kubernetes_io/name": "", "app.kubernetes.io/name": "x"}}, "system", "x"),
    ({"pod_name": None}, "system", None),
])
def test_classes(lines, row, kind, app):
    found = logs.classify_log(lines([row])).first()
    assert (found.log_type, found.app_name) == (kind, app)


def test_route_and_write(spark, lines, tmp_path):
    rows = logs.classify_log(lines([{"container_name": c} for c in ("chat-api", "worker", "redis")]))
    routed = logs.route_logs(logs.drop_duplicated_logs(rows))
    assert sorted(r.index_name for r in routed.collect()) == ["logs-2026.01.15", "system-logs-2026.01.15"]
    write_log_indices(routed, str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    assert stored.filter("log_type = 'app'").count() == 1 and stored.count() == 2


def test_search(lines):
    rows = lines([
        {"level": "Error", "message": "Kafka down", "context": {"ScopeId": "general", "OriginPodId": "p1"}},
        {"level": "Error", "message": "other", "context": {"ScopeId": "random"}, "correlation_id": "corr_1"},
        {"message": "kafka up"},
    ])
    count = lambda **terms: logs.search_logs(rows, **terms).count()
    assert count() == 3 and count(level="Error") == 2 and count(message_contains="KAFKA") == 2
    assert count(level="Error", scope="general") == 1 and count(pod="p1") == 1 and count(correlation_id="corr_1") == 1
    assert count(level="Information", message_contains="kafka", scope="general") == 0


def test_recent_levels_and_series(lines):
    rows = lines([{"ts": at(n), "level": "Error" if n % 2 else "Warning", "machine_name": f"pod-{n % 3}"} for n in range(12)])
    assert [r.ts.second for r in logs.recent_logs(rows, 2).collect()] == [11, 10]
    assert {(r.level, r.lines) for r in logs.log_levels(rows).collect()} == {("Error", 6), ("Warning", 6)}
    wide = {r.level: (r["pod-0"], r["pod-1"], r["pod-2"]) for r in
            logs.log_levels_by_series(rows, "machine_name", ["pod-0", "pod-1", "pod-2"]).collect()}
    assert wide == {"Error": (2, 2, 2), "Warning": (2, 2, 2)}


def test_latency_alert(spark):
    rows = spark.createDataFrame([("slow", float(n)) for n in range(1, 202)] + [("fast", 1.0)], "pod string, ms double")
    found = {r.pod: (r.p50, r.p95, r.alert) for r in logs.latency_summary(rows, "ms", ("pod",)).collect()}
    assert found == {"slow": (101.0, 191.0, True), "fast": (1.0, 1.0, False)}
    near = {r.pod: r.alert for r in logs.latency_summary(rows, "ms", ("pod",), approximate=True).collect()}
    assert near == {"slow": True, "fast": False}
