import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palaver.schemas import CHAT_EVENT  # noqa: E402

START = datetime(2026, 1, 15, 10, 30, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("palaver-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


@pytest.fixture
def chat(spark):
    """Builds chat events from (sender, scope id, seconds[, text[, scope type]])."""
    def build(rows):
        full = []
        for number, (sender, scope, seconds, *rest) in enumerate(rows):
            text = rest[0] if rest else "hello"
            kind = rest[1] if len(rest) > 1 else "Channel"
            full.append((f"m{number:04d}", kind, scope, sender, text, at(seconds), "pod-1"))
        return spark.createDataFrame(full, CHAT_EVENT)

    return build
