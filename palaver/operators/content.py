"""What is said: words and emoji per scope and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palaver.functions.times import seconds_text
from palaver.operators.analytics import check_window

# Emoji blocks and symbols that show as pictures.
EMOJI_PATTERN = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1FAFF}\x{2600}-\x{27BF}]"


def _counted(events: DataFrame, window_seconds: int, items, name: str, total: str) -> DataFrame:
    check_window(window_seconds)
    window = F.window("created_at", seconds_text(window_seconds)).alias("window")
    return (
        events.select(window, "scope_type", "scope_id", F.explode(items).alias(name))
        .filter(F.col(name) != "")
        .groupBy("window", "scope_type", "scope_id", name)
        .agg(F.count(F.lit(1)).alias(total))
        .select("scope_type", "scope_id", F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), name, total)
    )


def word_frequency(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Occurrences of each word (letters and digits, lower case) per scope and window."""
    return _counted(events, window_seconds, F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "word", "occurrences")


def emoji_counts(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Occurrences of each emoji per scope and window."""
    found = F.regexp_extract_all("text", F.lit(f"({EMOJI_PATTERN})"), F.lit(1))
    return _counted(events, window_seconds, found, "emoji", "occurrences")
