"""Instants as text, and lengths of time in seconds."""

from pyspark.sql import Column, functions as F


def iso_seconds(ts: Column) -> Column:
    """``2026-01-15T10:30:00Z``: the output format of windows, fractions dropped."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def index_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy.MM.dd")


def seconds_text(seconds: int) -> str:
    """A length of time in the form ``window`` takes."""
    return f"{seconds} seconds"


def time_bucket(ts: Column, seconds: int) -> Column:
    """Number of the epoch-aligned bucket an instant falls in."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def add_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds))
