"""Identifiers that come out the same when a job is replayed."""

from pyspark.sql import Column, functions as F

CORRELATION_PATTERN = r"(?i)^corr_[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id computed from the row's key."""
    digest = F.md5(F.concat_ws("~", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def clean_correlation_id(given: Column, *row_key: Column) -> Column:
    """A valid id in lower case, else a new one made from ``row_key``."""
    return F.when(given.rlike(CORRELATION_PATTERN), F.lower(given)).otherwise(
        F.concat(F.lit("corr_"), stable_uuid(*row_key))
    )


def resolve_user_id(sub: Column, user_id: Column, connection_id: Column) -> Column:
    return F.coalesce(sub, user_id, F.concat(F.lit("anon_"), connection_id))


def resolve_user_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("anonymous"))


def broker_partition(scope_id: Column, partitions: int) -> Column:
    """The partition of a message key: a hash of the scope id modulo the partition count."""
    prefix = F.conv(F.substring(F.md5(scope_id), 1, 8), 16, 10).cast("long")
    return F.pmod(prefix, F.lit(partitions)).cast("int")
