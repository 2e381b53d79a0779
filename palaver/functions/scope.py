"""Scope types and composite scope keys."""

from pyspark.sql import Column, functions as F

from palaver.functions.text import is_blank

CHANNEL = "Channel"
DIRECT_MESSAGE = "DirectMessage"

# The accepted spellings of each scope type on the wire.
SPELLINGS = {
    CHANNEL: ("0", "Channel", "CHANNEL"),
    DIRECT_MESSAGE: ("1", "DirectMessage", "DIRECT_MESSAGE"),
}


def normalize_scope_type(value: Column) -> Column:
    """``Channel`` or ``DirectMessage``; null for any other spelling."""
    text = value.cast("string")
    return F.when(text.isin(*SPELLINGS[CHANNEL]), CHANNEL).when(text.isin(*SPELLINGS[DIRECT_MESSAGE]), DIRECT_MESSAGE)


def scope_key(scope_type: Column, scope_id: Column) -> Column:
    """``type:id``; null when the id is blank or the type is missing."""
    return F.when(~is_blank(scope_id), F.concat(scope_type, F.lit(":"), scope_id))


def parse_scope_key(key: Column) -> Column:
    """Split at the first colon into ``(scope_type, scope_id, error)``.

    ``error`` is null for a valid key, else ``blank``, ``format``, ``scope_type`` or ``scope_id``.
    """
    colon = F.instr(key, ":")
    kind = normalize_scope_type(F.substring_index(key, ":", 1))
    rest = F.substr(key, colon + F.lit(1))
    error = (
        F.when(is_blank(key), "blank")
        .when((colon <= 1) | (colon == F.char_length(key)), "format")
        .when(kind.isNull(), "scope_type")
        .when(is_blank(rest), "scope_id")
    )
    return F.struct(
        F.when(error.isNull(), kind).alias("scope_type"),
        F.when(error.isNull(), rest).alias("scope_id"),
        error.alias("error"),
    )


def parse_scope_key_leniently(key: Column) -> Column:
    """The alert rule: no colon means a channel of that name, no key means ``unknown``."""
    text = F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key)
    colon = F.instr(text, ":")
    return F.struct(
        F.when(colon > 0, normalize_scope_type(F.substring_index(text, ":", 1))).otherwise(CHANNEL).alias("scope_type"),
        F.when(colon > 0, F.substr(text, colon + F.lit(1))).otherwise(text).alias("scope_id"),
    )
