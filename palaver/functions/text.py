"""Text measures with UTF-16 lengths and Unicode white space."""

from pyspark.sql import Column, functions as F

# Matches at the first character that is no white space.
SOLID_PATTERN = r"[^\t\n\x0B\f\r\x{85}\p{Z}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    characters = F.char_length(text)
    encoded = F.octet_length(F.encode(F.make_valid_utf8(text), "UTF-16BE"))
    return F.when(F.octet_length(text) == characters, characters).otherwise(F.shiftright(encoded, 1))


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(text.rlike(SOLID_PATTERN), F.lit(False))


def preview_bytes(payload: Column, limit: int = 256) -> Column:
    """The first ``limit`` bytes as text; a character cut in two becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(payload, 1, limit).cast("string"))
    return F.concat(head, F.when(F.octet_length(payload) > limit, "...").otherwise(""))


def preview_characters(payload: Column, limit: int = 256) -> Column:
    """The first ``limit`` characters, ``<empty>`` where there is no payload."""
    text = F.make_valid_utf8(payload.cast("string"))
    cut = F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "<empty>").otherwise(cut)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))
