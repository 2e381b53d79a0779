"""HTTP status and retry class of a logged exception."""

from functools import reduce

from pyspark.sql import Column, functions as F

from palaver.functions.text import contains_ignoring_case

# Status, title, public detail text and RFC 7231 section by exception type.
STATUS_BY_EXCEPTION = {
    "UnauthorizedAccessException": 401,
    "KeyNotFoundException": 404,
    "InvalidOperationException": 409,
    "TimeoutException": 504,
    "ArgumentNullException": 400,
    "ArgumentException": 400,
}
# Standard subclasses count as what they derive from.
SUBCLASSES = {
    "ObjectDisposedException": "InvalidOperationException",
    "ArgumentOutOfRangeException": "ArgumentException",
    "DecoderFallbackException": "ArgumentException",
    "EncoderFallbackException": "ArgumentException",
    "CultureNotFoundException": "ArgumentException",
    "DuplicateWaitObjectException": "ArgumentException",
    "InvalidEnumArgumentException": "ArgumentException",
}
DEFAULT_STATUS = 500
TITLE = {
    400: "Bad Request",
    401: "Unauthorized",
    404: "Not Found",
    409: "Conflict",
    500: "Internal Server Error",
    504: "Gateway Timeout",
}
DETAIL = {
    400: "The request was invalid or missing required parameters.",
    401: "Authentication is required to access this resource.",
    404: "The requested resource was not found.",
    409: "The request could not be completed due to a conflict.",
    500: "An error occurred while processing your request. Please try again later.",
    504: "The request timed out while processing.",
}
RFC_SECTION = {400: "6.5.1", 401: "6.5.2", 404: "6.5.4", 409: "6.5.8", 500: "6.6.1", 504: "6.6.5"}

# Message parts that mark a database error worth another try.
TRANSIENT_MESSAGES = ("No host available", "Query timeout", "Connection")


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def exception_name(logged: Column) -> Column:
    """The bare type name out of what logs hold: a name, a full name, or either with a message and a trace behind it.
    A subclass gives the name of its class."""
    name = F.regexp_extract(logged, r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*[.+])*([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.coalesce(_lookup(name, SUBCLASSES), name)


def status_of_exception(exception_type: Column, message: Column | None = None) -> Column:
    """Status, title, detail, RFC section, server-error mark and log level of an exception type.

    With ``message`` (development) the detail is the exception's own text instead of the public one.
    """
    status = F.coalesce(_lookup(exception_name(exception_type), STATUS_BY_EXCEPTION), F.lit(DEFAULT_STATUS))
    return F.struct(
        status.alias("status"),
        _lookup(status, TITLE).alias("title"),
        (_lookup(status, DETAIL) if message is None else message).alias("detail"),
        _lookup(status, RFC_SECTION).alias("rfc_section"),
        (status >= 500).alias("is_server_error"),
        F.when(status >= 500, "Error").otherwise("Warning").alias("log_level"),
    )


def is_transient_error(exception_type: Column, message: Column, inner_message: Column) -> Column:
    """Timeouts, and errors whose own or inner message names a lost host, slow query or connection."""
    tests = [contains_ignoring_case(text, part) for text in (message, inner_message) for part in TRANSIENT_MESSAGES]
    return reduce(lambda a, b: a | b, tests, F.coalesce(exception_name(exception_type) == "TimeoutException", F.lit(False)))
