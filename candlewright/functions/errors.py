"""Error text to type, severity and retryability."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings by error type, tested in this order.
PATTERNS = {
    "network": ["connection refused", "connection reset", "connection timeout",
                "connection aborted", "no route to host", "host unreachable",
                "network unreachable", "dns", "resolve"],
    "timeout": ["timeout", "deadline exceeded", "context canceled"],
    "rate_limit": ["rate limit", "too many requests", "quota exceeded"],
    "authentication": ["unauthorized", "forbidden", "authentication", "invalid credentials"],
    "validation": ["validation", "invalid", "malformed", "parse"],
    "configuration": ["config", "missing required", "not configured"],
    "server_error": ["server error", "internal server", "service unavailable"],
    "panic": ["panic", "runtime error"],
}
# Severities other than medium.
TYPE_SEVERITY = {
    "panic": "critical", "fatal": "critical",
    "authentication": "high", "configuration": "high",
    "network": "low", "timeout": "low", "rate_limit": "low",
}
# Types that must not be retried.
NOT_RETRYABLE = ["authentication", "bad_request", "validation", "configuration", "fatal", "panic"]
# The coarser categories used for monitoring, tested in this order.
CATEGORIES = {
    "timeout": ["timeout"],
    "network": ["network", "connection"],
    "context": ["context canceled", "context deadline"],
    "auth": ["authentication", "unauthorized"],
    "rate_limit": ["rate limit"],
}


def _first_match(text: Column, table: dict, default: str) -> Column:
    out = F.lit(default)
    for name, needles in reversed(list(table.items())):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        out = F.when(hit, name).otherwise(out)
    return out


def error_type(message: Column) -> Column:
    return _first_match(F.lower(message), PATTERNS, "unknown")


def error_severity(kind: Column) -> Column:
    out = F.lit("medium")
    for name, severity in TYPE_SEVERITY.items():
        out = F.when(kind == name, severity).otherwise(out)
    return out


def is_retryable(kind: Column) -> Column:
    return ~kind.isin(NOT_RETRYABLE)


def error_category(message: Column) -> Column:
    return F.when(message.isNull(), "none").otherwise(
        _first_match(F.lower(message), CATEGORIES, "unknown"))
