"""Byte-range requests as columns: checking responses, classifying failures, retrying, storing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_INTEGER = (1 << 53) - 1
RETRY_DELAY_MS = 75
ATTEMPTS = 3


def valid_range(begin: Column, end: Column) -> Column:
    """Half-open and within what a double counts exactly."""
    return (begin >= 0) & (end > begin) & (end <= SAFE_INTEGER)


def content_range(header: Column) -> dict[str, Column]:
    """first, last and total of ``bytes a-b/total``; total is null for ``*``."""
    pattern = r"^\s*bytes\s+(\d+)-(\d+)/(\d+|\*)\s*$"
    part = lambda i: F.regexp_extract(header, pattern, i).try_cast("bigint")
    return {"first": part(1), "last": part(2), "total": part(3)}


def response_error(status: Column, header: Column, length: Column, begin: Column, end: Column, check_total: bool = True) -> Column:
    """Null for a good partial response, else what is wrong with it.

    A total below the end of the range is wrong too, unless ``check_total`` is off: for logs whose total isn't the file's.
    """
    r = content_range(header)
    matches = (r["first"] == begin) & (r["last"] == end - 1)
    if check_total:
        matches = matches & (r["total"].isNull() | (r["total"] >= end))
    return F.when(~valid_range(begin, end), "invalid-range").when(status.isNull(), "network").when(status != 206, "http-status").when(~F.coalesce(matches, F.lit(False)), "content-range").when(length != end - begin, "body-length")


def retriable(error: Column, status: Column) -> Column:
    """Network trouble, throttling, server faults and short bodies may pass; the rest won't."""
    server = (error == "http-status") & ((status == 429) | (status >= 500))
    return F.coalesce(error.isin("network", "body-length") | server, F.lit(False))


def retry_delay(attempt: Column) -> Column:
    return F.when(attempt < ATTEMPTS, attempt * RETRY_DELAY_MS)


def strong_etag(etag: Column) -> Column:
    return F.coalesce(F.trim(etag).rlike(r'^"[^"]*"$'), F.lit(False))


def forbids_store(cache_control: Column) -> Column:
    """Whether a no-store token stands in the header."""
    return F.coalesce(F.exists(F.split(F.lower(cache_control), ","), lambda t: F.trim(F.split(t, "=")[0]) == "no-store"), F.lit(False))


def step_outcome(failed: Column, network: Column, slow: Column) -> Column:
    return F.when(failed & network, "network").when(failed, "environment").when(slow, "timeout").otherwise("pass")
