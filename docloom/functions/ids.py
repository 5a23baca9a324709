"""Content hashes, keys and time arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def citation_key(path: Column, start: Column, end: Column) -> Column:
    def text(line: Column) -> Column:
        return F.coalesce(line.cast("string"), F.lit(""))

    return F.sha2(F.concat_ws(":", path, text(start), text(end)), 256)


def client_key(address: Column, user_agent: Column) -> Column:
    agent = F.coalesce(F.substring(user_agent, 1, 200), F.lit("unknown"))
    return F.sha2(F.concat(F.coalesce(address, F.lit("unknown")), F.lit("\n"), agent), 256)


def positive(line: Column) -> Column:
    """A line number; anything not positive is unknown."""
    return F.when(line > 0, line)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)
