"""Hashes, canonical JSON, signatures and timestamp text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col

GENESIS = "0" * 64


def content_hash(value: str | Column) -> Column:
    """SHA-256 of text or bytes, in hex."""
    return F.sha2(col(value), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields in key order, without spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def row_hash(fields: dict[str, Column]) -> Column:
    return content_hash(canonical_json(fields))


def sign_payload(payload: str | Column, key: str) -> Column:
    """``sha256=`` and the HMAC-SHA-256 of a text under a key."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in raw))
    outer = F.lit(bytes(b ^ 0x5C for b in raw))
    first = F.sha2(F.concat(inner, F.encode(col(payload), "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(first)), 256))


def parse_scores(text: str | Column) -> Column:
    """JSON object text to MAP<STRING, DOUBLE>."""
    return F.from_json(col(text), "map<string,double>")


def iso_ts(ts: str | Column) -> Column:
    """UTC timestamp text with microseconds."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def day(ts: str | Column) -> Column:
    return F.to_date(col(ts))


def since_days(ts: str | Column, now: Column, days: int) -> Column:
    """Whether a timestamp is at most ``days`` days before the day of ``now``."""
    return day(ts) >= F.date_sub(F.to_date(now), days)


def origin_proof(fields: dict[str, Column], metadata: dict[str, Column]) -> Column:
    """STRUCT(payload, origin_hash) of nested proof fields."""
    nested = F.struct(*[metadata[k].alias(k) for k in sorted(metadata)])
    payload = canonical_json(fields | {"metadata": nested})
    return F.struct(payload.alias("payload"), content_hash(payload).alias("origin_hash"))


def notification(event: str, ts: Column, data: list[Column]) -> Column:
    """Webhook payload: event, timestamp and nested data, as JSON text."""
    return F.to_json(F.struct(F.lit(event).alias("event"), iso_ts(ts).alias("timestamp"), F.struct(*data).alias("data")))
