"""Cursors, page sizes, redaction, challenges, tokens: small scalar functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE = 50, 100
# Audit details keep this many entries, none with such a name, and values of this length.
AUDIT_ENTRIES, AUDIT_LENGTH = 20, 200
# Fixed value: what trimming a record takes off.
BLANKS = " \t\n\r\x0b\x0c\u00a0\ufeff\u2028\u2029"
SENSITIVE = "(?i)token|secret|password|cookie|authorization|credential"


def clamp_page_size(size: float | None) -> int:
    if size is None or not size > 0:
        return DEFAULT_PAGE
    return min(math.floor(size), MAX_PAGE)


def page_size(size: Column) -> Column:
    return F.when(size > 0, F.least(F.floor(size), F.lit(MAX_PAGE))).otherwise(DEFAULT_PAGE).cast("bigint")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def encode_cursor(created: Column, id_: Column) -> Column:
    """base64url, without padding, of ISO time | id."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat(iso_millis(created), F.lit("|"), id_), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct(created_at, id), or null for what is no cursor. The last | separates."""
    fine = cursor.rlike("^[A-Za-z0-9_-]+$") & (F.length(cursor) % 4 != 1)
    plain = F.translate(cursor, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4))
    text = F.when(fine, F.decode(F.unbase64(F.when(fine, padded)), "UTF-8"))
    at = F.try_to_timestamp(F.regexp_extract(text, r"^(.*)\|([^|]*)$", 1))
    id_ = F.regexp_extract(text, r"^(.*)\|([^|]*)$", 2)
    return F.when(at.isNotNull() & (id_ != ""), F.struct(at.alias("created_at"), id_.alias("id")))


def redact(entries: Column) -> Column:
    """entries: array of (key, kind, value) in their order; nested kinds (object, array) and sensitive keys go, long strings are cut."""
    first = F.slice(entries, 1, AUDIT_ENTRIES)
    kept = F.filter(first, lambda e: ~e["key"].rlike(SENSITIVE) & ~e["kind"].isin("object", "array"))
    value = lambda e: F.when((e["kind"] == "string") & (F.length(e["value"]) > AUDIT_LENGTH), F.concat(F.substring(e["value"], 1, AUDIT_LENGTH), F.lit("…"))).otherwise(e["value"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))


def challenge_name(prefix: str, hostname: Column) -> Column:
    return F.concat(F.lit(f"{prefix}."), F.lower(hostname))


def matches_challenge(records: Column, expected: Column) -> Column:
    """records: array of TXT records, each an array of chunks; joined, trimmed, compared exactly (case counts)."""
    return F.exists(records, lambda chunks: F.trim(F.array_join(chunks, ""), F.lit(BLANKS)) == expected)


def verified_until(verified_at: Column) -> Column:
    return verified_at + F.expr("interval 30 days")


def is_verified(verified_at: Column, now: Column) -> Column:
    return F.coalesce(now < verified_until(verified_at), F.lit(False))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def is_expired(expires_at: Column, now: Column) -> Column:
    return expires_at <= now


def invitation_expiry(now: Column) -> Column:
    return now + F.expr("interval 72 hours")


def positive_number(json: Column, key: str, default: float) -> Column:
    """A policy's number if it is one and positive, else the default; a string of digits is no number."""
    v = F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
    number = F.when(v.rlike("^[-0-9]"), v.try_cast("double"))
    return F.when(number > 0, number).otherwise(float(default))


def request_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def client_key(forwarded: Column, peer: Column | None = None) -> Column:
    """The first address of x-forwarded-for if that is sent, else the peer's, else unknown."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(forwarded != "", first).otherwise(F.coalesce(F.lit(None) if peer is None else peer, F.lit("unknown")))


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)
