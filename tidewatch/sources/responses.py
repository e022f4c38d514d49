"""Fetched documents as a source: response rows from pages, decoding of bodies, configuration, request bodies."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.urls import identity, identity_any

# Limits of one response and of a run.
BODY_CAP, RUN_CAP, TIMEOUT_S = 2 << 20, 500 << 20, 20


def responses(pages: DataFrame) -> DataFrame:
    """Pages as answered requests: url (its identity), status, content_type, x_robots_tag, redirects, body. Pages that share an
    identity answer once, with the first of them."""
    url = F.coalesce(identity(F.col("url")), identity_any("url", F.lit("")))
    first = pages.withColumn("url", url).groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p"))
    return first.select(
        "url", F.col("p.page_id").alias("page_id"), F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("x_robots_tag"),
        F.array().cast("array<string>").alias("redirects"), F.col("p.html").alias("body"),
    )


def decoded(body: bytes | None, encoding: str | None, cap: int) -> tuple[bytes | None, str]:
    """(bytes, OK), or (None, why not). Encoded and decoded bytes are capped; br needs a decoder that is not at hand."""
    if body is None:
        return None, "NETWORK_ERROR"
    kind = (encoding or "identity").strip().lower()
    if len(body) > cap:
        return None, "BODY_TOO_LARGE"
    if kind in ("", "identity"):
        return body, "OK"
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(body, cap + 1)
            return (out, "OK") if len(out) <= cap else (None, "BODY_TOO_LARGE")
        except zlib.error:
            continue
    return None, "NETWORK_ERROR"


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("outcome", T.StringType())]))
def decode_body(body: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(b, e, BODY_CAP) for b, e in zip(body, encoding, strict=True)], columns=["body", "outcome"])


def joined_headers(values: Column) -> Column:
    """A header sent more than once, as one value."""
    return F.array_join(values, ", ")


def request_body(text: Column) -> Column:
    """A JSON request body as a variant; null for what is no JSON."""
    return F.try_parse_json(text)


DEFAULTS = {"NODE_ENV": "development", "PORT": "3000", "LOG_LEVEL": "info"}
REQUIRED = ("DATABASE_URL", "AUTH_SECRET", "APP_ORIGIN")


def config(env: Mapping[str, str]) -> dict[str, str]:
    """Settings with defaults; in production every required key must be there."""
    out = DEFAULTS | {k: v for k, v in env.items() if v != ""}
    missing = [k for k in REQUIRED if k not in out]
    if out["NODE_ENV"] == "production" and missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out
