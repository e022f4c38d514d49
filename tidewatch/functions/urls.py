"""URL identity, scope and safety.

Absolute ASCII http(s) URLs are handled by built-in functions; whole WHATWG parsing (relative references, odd hosts, percent
encoding) is an Arrow function.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.netclass import PUBLIC, classify

# Tracking parameters, compared in lower case.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
MAX_URL = 8192
DEFAULT_PORT = {"http": 80, "https": 443}
_PATH, _QUERY = "!$%&'()*+,-./:;=@[]^_|~\\", "!$%&()*+,-./:;=?@[\\]^_`{|}~"


def plain(url: Column) -> Column:
    """Whether the built-in form applies: absolute, ASCII, http(s), a host of letters, digits, dots and hyphens, no dot segments."""
    return url.rlike(r"^(?i:https?)://[A-Za-z0-9.-]*[A-Za-z-][A-Za-z0-9.-]*(:[0-9]+)?([/?#][\x21\x23-\x3B\x3D\x3F-\x5B\x5D\x5F\x61-\x7A\x7C\x7E]*)?$") & ~url.rlike(r"/\.\.?([/?#]|$)")


def identity(url: Column) -> Column:
    """Identity of plain URLs: scheme and host in lower case, default ports and fragment gone, an empty path is /; null for others."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    rest = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(.*)$", 1), "#.*$", "")
    shown = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(plain(url), F.concat(scheme, F.lit("://"), host, shown, path))


def url_key(identity_url: Column) -> Column:
    return F.sha2(identity_url, 256)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def same_host(a: Column, b: Column) -> Column:
    return host_of(a) == host_of(b)


def strip_tracking(identity_url: Column) -> Column:
    """Without tracking parameters; the order of the others stays."""
    base, query = F.regexp_extract(identity_url, r"^([^?]*)", 1), F.regexp_extract(identity_url, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING) & (p != ""))
    return F.when((query == "") | (F.size(kept) == 0), base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))


def _host(raw: str) -> str | None:
    """A host as WHATWG parsing shows it; numbers in odd forms are IPv4 addresses."""
    host = unquote_to_bytes(raw).decode("utf-8", "replace").lower()
    if host.startswith("["):
        return host if host.endswith("]") and classify(host[1:-1]) else None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", host) or not host:
        return None
    parts = (host[:-1] if host.endswith(".") else host).split(".")
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", parts[-1]):
        try:
            numbers = [int(p, 16) if p[:2] == "0x" and len(p) > 2 else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
        except ValueError:
            return None
        if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return host


def parse(url: str | None, base: str | None = None) -> dict | None:
    """scheme, user, host, port, path, query of an absolute or (with base) relative reference; null if there is none."""
    if url is None:
        return None
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    if base:
        text = urljoin(base, text.replace("\\", "/") if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else text)
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", text, re.S)
    if not m:
        return None
    scheme, rest = m[1].lower(), m[2]
    if scheme not in DEFAULT_PORT:
        return {"scheme": scheme, "user": "", "host": urlsplit(text).netloc.lower(), "port": None, "path": rest, "query": None}
    rest = rest.split("#", 1)[0]
    rest, _, query = rest.partition("?")
    authority, slash, path = rest.replace("\\", "/").lstrip("/").partition("/")
    user, at, where = authority.rpartition("@")
    h = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", where)
    host = _host(h[1]) if h else None
    if host is None or (h[2] and int(h[2]) > 65535):
        return None
    port = int(h[2]) if h[2] and int(h[2]) != DEFAULT_PORT[scheme] else None
    out: list[str] = []
    parts = (slash + path).split("/")[1:] if slash else [""]
    for i, p in enumerate(parts):
        plain_p = p.replace("%2e", ".").replace("%2E", ".")
        if plain_p == "..":
            del out[-1:]
        if plain_p in (".", ".."):
            if i == len(parts) - 1:
                out.append("")
            continue
        out.append(quote(p, safe=_PATH))
    has_query = "?" in m[2].split("#", 1)[0]
    return {"scheme": scheme, "user": user, "host": host, "port": port, "path": "/" + "/".join(out), "query": quote(query, safe=_QUERY) if has_query and query else None}


def normal(url: str | None, base: str | None = None, strip: bool = False) -> str | None:
    """The identity of a URL."""
    p = parse(url, base)
    if p is None or p["scheme"] not in DEFAULT_PORT:
        return None
    query = p["query"]
    if strip and query:
        query = "&".join(x for x in query.split("&") if x and x.split("=", 1)[0].lower() not in TRACKING)
    user = f"{p['user']}@" if p["user"] else ""
    return f"{p['scheme']}://{user}{p['host']}{f':{p["port"]}' if p['port'] is not None else ''}{p['path']}{f'?{query}' if query else ''}"


def safety(url: str | None) -> str | None:
    """Null for a URL that may be fetched, else why not."""
    p = parse(url)
    if p is None:
        return "BLOCKED_HOST"
    if p["scheme"] not in DEFAULT_PORT:
        return "UNSUPPORTED_PROTOCOL"
    if p["user"]:
        return "CREDENTIALS_NOT_ALLOWED"
    if p["port"] is not None:
        return "NON_DEFAULT_PORT"
    host = p["host"].strip("[]").split("%")[0].rstrip(".")
    if host == "localhost" or host.endswith(".localhost") or classify(host) not in (None, PUBLIC):
        return "BLOCKED_HOST"
    return None


@F.pandas_udf(T.StringType())
def identity_any(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([normal(u, b or None) for u, b in zip(urls, bases, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def safety_any(urls: pd.Series) -> pd.Series:
    return urls.map(safety)


def safety_plain(url: Column) -> Column:
    """safety() of plain URLs (whose hosts are names) by built-in functions."""
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.rtrim(host_of(url), F.lit("."))
    own = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(~own, "NON_DEFAULT_PORT").when((host == "localhost") | host.endswith(".localhost"), "BLOCKED_HOST")


def valid_hostname(raw: Column) -> Column:
    """A project's host name: trimmed, lower case, without a trailing dot; null if it is none."""
    h = F.rtrim(F.lower(F.trim(raw)), F.lit("."))
    return F.when(h.rlike(r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]$") & ~h.endswith(".localhost"), h)


def same_host_identity(url: Column, host: Column) -> Column:
    """Identity of a plain http(s) URL on that host, else null."""
    i = identity(url)
    return F.when(host_of(i) == F.lower(host), i)


def sitemap_sources(declared: Column, origin: Column) -> Column:
    """Sitemaps that robots.txt names, then the customary one; each once, in that order."""
    return F.array_distinct(F.concat(F.coalesce(declared, F.array().cast("array<string>")), F.array(F.concat(origin, F.lit("/sitemap.xml")))))


def addresses(v4: Column, v6: Column) -> Column:
    """All addresses of a host."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(v4, none), F.coalesce(v6, none))
