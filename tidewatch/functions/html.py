"""Facts of a page: title, description, canonicals, robots directives, internal links. One Arrow function over the HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.urls import normal, parse

_TEXTS = T.ArrayType(T.StringType())
FACTS = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("meta_description", T.StringType()), T.StructField("canonical_raw", _TEXTS), T.StructField("canonical_resolved", _TEXTS)]
    + [T.StructField("robots_meta", _TEXTS), T.StructField("internal_links", _TEXTS), T.StructField("internal_links_count", T.LongType())]
)
SKIPPED = ("#", "mailto:", "tel:", "javascript:")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base = self.description = None
        self.titles: list[list[str]] = []
        self.in_title = False
        self.canonical: list[str] = []
        self.robots: list[str] = []
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "title" and not self.titles:
            self.titles.append([])
            self.in_title = True
        elif tag == "base" and self.base is None and "href" in a:
            self.base = a["href"]
        elif tag == "link" and a.get("rel") == "canonical" and "href" in a:
            self.canonical.append(a["href"])
        elif tag == "meta" and a.get("name") == "description" and self.description is None:
            self.description = a.get("content", "")
        elif tag == "meta" and a.get("name") == "robots" and a.get("content"):
            self.robots.append(a["content"])
        elif tag == "a" and "href" in a:
            self.hrefs.append(a["href"])

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.titles[0].append(data)


def extract_page(html: str | None, final_url: str) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    base = (normal(page.base, final_url) if page.base else None) or final_url
    title = "".join(page.titles[0]).strip() if page.titles else ""
    resolved = [u for u in (normal(c, base) for c in page.canonical) if u]
    own = (parse(final_url) or {}).get("host")
    links: dict[str, None] = {}
    for href in page.hrefs:
        h = href.strip()
        if h and not h.startswith(SKIPPED) and (u := normal(h, base)) and parse(u)["host"] == own:
            links[u] = None
    return title or None, (page.description or "").strip() or None, page.canonical, resolved, page.robots, list(links), len(links)


@F.pandas_udf(FACTS)
def page_facts(html: pd.Series, final_url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_page(h, u) for h, u in zip(html, final_url, strict=True)], columns=FACTS.names)


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.trim(F.get(F.split(content_type, ";"), F.lit(0))).rlike(r"(?i)^(text/html|application/xhtml\+xml)$"), F.lit(False))


def index_state(sources: Column) -> Column:
    """UNKNOWN without directives, DISALLOWED with noindex or none, else ALLOWED."""
    tokens = F.filter(F.transform(F.flatten(F.transform(sources, lambda s: F.split(s, ","))), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, "UNKNOWN").when(F.arrays_overlap(tokens, F.array(F.lit("noindex"), F.lit("none"))), "DISALLOWED").otherwise("ALLOWED")


def page_index_state(meta: Column, header: Column) -> Column:
    """Of an HTML page: its meta directives and X-Robots-Tag together; none at all allow."""
    every = F.filter(F.concat(F.coalesce(meta, F.array().cast("array<string>")), F.array(header)), lambda s: s.isNotNull())
    return F.when(F.size(every) == 0, "ALLOWED").otherwise(index_state(every))


def eligible(content_type: Column, final_status: Column, redirects: Column, body: Column) -> Column:
    """Whether a response is a page whose fields are known."""
    return is_html(content_type) & F.coalesce((final_status >= 200) & (final_status < 300), F.lit(False)) & (F.coalesce(F.size(redirects), F.lit(0)) <= 0) & body.isNotNull()


def validity(outcome: Column, is_page: Column) -> Column:
    state = F.when(is_page, "KNOWN").when(outcome == "HTTP_RESPONSE", "NOT_APPLICABLE").otherwise("UNKNOWN")
    names = ("title", "metaDescription", "canonical", "robots", "internalLinksCount")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array_repeat(state, len(names)))


def title_of(html: Column) -> Column:
    """The title by built-in functions, for pages whose first title holds no markup or references."""
    t = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>([^<]*)</title>", 1))
    return F.when(t != "", t)
