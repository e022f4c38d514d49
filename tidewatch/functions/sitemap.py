"""Sitemaps: a pull parser that holds one entry at a time, as an Arrow function and as rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LOC = 8192
#: Characters that are parsed at once; rows that are sent on at once.
SLICE, ROWS = 1 << 16, 4096
#: What a document is by the name of an element, and the element that holds its locations.
KINDS = (("INDEX", "sitemapindex", "sitemap"), ("URLSET", "urlset", "url"))


def _elements(xml: str) -> Iterator[tuple[str, str, str]]:
    """(local name, local name of its parent, text) of every element, as it ends; each is dropped then. Raises ParseError."""
    parser = ET.XMLPullParser(("start", "end"))
    open_: list[ET.Element] = []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def read() -> Iterator[tuple[str, str, str]]:
        for event, e in parser.read_events():
            if event == "start":
                open_.append(e)
                continue
            open_.pop()
            yield local(e), local(open_[-1]) if open_ else "", e.text or ""
            if open_:
                open_[-1].remove(e)

    begin = re.match(r"\s*", xml).end()
    for at in range(begin, len(xml), SLICE):
        parser.feed(xml[at : at + SLICE].encode())
        yield from read()
    parser.close()
    yield from read()


def kind_of(xml: str | None) -> str:
    """INDEX, URLSET or UNKNOWN; broken XML is UNKNOWN. Reads the whole document and holds nothing of it."""
    if xml is None or "<!ENTITY" in xml:
        return "UNKNOWN"
    names = set()
    tops = {top for _, top, _ in KINDS}
    try:
        for name, _, _ in _elements(xml):
            if name in tops:
                names.add(name)
    except ET.ParseError:
        return "UNKNOWN"
    return next((kind for kind, top, _ in KINDS if top in names), "UNKNOWN")


def locations(xml: str, kind: str) -> Iterator[str]:
    """Locations of 1 to 8192 characters of a document of that kind, while it is read."""
    entry = next((e for k, _, e in KINDS if k == kind), None)
    if entry is None:
        return
    for name, parent, text in _elements(xml):
        if name == "loc" and parent == entry and 1 <= len(loc := text.strip()) <= MAX_LOC:
            yield loc


def parse_sitemap(xml: str | None) -> tuple[str, list[str]]:
    """(INDEX, URLSET or UNKNOWN; its locations). Names count without their namespace."""
    kind = kind_of(xml)
    return kind, list(locations(xml or "", kind))


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("urls", T.ArrayType(T.StringType()))]))
def sitemap_facts(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(x) for x in xml], columns=["kind", "urls"])


def sitemap_rows(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """url, kind, pos, loc: a row per location, sent on while a document is read, so that a large one is never held as a list."""
    schema = "url string, kind string, pos long, loc string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = xml.as_py()
                kind, held, pos = kind_of(text), [], 0
                for loc in locations(text or "", kind):
                    held.append(loc)
                    if len(held) == ROWS:
                        yield _rows(own, kind, pos, held, names)
                        pos, held = pos + len(held), []
                if held:
                    yield _rows(own, kind, pos, held, names)

    return documents.select(F.col(url).cast("string"), F.col(body).cast("string")).mapInArrow(run, schema)


def _rows(own: str, kind: str, pos: int, held: list[str], names: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([own] * n, pa.string()), pa.array([kind] * n), pa.array(range(pos, pos + n), pa.int64()), pa.array(held)], names=names)
