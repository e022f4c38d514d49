"""Sitemaps are read entry by entry: the same rows as from the whole tree, in little memory."""

import random
import tracemalloc
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tidewatch.functions.sitemap import kind_of, locations, parse_sitemap, sitemap_rows


def whole(xml):
    """By the tree of the whole document."""
    if "<!ENTITY" in xml:
        return "UNKNOWN", []
    try:
        root = ET.fromstring(xml.strip().encode())
    except ET.ParseError:
        return "UNKNOWN", []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    for kind, top, entry in (("INDEX", "sitemapindex", "sitemap"), ("URLSET", "urlset", "url")):
        if any(local(e) == top for e in root.iter()):
            locs = [(c.text or "").strip() for e in root.iter() if local(e) == entry for c in e if local(c) == "loc"]
            return kind, [u for u in locs if 1 <= len(u) <= 8192]
    return "UNKNOWN", []


def some(r):
    top = r.choice(("urlset", "sitemapindex", "x:urlset xmlns:x='u'", "html", "urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"))
    name = top.split()[0]
    prefix = "x:" if ":" in name else ""
    entry = r.choice(("url", "sitemap"))
    locs = ["", " https://a/1 ", "https://a/é&amp;b", "x" * 8193, "<![CDATA[https://a/c]]>", "a<!-- c -->b", "a<b>c</b>d", "\n https://a/2\n"]
    parts = [f"<{prefix}{entry}>" + "".join(r.choice((f"<{prefix}loc>{r.choice(locs)}</{prefix}loc>", "<lastmod>2026</lastmod>" if not prefix else "", "<image><loc>no</loc></image>" if not prefix else "")) for _ in range(r.randint(0, 3))) + f"</{prefix}{entry}>" for _ in range(r.randint(0, 5))]
    out = r.choice(("", " \n", "<?xml version='1.0' encoding='UTF-8'?>")) + f"<{top}>" + "".join(parts) + f"</{name}>" + r.choice(("", "\n"))
    if r.random() < 0.2:
        at = r.randint(0, len(out))
        out = out[:at] + r.choice(("<", "&", "</x>", "&nope;", "<!ENTITY")) + out[at:]
    return out


def test_against_the_whole_tree():
    r = random.Random(7)
    for _ in range(1500):
        xml = some(r)
        assert parse_sitemap(xml) == whole(xml), xml
    for xml in ("", " ", "<urlset/>", "text", "<a><urlset><url><loc>u</loc></url></urlset><sitemapindex/></a>"):
        assert parse_sitemap(xml) == whole(xml), xml
    assert parse_sitemap(None) == ("UNKNOWN", [])


def test_fifty_megabytes_in_little_memory():
    entry = "<url><loc>https://www.example.com/a/rather/long/path/to/page-{}</loc><lastmod>2026-01-01</lastmod></url>"
    n = 500_000
    xml = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(entry.format(i) for i in range(n)) + "</urlset>"
    assert len(xml) > 50_000_000
    tracemalloc.start()
    kind = kind_of(xml)
    found = sum(1 for _ in locations(xml, kind))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kind == "URLSET" and found == n and peak < 5_000_000


def test_rows(spark):
    xml = "<urlset>" + "".join(f"<url><loc>u{i}</loc></url>" for i in range(10_000)) + "</urlset>"
    df = spark.createDataFrame([("a", xml), ("b", "<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>"), ("c", None), ("d", "<urlset>")], "url string, body string")
    rows = sitemap_rows(df)
    assert [(r.kind, r.pos, r.loc) for r in rows.filter("url = 'b'").collect()] == [("INDEX", 0, "c")]
    assert rows.filter("url = 'a'").agg(F.count(F.lit(1)), F.countDistinct("loc"), F.max("pos")).first()[:] == (10_000, 10_000, 9999)
    assert rows.filter("url in ('c', 'd')").count() == 0
