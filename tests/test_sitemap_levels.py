"""The sitemap walk opens the root and three levels below it, on its own host."""

from tidewatch.operators import frontier


def test_sitemap_walk_opens_three_levels_below_the_root_on_its_host(spark):
    at = lambda n: f"https://a.example/s{n}.xml"
    far = [f"https://b.example/{i}.xml" for i in range(25)]  # more than the budget of documents
    docs = [(at(n), "INDEX", [*far, f"https://a.example/u{n}.xml", at(n + 1)]) for n in range(6)]
    docs += [(f"https://a.example/u{n}.xml", "URLSET", [f"https://a.example/{n}", f"https://A.example/{n}#x", f"https://b.example/{n}"]) for n in range(6)]
    docs += [(f, "URLSET", [f"https://a.example/far{i}"]) for i, f in enumerate(far)]
    docs = spark.createDataFrame(docs, "url string, kind string, urls array<string>")
    found, state = frontier.sitemap_walk(spark.createDataFrame([("s", at(0))], "scope string, root string"), docs)
    assert sorted(r.url for r in found.collect()) == [f"https://a.example/{n}" for n in range(3)]
    assert [tuple(r) for r in state.select("documents", "truncated").collect()] == [(7, True)]
    short = docs.filter(~docs.url.isin(at(4), at(5)))
    short = short.filter(short.url != at(3)).union(spark.createDataFrame([(at(3), "URLSET", ["https://a.example/3"])], docs.schema))
    found, state = frontier.sitemap_walk(spark.createDataFrame([("s", at(0))], "scope string, root string"), short)
    assert sorted(r.url for r in found.collect()) == [f"https://a.example/{n}" for n in range(4)]
    assert [tuple(r) for r in state.select("documents", "truncated").collect()] == [(7, False)]
