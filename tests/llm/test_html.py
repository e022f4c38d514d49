import html
import random
import re

from tidewatch.llm.html_extract import LABELLED, best_run, extract, extract_pages, sequence


def test_weights_recover_the_labelled_pages():
    for page in LABELLED[:5]:
        inner = re.search(r"\[\[(.*?)\]\]", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h\d|br|li|td|tr|div|section|figcaption|pre|dd|dt|blockquote)\b", m[0]) else "", inner)).split())
        assert extract(page.replace("[[", "").replace("]]", "")) == want


def test_held_out_page():
    page = (
        '<body><header><h1>Site</h1></header><nav>a b</nav><div class="cookie-notice">we use x</div><main><article><h1>T</h1><p>Foo &amp; bar<br>baz</p><aside>no</aside>'
        '<div class="ad-box">x y z</div><p>qux<b>x</b>y</p><form><input><label>mail</label></form><ul><li>l1</li><li>l2</li></ul></article>'
        '<section class="comments"><article><p>first! a long comment with many many words of its own</p></article></section></main><aside>side</aside><footer>f</footer>'
    )
    assert extract(page) == "T Foo & bar baz quxxy l1 l2"


def test_odd_pages(spark):
    cases = {"": "", None: "", "just  text": "just text", "<p>a<p>b<script>x<y</script><!-- c": "a b", "<article><p>x</article>": "x", '<div class="post-content"><p>only one</p></div>': "only one"}
    df = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(cases)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert extract_pages(df.limit(0)).count() == 0


def unscanned(page):
    """What the words' weights alone would give: every word that no element keeps out."""
    return " ".join("".join(sequence(page)[1]).split())


def test_the_scan_decides():
    menu, foot = "<nav>" + "<a>go there</a> " * 20 + "</nav>", "<footer>all rights reserved by us here</footer>"
    text = "<article><h1>Title words</h1>" + "<p>some words of the text</p>" * 9 + "</article>"
    want = "Title words" + " some words of the text" * 9
    for page in (
        f"<body><div>a slogan</div>{menu}{text}{foot}</body>",  # nothing but the scan keeps the slogan out
        f"<body>{menu}{text}{foot}<p>made with love</p></body>",
        f"<body><p>skip to content</p>{menu}<div>{text}</div><span>top</span></body>",
    ):
        assert extract(page) == want != unscanned(page)
    boxes = "<body><div>name of site</div>" + menu + "<div><div>first words of a text in boxes</div>" * 2 + "<div>and the last ones</div></div></div>" + foot + "<div>x y</div>"
    assert extract(boxes) == "first words of a text in boxes " * 2 + "and the last ones" != unscanned(boxes)
    inner = text.replace("</h1>", '</h1><div class="ad">' + "buy this " * 90 + "</div>")
    assert extract(f"{menu}{inner}{foot}") == want  # an advert does not part the text around it
    themed = '<article><header class="entry-header"><h1 class="entry-title">Head line</h1></header><p>and text</p></article>'
    assert extract(f"{menu}{themed}{foot}") == "Head line and text"


def test_best_run_against_brute_force():
    r = random.Random(4)
    for _ in range(400):
        x = [r.choice((-3.0, -1.0, -0.5, 0.0, 1.0, 2.0)) for _ in range(r.randint(0, 14))]
        sums = {(a, b): sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
        best = max(sums.values(), default=0.0)
        a, b = best_run(x)
        assert sum(x[a:b]) == max(best, 0.0)
        if best > 0:
            first = min(k for k, v in sums.items() if v == best)[0]
            assert a == first and b == max(k[1] for k, v in sums.items() if v == best and k[0] == first)


def test_clashing_columns_ties_and_long_pages(spark):
    long = "<body><nav>m n</nav><article>" + "<p>word and word</p>" * 40_000 + "</article><footer>f</footer></body>"
    same = "<p>a b</p>" + "<nav>" + "x " * 30 + "</nav><p>c d</p>"
    df = spark.createDataFrame([(1, long, "t"), (2, same, "t"), (2, same, "t")], "page_id long, html string, text string")
    got = extract_pages(df, keep=("page_id", "text"))
    assert got.columns == ["page_id", "text_", "text"]
    assert sorted((r.page_id, r.text_, r.text) for r in got.collect()) == [(1, "t", " ".join(["word and word"] * 40_000)), (2, "t", "a b"), (2, "t", "a b")]


ARTICLE = "<article><h1>Title here</h1><p>one two three four five six seven</p></article>"
WANT = "Title here one two three four five six seven"


def test_names_of_layouts_do_not_empty_a_page():
    inner = ARTICLE.removeprefix("<article>").removesuffix("</article>")
    for page in (
        f'<body class="single right-sidebar">{ARTICLE}</body>', f'<body class="has-sidebar">{ARTICLE}', f'<body><div class="with-sidebar">{ARTICLE}</div></body>',
        f'<div class="with-sidebar">{inner}</div><div class="left-sidebar">a b c</div>', f'<main class="site-main no-sidebar">{inner}</main>', f'<article class="no-comments">{inner}</article>',
        f'<article class="has-sidebar">{inner}</article>', f'<body class="cookies-not-set">{ARTICLE}', f'<body class="menu-closed">{ARTICLE}', f'<body><div class="no-share">{ARTICLE}</div>',
        f'<body><form id="aspnetForm">{ARTICLE}</form></body>', ARTICLE.replace("<p>", '<p class="warning">'),
    ):
        assert extract(page) == WANT, page


def test_comments_links_and_lines_around_a_short_article():
    comments = '<div class="comments"><p>' + "first comment words " * 9 + "</p></div>"
    links = "<ul><li><a href=a>one link</a></li><li><a>two</a></li><li><a>three</a></li></ul>"
    reader = '<div class="comments-area"><article class="comment-body"><p>' + "zip zap " * 30 + "</p></article></div>"
    inner = ARTICLE.removeprefix("<article>").removesuffix("</article>")
    for page in (
        ARTICLE + comments + "footer line " * 13, links + ARTICLE, f"{links}<div>{inner}</div>", f"<div>{inner}</div>{reader}",
        ARTICLE.replace("</article>", '<div class="comments-area"><article class="comment"><p>zip zap</p></article></div></article>'),
    ):
        assert extract(page) == WANT, page
    assert extract(ARTICLE.replace("</article>", links + "</article>")) == WANT + " one link two three"  # an article's own list


def test_text_of_random_pages_against_all_runs():
    """The text is that of the best of all contiguous runs, by their sums."""
    r = random.Random(6)
    parts = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", '<div class="ad">', "<ul><li>", "</li></ul>", "<a href=x>", "</a>", "<h1>", "</h1>", "some words ", "&amp; x", "<br>", "<footer>", "</footer>", "a b c d "]
    for _ in range(300):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        scores, pieces = sequence(page)
        sums = [(round(sum(scores[a:b]), 6), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        top = max(sums, default=(0.0, 0, 0))
        want = " ".join("".join(pieces[-top[1] : top[2]]).split()) if top[0] > 0 else ""
        assert extract(page) == want, page
