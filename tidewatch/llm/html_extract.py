"""HTML extraction by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word scores WORD, and more below an element that labelled pages show around
the content, whose log odds are clearly above those of any word: these are added. In a block that is nothing but links it scores the log odds of such blocks,
which are negative, unless it stands below such an element. Below an element that labelled pages show outside the content
(menus, headers, footers, sidebars, notices, adverts, forms, comments) it scores that element's log odds, which are clearly
negative; where such an element stands inside an article it scores nothing, so that an advert does not part the text around
it. Tags score negative: slightly, or heavily where labelled pages show content to begin or end at that tag. One linear scan
(Kadane) finds the best contiguous region, and its words but for those of such elements are the main text. So text that no
element gives away (a slogan above the menu, a list of links, a line behind the footer) stays out as reaching it costs more
than it brings.

Names of layouts are weak evidence. html, body and main are never outside the content; nor is an element for a part of a class
(right-sidebar, menu-closed) if it holds an article or main, if the part is negated (no-comments), or if it is not the first
part and the element has most of the page's words; nor a form that wraps the page; nor, inside an article, a block of text
(p, h2, li, ...) for a class that labelled pages hardly show (STRONG).

All weights are counted from LABELLED, pages with their content marked:
  weight of an element's feature (tag name, or a token of its class, id or role) = log odds, with one added to both counts,
  of words below it lying in the content; an element's weight is its least one below BAD, else none;
  weight of blocks of links = the same log odds of their words;
  tag weight = -(BASE_COST + BORDER_COST * share of the tag's occurrences that the content begins right after or ends before).

White space (as str.split() sees it) inside a block becomes one space, blocks are trimmed and joined by one space, character
references are decoded.

Defined results: a null, empty or word-less page gives an empty text; unclosed and stray tags are borne; markup that ends
inside a tag or comment is dropped; ties take the first and longest region; repeated rows each get a row; extra columns are
ignored, a kept one named text is carried with _ appended; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.base import carried, map_batches

START, STOP = "[[", "]]"
#: The feature of blocks that are nothing but links.
LINKS = "(links)"
#: Log odds: below BAD an element is outside the content, above GOOD around it; below STRONG for a block of text in an article.
BAD, GOOD, STRONG = -1.0, 1.0, -2.0
#: Scores: of a word, of any tag, and of a tag at which content always begins or ends (in words).
WORD, BASE_COST, BORDER_COST = 1.0, 0.005, 40.0
#: Labelled pages: content stands between [[ and ]].
LABELLED = (
    '<html><head><title>t a b</title></head><body><nav><ul><li><a href=x>home page</a></li><li><a>news</a></li></ul></nav>'
    '<div class="ad">buy this now please</div><article>[[<h1>one two</h1><p>three four <b>five</b> six<br>seven</p>'
    "<p>eight nine ten</p>]]</article><footer>&copy; all rights reserved here</footer></body></html>",
    '<body><header class="site-header"><a>logo site</a><nav class="menu navigation navbar">a b c</nav></header><main>'
    '<article>[[<header class="entry-header post-header article-header"><h1>one two three</h1></header><p>four five</p>'
    "<ul><li>six seven</li><li>eight nine</li></ul><p>ten eleven</p>]]</article></main>"
    '<aside class="sidebar widget"><h3>more to read</h3><ul><li><a>x y</a></li></ul></aside>'
    "<footer id=footer><p>imprint privacy</p></footer></body>",
    '<body><div id="header" role="banner">name of site</div><div role="navigation" class="nav breadcrumb breadcrumbs">a b c'
    '</div><div id="content" class="content post entry">[[<h2>one two</h2><p>three four five</p><blockquote>six seven'
    "</blockquote><p>eight nine</p><table><tr><td>ten</td><td>eleven</td></tr></table>]]</div>"
    '<div class="comments comment" id="comments"><p>nice post thanks</p><p>me too</p></div>'
    '<div class="sidebar" role="complementary">s t u v</div><div id="footer" role="contentinfo">w x y</div></body>',
    '<body><div class="cookie cookies notice consent banner gdpr">we use cookies accept</div><article>[[<h1>one</h1>'
    "<section><p>two three</p><figure><figcaption>four five</figcaption></figure></section>"
    "<section><h2>six</h2><p>seven eight nine</p><pre>ten eleven</pre></section>]]</article>"
    '<section class="related recommended promo newsletter subscribe"><h3>read next</h3><p>p q r</p></section>'
    '<form class="signup"><label>your mail</label><button>send it</button></form></body>',
    '<body><div class="alert notification popup modal overlay">sale today only</div>'
    '<div class="ads advert advertisement sponsor sponsored banner-ad adsbygoogle">cheap things here</div><main>[[<h1>one two'
    "</h1><p>three <em>four</em> <a>five</a></p><div><p>six seven eight</p></div><dl><dt>nine</dt><dd>ten</dd></dl>]]</main>"
    '<div class="share social sharing toolbar">tweet pin mail</div><div class="pagination pager">1 2 3 next</div>'
    '<div class="search login skip-link">find log in</div><div class="disclaimer paywall cta warning">terms apply here</div>'
    '<div id="disqus_thread" class="disqus discussion replies reply respond">u v w</div></body>',
    '<body><div class="topbar masthead">a b c</div><div class="wrapper container"><div class="menu">d e f</div>'
    '<article class="post hentry">[[<h1>one</h1><p>two three four</p>]]<form><select><option>g h i</option></select><input>'
    '<textarea>j k l</textarea></form><aside>m n o p</aside><div class="ad">q r s</div><div class="comments">t u v</div>'
    "</article></div><noscript>turn on scripts</noscript><dialog>ok go away</dialog><menu><li>x y</li></menu></body>",
    '<body><div class="wrapper container page layout row col main"><div class="post hentry article story text body"><div>'
    "[[<h1>a title of six words here</h1><h3>a smaller one of six words</h3>"
    "<p>a long text with <a>a link of five words</a> and then <i>some more</i> <strong>words</strong> and <code>code</code> "
    "with <span>spans</span> too</p><div>words in a plain box of the text <a>more links</a></div>"
    "<h4>one more title here</h4><ul><li>a list of words in the text with <a>a long link of words</a></li></ul>"
    "<ol><li>and a numbered list</li></ol><p>and the last words of the text <a>with a link</a></p>]]</div></div></div></body>",
    "<body><div class=page><main>[[" + "<div>a text in plain boxes</div><section><div><p>one in another</p></div></section>" * 40 + "]]</main></div></body>",
    "<body><div class=page><p>a name</p><article>[[" + "<p>a text of an article</p><div>and more of it</div>" * 40 + "]]</article></div></body>",
)
#: Elements that classes do not put outside the content, that may wrap a page, that hold text; words that negate a class.
TOP, WRAPS = frozenset(("html", "body", "main")), frozenset(("form",))
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())
NEGATED = frozenset(("no", "not", "without"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:--!?>|\Z)|(?P<s>/?)(?P<n>[A-Za-z][^\s/>]*)(?P<a>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?:!|\?|/)[^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|[\s\"'])(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


@cache
def features(name: str, attrs: str, inside: bool) -> tuple[str, ...]:
    """Of an element: its tag and tokens of class, id and role (headers inside an article apart)."""
    own = lambda x: "header-in" if x == "header" and inside else x
    out = [own(name)]
    if attrs:
        for m in ATTR.finditer(attrs):
            out += [f".{own(t)}" for t in (m[2] or m[3] or m[4] or "").lower().split()]
    return tuple(out)


def events(html: str):
    """(kind, value, attributes): 't' text, 's' start tag, 'e' end tag. Raw elements come as start and end without their text."""
    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            yield "t", html[at:], ""
            return
        if m.start() > at:
            yield "t", html[at : m.start()], ""
        at = m.end()
        name = m["n"]
        if not name:
            continue
        name = name.lower()
        if m["s"]:
            yield "e", name, ""
            continue
        attrs = m["a"] or ""
        yield "s", name, attrs
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name not in ("svg", "math"):
                end = raw_end(name).search(html, at)
                at = end.end() if end else n
            yield "e", name, ""


def closed(stack: list, name: str) -> int | None:
    """Where an end tag cuts the stack of open elements (their first entry is the name); None: it closes nothing."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            return i
        if stack[i][0] in ("article", "body", "html", "td", "th") and name not in ("article", "body", "html", "main", "table", "tr"):
            return None
    return None


def outline(found: list[tuple[str, str, str]], weights: Weights | None = None) -> tuple[dict[int, tuple[int, bool]], set[int], int]:
    """Of a page's events: words and whether an article or main is in it (of the content, by the weights), by the place of each
    start tag; the places of text in blocks that are nothing but links; words of the page."""
    inside: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int, int]] = []  # name, place, words before
    homes: list[int] = []
    links: set[int] = set()
    block: list[int] = []
    words = linked = free = open_links = 0

    def leave(i: int) -> None:
        nonlocal open_links
        for name, at, before in reversed(stack[i:]):
            inside[at] = (words - before, bool(homes) and homes[-1] > at)
            open_links -= name == "a"
        del stack[i:]

    def next_block() -> None:
        nonlocal linked, free
        if linked and not free:
            links.update(block)
        linked = free = 0
        block.clear()

    for at, (kind, value, attrs) in enumerate(found):
        if kind == "t":
            if n := len(value.split()):
                words += n
                linked, free = (linked + n, free) if open_links > 0 else (linked, free + n)
                block.append(at)
            continue
        if value in BLOCK:
            next_block()
        if kind == "s" and value not in VOID:
            if value in ("article", "main") and (weights is None or weights.element(value, attrs, False) >= 0):
                homes.append(at)
            stack.append((value, at, words))
            open_links += value == "a"
        elif kind == "e" and (i := closed(stack, value)) is not None:
            leave(i)
    next_block()
    leave(0)
    return inside, links, words


class Weights:
    """Counted from labelled pages."""

    def __init__(self, pages: tuple[str, ...] = LABELLED):
        inside, outside, border, seen = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            now, stack, ended, before = False, [], False, None
            found = list(events(page))
            _, links, _ = outline(found)
            for at, (kind, value, attrs) in enumerate(found):
                if kind == "t":
                    for part in re.split(r"(\[\[|\]\])", value):
                        if part == START:
                            now = True
                            border[before] += 1
                        elif part == STOP:
                            now, ended = False, True
                        elif part.strip():
                            for f in {f for _, fs in stack for f in fs} | ({LINKS} if at in links else set()):
                                (inside if now else outside)[f] += len(part.split())
                    continue
                before = ("/" if kind == "e" else "") + value
                seen[before] += 1
                if ended:
                    border[before] += 1
                    ended = False
                if kind == "s" and value not in VOID:
                    stack.append((value, features(value, attrs, any(s[0] in ("article", "main") for s in stack))))
                elif kind == "e":
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == value:
                            del stack[i:]
                            break
        self.word = {f: math.log((inside[f] + 1) / (outside[f] + 1)) for f in {*inside, *outside}}
        self.usual = self.word["body"]  # the log odds of any word
        self.tag = {t: -(BASE_COST + BORDER_COST * border[t] / n) for t, n in seen.items()}

    def part(self, token: str, inside: bool, holds: bool, most: bool) -> float:
        """The least weight of a part of a class that no labelled page has as a whole (site-footer, ad-box)."""
        parts = [p for p in re.split(r"[-_]+", token) if p]
        if len(parts) < 2 or holds or not NEGATED.isdisjoint(parts):
            return 0.0
        own = lambda p: "header-in" if p == "header" and inside else p
        return min([self.word.get(f".{own(p)}", 0.0) for p in (parts[:1] if most else parts)] + [0.0])

    @cache  # noqa: B019
    def element(self, name: str, attrs: str, inside: bool, holds: bool = False, most: bool = False) -> float:
        """Weight of an element: below BAD it stands outside the content; above those of any word by GOOD around it; else 0. holds: an article or main;
        most: of the page's words."""
        if attrs and name not in TOP and HIDDEN.search(attrs):
            return min(self.word.values())
        tokens = features(name, attrs, inside)
        tag = self.word.get(tokens[0], 0.0)
        if name in WRAPS and (holds or most):
            tag = 0.0
        found = [self.word[t] if t in self.word else self.part(t[1:], inside, holds and name != "article", most or name == "article") for t in tokens[1:]]
        marked, best = min(found, default=0.0), max([tag, *found])
        around = best if best > self.usual + GOOD and name not in TEXT else 0.0
        if name in TOP:
            return around
        if tag >= BAD and inside and name in TEXT and marked >= STRONG:
            marked = 0.0
        # A content class outweighs a neutral tag or another class, never a tag of the outside.
        if tag >= BAD and (marked >= BAD or max(found) > -BAD):
            return around
        return min(tag, marked)


@cache
def default_weights() -> Weights:
    return Weights()


def best_run(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous run of the greatest sum begins and ends (exclusive); the first of equal ones, then the longest.
    (0, 0) where no sum is positive."""
    best, total, begin, out = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += x
        if total > best or (total == best > 0 and begin == out[0]):
            best, out = total, (begin, i + 1)
    return out


def sequence(html: str, weights: Weights | None = None) -> tuple[list[float], list[str]]:
    """The page as scores and what each adds to the text: a stretch of words, a block's break, or nothing."""
    w = weights or default_weights()
    scores: list[float] = []
    pieces: list[str] = []
    stack: list[tuple[str, float]] = []
    outer: list[float] = []  # weights of open elements that stand outside the content
    around: list[float] = []  # weights of open elements that stand around it
    homes = 0
    found = list(events(html))
    inside, links, words = outline(found, w)
    linked = min(w.word.get(LINKS, 0.0), 0.0)
    for at, (kind, value, attrs) in enumerate(found):
        if kind == "t":
            text = unescape(value) if "&" in value else value
            n = len(text.split())
            plain = WORD + max(around) if around else linked if at in links else WORD
            scores.append(plain * n if not outer else 0.0 if homes else min(outer) * n)
            pieces.append("" if outer else text)
            continue
        brk = value in BLOCK and not outer
        if kind == "s":
            weight = 0.0
            if value not in VOID:
                size, holds = inside[at]
                weight = w.element(value, attrs, homes > 0, holds, 2 * size > words)
                stack.append((value, weight))
                if weight < 0:
                    outer.append(weight)
                elif weight > 0:
                    around.append(weight)
                homes += value in ("article", "main") and not outer
        elif (i := closed(stack, value)) is not None:
            for name, weight in reversed(stack[i:]):
                homes -= name in ("article", "main") and not outer
                if weight < 0:
                    outer.pop()
                elif weight > 0:
                    around.pop()
            del stack[i:]
        scores.append(-BASE_COST if outer else w.tag.get(value if kind == "s" else f"/{value}", -BASE_COST))
        pieces.append("\n\n" if brk or (value in BLOCK and not outer) else "")
    return scores, pieces


def extract(html: str, weights: Weights | None = None) -> str:
    """The main text of one page."""
    scores, pieces = sequence(html, weights)
    begin, end = best_run(scores)
    return " ".join("".join(pieces[begin:end]).split())


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep and the main text of every row."""
    rows, ddl, names, _ = carried(pages, html, keep, ("text",))

    def extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.columns[-1].to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    return map_batches(rows, extracted, f"{ddl}, text string")
