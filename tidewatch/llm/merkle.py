"""Document fingerprints (native): a Merkle tree over paragraphs and sections, built by built-in functions alone.

A paragraph is a sentence or a line, and a longer one is cut behind the word that has its 64th character: what is inserted
moves borders up to the next full stop or line break only. A section ends behind a blank line and behind a paragraph whose
digest begins with 0 or 8, so that its borders go with the text, and has SECTION paragraphs at most. A paragraph's node is the
SHA-256 of its text, a section's that of its paragraphs' nodes, the root that of the sections' nodes: roots are equal if and
only if the texts are.

A fingerprint is written root/sections/words/pairs. Sections are parted by commas, each with the first digits of its node, a
colon and those of its paragraphs, parted by points; a text of over PARAGRAPHS paragraphs lists its sections only. A text of at
most WORDS words lists these too, one of at most PAIRS characters each two neighbouring ones, as a few words have no branches
to compare. So a fingerprint has some thousand characters at most, and one group of digits a section beyond. likeness()
compares the deepest level that both list, as bags: twice what they share by what both have. first_edit() descends into the
first branch that differs; edits() gives the spans of a text whose branches another fingerprint lacks.

followed() gives each row the next one's values in the order of keys without a global sort in one task: keys are dealt to
ranges at quantiles (of all keys; they move balance only), the first row of each range is also sent to the range before,
and one window a range looks ahead. A key that fills several ranges is spread over them by the digest of its text. The texts
are shuffled once.

Defined results: a null text counts as empty, whose tree has a root only; null keys come before all others; rows of equal
keys follow one another by digest, then text; the one row of a table follows itself; an empty table gives no rows; extra
columns are ignored. Keys must be whole numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import let, text_of

SPACE = " \\t\\n\\x0B\\f\\r"
STOPS = ".!?"
PARAGRAPH = f"[^{STOPS}\\n]{{1,64}}[^{STOPS}{SPACE}]{{0,32}}[{STOPS}{SPACE}]{{0,64}}|[{STOPS}{SPACE}]{{1,64}}"
WORD = f"[^{SPACE}]+"
#: Of 16 first digits of a paragraph's node, these end a section; so does its length.
ENDS, SECTION = ("0", "8"), 32
DIGITS = 8
#: Entries that a fingerprint lists at most of these levels.
PARAGRAPHS, WORDS, PAIRS = 256, 64, 48
#: Rows of a range of keys, and ranges at most.
RANGE_ROWS, RANGES = 512, 1 << 15


def _groups(items: Column, ends: Column) -> Column:
    """The slices of an array that end at the given places (from 0)."""
    begin = lambda j: F.coalesce(F.get(ends, j - 1), F.lit(-1))
    return F.transform(ends, lambda e, j: F.slice(items, begin(j) + 2, e - begin(j)))


def _short(items: Column, most: int) -> Column:
    """An array of one array, cut into arrays of so many entries."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / most).cast("int")), lambda c: F.slice(items, c * most + 1, most))
    return F.when(F.size(items) <= most, F.array(items)).otherwise(cut)


def paragraphs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def tree_of(paragraphs: Column) -> Column:
    """root and sections (node, and the nodes of its paragraphs) of the texts of the paragraphs."""

    def sectioned(nodes: Column) -> Column:
        ends = F.transform(nodes, lambda x, i: F.when(
            F.substring(x, 1, 1).isin(*ENDS) | (F.instr(F.get(paragraphs, i), "\n\n") > 0) | (i == F.size(nodes) - 1), i))
        return let(F.filter(ends, lambda i: i.isNotNull()), lambda e: F.flatten(F.transform(_groups(nodes, e), lambda g: _short(g, SECTION))))

    def noded(groups: Column) -> Column:
        return F.transform(groups, lambda g: F.struct(F.sha2(F.array_join(g, ""), 256).alias("node"), g.alias("paragraphs")))

    nodes = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    sections = let(let(nodes, sectioned), noded)
    return let(sections, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["node"]), ""), 256).alias("root"), s.alias("sections")))


def _digits(node: Column) -> Column:
    return F.substring(node, 1, DIGITS)


def fingerprint(text: Column) -> Column:
    """The written tree of a text."""
    hashed = lambda items: F.array_join(F.transform(items, lambda w: _digits(F.md5(w))), ".")

    def words(t: Column, paragraphs: Column) -> Column:
        found = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) <= WORDS, hashed(w)).otherwise(""))
        return F.when(F.size(paragraphs) <= WORDS, found).otherwise("")

    def pairs(t: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 1)), lambda i: F.substring(t, i, F.lit(2)))
        return F.when((F.length(t) <= PAIRS) & (F.length(t) > 0), hashed(two)).otherwise("")

    def written(t: Column, paragraphs: Column, tree: Column) -> Column:
        below = lambda s: F.when(F.size(paragraphs) <= PARAGRAPHS, F.concat(F.lit(":"), F.array_join(F.transform(s["paragraphs"], _digits), "."))).otherwise("")
        sections = F.array_join(F.transform(tree["sections"], lambda s: F.concat(_digits(s["node"]), below(s))), ",")
        return F.concat_ws("/", tree["root"], sections, words(t, paragraphs), pairs(t))

    return let(text, lambda t: let(paragraphs_of(t), lambda p: let(tree_of(p), lambda tree: written(t, p, tree))))


LEVELS = ("pairs", "words", "paragraphs", "sections")


def _read(printed: Column) -> Column:
    """root, sections, paragraphs (of all sections), words and pairs of a written tree; what is not listed is an empty array."""
    filled = lambda x: F.filter(x, lambda y: y != "")

    def levels(p: Column) -> Column:
        listed = F.split(F.regexp_replace(p[1], "(?:^|,)[0-9a-f]+:?", "."), "\\.")
        return F.struct(
            p[0].alias("root"), filled(F.split(F.regexp_replace(p[1], ":[0-9a-f.]*", ""), ",")).alias("sections"), filled(listed).alias("paragraphs"),
            filled(F.split(p[2], "\\.")).alias("words"), filled(F.split(p[3], "\\.")).alias("pairs"),
        )

    return let(F.split(printed, "/"), levels)


def shared(a: Column, b: Column) -> Column:
    """How many entries two bags share. Where a bag repeats an entry, one walk over both, sorted together, counts each value on
    either side."""
    sets = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return let(F.array_intersect(a, b), lambda both: F.when((F.size(both) == 0) | sets, F.size(both)).otherwise(_walked(a, b)))


def _walked(a: Column, b: Column) -> Column:
    marked = lambda x, side: F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(side).alias("side")))
    none = F.struct(F.lit("").alias("v"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = s["v"] == x["v"]
        return F.struct(
            x["v"].alias("v"), F.when(same, s["a"]).otherwise(0).__add__(1 - x["side"]).alias("a"), F.when(same, s["b"]).otherwise(0).__add__(x["side"]).alias("b"),
            (s["n"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("n"),
        )

    return F.aggregate(F.sort_array(F.concat(marked(a, 0), marked(b, 1))), none, step, lambda s: s["n"] + F.least(s["a"], s["b"]))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two written trees: 1 if the roots are equal, else by the deepest level that both list."""

    def bags(x: Column, y: Column) -> Column:
        level = lambda n: (F.size(x[n]) > 0) & (F.size(y[n]) > 0)
        pick = lambda z: F.coalesce(*[F.when(level(n), z[n]) for n in LEVELS])
        return let(F.struct(pick(x).alias("a"), pick(y).alias("b")), lambda p: 2.0 * shared(p["a"], p["b"]) / (F.size(p["a"]) + F.size(p["b"])))

    both = let(_read(a), lambda x: let(_read(b), lambda y: F.when((F.size(x["sections"]) == 0) | (F.size(y["sections"]) == 0), F.lit(0.0)).otherwise(bags(x, y))))
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.lit(1.0)).otherwise(both)


def first_edit(a: Column, b: Column) -> Column:
    """section and paragraph (from 0) of the first branch of a that differs from b's; null if the roots are equal, and the
    paragraph is null where not both list them."""
    first = lambda x, y: F.get(F.filter(F.transform(x, lambda v, i: F.when(~v.eqNullSafe(F.get(y, i)), i)), lambda i: i.isNotNull()), F.lit(0))
    below = lambda x, i: F.split(F.get(F.split(F.get(x, i), ":"), F.lit(1)), "\\.")

    def descend(x: Column, y: Column) -> Column:
        at = F.coalesce(first(x, y), F.size(x))
        inside = lambda i: F.when(below(x, i).isNotNull() & below(y, i).isNotNull(), F.coalesce(first(below(x, i), below(y, i)), F.size(below(x, i))))
        return let(at, lambda i: F.struct(i.alias("section"), inside(i).alias("paragraph")))

    sections = lambda p: F.filter(F.split(F.split(p, "/")[1], ","), lambda s: s != "")
    found = let(sections(a), lambda x: let(sections(b), lambda y: descend(x, y)))
    return F.when(F.substring_index(a, "/", 1) != F.substring_index(b, "/", 1), found)


def edits(text: Column, other: Column) -> Column:
    """The spans (start, end in code points) of a text that another fingerprint does not have: sections whose node it lacks are
    opened, and of these the paragraphs whose node it lacks (all of them, if it lists none)."""

    def placed(paragraphs: Column) -> Column:
        """Where each paragraph begins, and the end: a running sum as one string of numbers, as an array would be copied at each step."""
        sums = F.aggregate(paragraphs, F.struct(F.lit(0).alias("at"), F.lit("0").alias("all")), lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"), F.concat(s["all"], F.lit(","), (s["at"] + F.length(p)).cast("string")).alias("all")), lambda s: s["all"])
        return F.split(sums, ",").cast("array<int>")

    def lacking(tree: Column, at: Column) -> Column:
        rows = F.flatten(F.transform(tree["sections"], lambda s: F.transform(s["paragraphs"], lambda p: F.struct(_digits(s["node"]).alias("s"), _digits(p).alias("p")))))
        lacks = lambda o, r: ~F.array_contains(o["sections"], r["s"]) & ~F.array_contains(o["paragraphs"], r["p"])
        spans = let(_read(other), lambda o: F.transform(rows, lambda r, i: F.when(lacks(o, r), F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end")))))
        return F.filter(spans, lambda x: x.isNotNull())

    return let(paragraphs_of(text), lambda p: let(tree_of(p), lambda t: let(placed(p), lambda at: lacking(t, at))))


def _range_of(key: Column, bounds: list[int], tie: Column) -> Column:
    """The number of bounds below the key, by halving steps; a key that is several bounds is spread over their ranges by its tie."""
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]

    def count(below) -> Column:
        return reduce(lambda at, s: let(at, lambda x: F.when(below(F.get(array, x + (s - 1))), x + s).otherwise(x)), steps, F.lit(0))

    lower = count(lambda b: b < key)
    if len(set(bounds)) == len(bounds):
        return lower
    upper = count(lambda b: b <= key)
    return lower + F.shiftright(tie * F.greatest(F.lit(1), upper - lower), 31).cast("int")


def followed(
    rows: DataFrame, key: str, text: str, derived: dict[str, Column], range_rows: int = RANGE_ROWS, ranges: int = RANGES
) -> DataFrame:
    """The rows with the derived columns, and next_c of the row that follows for the text and each derived column c; the first
    row follows the last. Derived columns are made of the text, once a row."""
    names = [key, text]
    k, tie, at, copied, least, to = [f"__{n}" for n in ("key", "tie", "range", "copied", "least", "to")]
    whole = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(1 << 63)))
    n = rows.select(key).count()
    parts = max(1, min(ranges, n // range_rows))
    share = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    bounds = rows.select(whole.alias(k)).agg(F.percentile_approx(k, share, F.lit(max(10_000, 10 * parts))).alias("q")).collect()[0].q if parts > 1 else []
    bounds = sorted(b for b in bounds or [] if b is not None)
    digest = F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`")), 33)
    placed = rows.withColumns({k: whole, tie: digest}).withColumn(at, _range_of(F.col(k), bounds, F.col(tie)) if bounds else F.lit(0))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy(at).agg(F.min(k)).collect())  # a row a range: RANGES at most
    if not firsts:
        return rows.select(*names).withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in (text, *derived)])
    before = [r for r, _ in firsts]
    heads = rows.sparkSession.createDataFrame([(r, m, before[i - 1]) for i, (r, m) in enumerate(firsts)], f"`{at}` int, `{least}` bigint, `{to}` int")
    first = placed.join(F.broadcast(heads), at).filter(F.col(k) == F.col(least))  # one row a range, unless keys repeat
    first = first.groupBy(to).agg(F.min(F.struct(k, tie, text)).alias("f")).select(F.col(to).alias(at), "f.*", F.lit(True).alias(copied))
    order = Window.partitionBy(at).orderBy(copied, k, tie, text)
    everything = placed.withColumn(copied, F.lit(False)).unionByName(first, allowMissingColumns=True).withColumns(derived)
    ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in (text, *derived)]
    return everything.select(*names, *derived, copied, *ahead).filter(~F.col(copied)).drop(copied)


def edited(text: Column, following: Column) -> Column:
    """The text whose last quarter is replaced by as much of the beginning of the one that follows."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compared(docs: DataFrame, text: str = "text", key: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, text, edited, both fingerprints, near_edited, near_next, edit (section and paragraph of the first branch that the
    edit changed) of every row."""
    rows = fingerprints(docs, text, key, range_rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    own, other = F.col("fingerprint"), F.col("edited_fingerprint")
    near = [likeness(own, other).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"), first_edit(own, other).alias("edit")]
    return rows.select("key", "text", "edited", own, other, *near)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, text, fingerprint, next_text, next_fingerprint of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(F.col(f"`{text}`")).alias("text"))
    return followed(rows, "key", "text", {"fingerprint": fingerprint(F.col("text"))}, range_rows)
