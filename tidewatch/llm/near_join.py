"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of word 5-grams (fewer than five words: one gram, all the words). Equal sets are one class from the
start. The forest has TREES sorted prefix tries over signatures of DEPTH minima each:

1. A set's signature in a tree is matched by its longest prefix first, then by shorter ones, down to the prefix at which a
   pair at the threshold shares one in some tree with chance RECALL (prefix_depth); sets that share that prefix lie in one
   subtree, which is read as a sorted stream of signatures. A set is compared with the subtree's leaders only, those of the
   longest common prefix first, by all minima. It joins the leaders it resembles (CUT or more). The prefix is shortened
   until a leader is found that is all but equal (STOP or more): what resembles the set resembles that leader too. Without
   one it is shortened to the end, and the set becomes a leader itself unless it is close to one (CORE or more). As two
   documents at the threshold differ by 1 - threshold at most, a pair that meets in the subtree ends in one candidate
   group: either one of them is a leader, or both are close enough to leaders that resemble each other. No pairs within a
   subtree are made.
2. Candidate groups are the connected components of those joins.
3. Groups are verified exactly: sets meet in blocks of bounded size and the common grams of all pairs are counted through
   an inverted index within the block; what leaves is one row per set (its number of links) and spanning links. A group
   larger than a block is dealt out as pairs of blocks, so no task holds more than two blocks.
4. Classes are the connected components of the verified links.

Recall is that of the forest (RECALL at the threshold itself, higher above it); reported links are exact (grams are told
apart by 64 bits made of their words' digests).

Defined results: a null or empty text has no grams, is its own class and has no links; a null doc_id comes before all
others; copies count as links of each other (repeated rows too); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.anchors import _repeated, keyed, portions, row_key, runs
from tidewatch.llm.base import dropped, limits, materialised, private, release
from tidewatch.llm.components import components
from tidewatch.llm.rolling import BASES, Fingerprints, flat_texts, mix, word_bounds, word_symbols

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.9995
CUT, CORE, STOP = 0.45, 0.8, 0.95
#: Sets and grams of one block of a candidate group.
BLOCK_SETS, BLOCK_GRAMS = 2048, 4 << 20
#: Bytes of text worked on at once.
PORTION = 1 << 20


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The shortest prefix that has to be matched: the longest one that a pair of that similarity shares in some tree with the
    chance wanted."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def gram_sets(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram fingerprints of all texts, sorted within each, and the offset of each text's."""
    raw, offsets = flat_texts(texts)
    begin, _ = word_bounds(raw)
    symbols = word_symbols(raw)[0]
    first = np.searchsorted(begin, offsets)
    words = np.diff(first)
    prints = Fingerprints(symbols, BASES[1])
    every = prints.all(gram)
    sets = []
    for a, n in zip(first[:-1].tolist(), words.tolist(), strict=True):
        if n >= gram:
            h = np.sort(every[a : a + n - gram + 1])
            sets.append(h[np.append(True, h[1:] != h[:-1])])
        else:
            sets.append(prints.of(np.array([a]), n) if n else np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.append(0, np.cumsum(sizes))


_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
_ODD = _RNG.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

SKETCHES = "doc_id bigint, k bigint, rid bigint, n bigint, d1 bigint, d2 bigint, minima binary"


def _sketched(gram: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, PORTION)):
            h, offsets = gram_sets(batch.column("text").to_pylist(), gram)
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            at = offsets[:-1][some]
            out = np.zeros((len(n), minima), np.uint32)
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                d1[some] = np.add.reduceat(mix(h), at)
                d2[some] = np.add.reduceat(mix(h ^ np.uint64(BASES[0])), at)
                for j in range(minima):
                    out[some, j] = np.minimum.reduceat(((h ^ _FLIP[j]) * _ODD[j]) >> np.uint64(32), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 pa.array([r.tobytes() for r in out.astype(">u4")], pa.binary())],
                names=["doc_id", "k", "rid", "n", "d1", "d2", "minima"],
            )
        release()

    return run


def _subtrees(trees: int, depth: int, shortest: int):
    """Rows (route, k, rid) of each tree's subtree below the shortest prefix, in the form of anchors._repeated(). The tree's
    number is the route's last bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.frombuffer(b"".join(batch.column("minima").to_pylist()), ">u4").reshape(batch.num_rows, -1).astype(np.uint64)
            route = []
            for t in range(trees):
                h = np.full(len(m), t + 1, np.uint64)
                for j in range(shortest):
                    h = mix(h * np.uint64(BASES[1]) + m[:, t * depth + j])
                route.append(h // np.uint64(trees) * np.uint64(trees) + np.uint64(t))
            h = np.concatenate(route).view(np.int64)
            k, rid = (np.tile(batch.column(c).to_numpy(), trees) for c in ("k", "rid"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.zeros(len(h), np.int8)), pa.array(h), pa.array(k), pa.array(rid), pa.array(np.zeros(len(h), bool))],
                names=["route", "kind", "h", "k", "rid", "hit"],
            )

    return run


class Leaders:
    """One subtree's leaders: their minima, and the rest of their signatures in this tree."""

    def __init__(self):
        self.minima = np.zeros((0, 0), np.uint32)
        self.rest = np.zeros((0, 0), np.uint32)
        self.node: list[int] = []
        self.group: list[int] = []

    def find(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = self.group[self.group[i]]
            i = self.group[i]
        return i

    def add(self, node: int, minima: np.ndarray, rest: np.ndarray, group: int | None) -> None:
        n = len(self.node)
        if n == len(self.minima):
            grown = max(16, 2 * n)
            for name, row in (("minima", minima), ("rest", rest)):
                new = np.zeros((grown, len(row)), np.uint32)
                new[:n] = getattr(self, name)[:n] if n else 0
                setattr(self, name, new)
        self.minima[n], self.rest[n] = minima, rest
        self.node.append(node)
        self.group.append(n if group is None else group)

    def meet(self, node: int, minima: np.ndarray, rest: np.ndarray) -> list[tuple[int, int]]:
        """Joins of the set with leaders, by longest common prefix first."""
        n = len(self.node)
        out: list[tuple[int, int]] = []
        joined: list[int] = []
        best = 0.0
        if n:
            common = np.minimum.accumulate(self.rest[:n] == rest, axis=1).sum(1)  # of the rest of the signature
            for length in range(len(rest), -1, -1):
                there = np.flatnonzero(common == length)
                if not len(there):
                    continue
                like = (self.minima[there] == minima).mean(1)
                for i in there[like >= CUT].tolist():
                    if (root := self.find(i)) not in joined:
                        joined.append(root)
                        out.append((node, self.node[i]))
                best = max(best, float(like.max()))
                if best >= STOP:
                    break
            for r in joined[1:]:
                self.group[r] = joined[0]
        if best < CORE:
            self.add(node, minima, rest, joined[0] if joined else None)
        return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by route and the rest of the signature: joins (a, b) of candidates."""
    now, leaders = None, Leaders()
    for batch in batches:
        pairs: list[tuple[int, int]] = []
        for route, node, minima, rest in zip(*(batch.column(c).to_pylist() for c in ("route", "node", "minima", "rest")), strict=True):
            if route != now:
                now, leaders = route, Leaders()
            pairs += leaders.meet(node, np.frombuffer(minima, np.uint32), np.frombuffer(rest, np.uint32))
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, PORTION)):
            h, offsets = gram_sets(batch.column("text").to_pylist(), gram)
            cells = [h[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "node", "copies", "blocks")), pa.array(cells, pa.binary())], names=["root", "node", "copies", "blocks", "grams"])
        release()

    return run


def linked(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i the others at the threshold or above; with side, only those of the other side."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    if m < 2:
        return
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    head = runs(flat[order])
    gid = np.cumsum(head) - 1
    count = np.bincount(gid)
    gram = np.empty(len(flat), np.int64)
    gram[order] = gid
    posting, first = own[order], np.append(0, np.cumsum(count))
    at = np.append(0, np.cumsum(size))
    for i in range(m):
        g = gram[at[i] : at[i + 1]]
        g = g[count[g] > 1]
        if not len(g):
            continue
        c = count[g]
        rows = np.arange(c.sum()) + np.repeat(first[g] - (np.cumsum(c) - c), c)
        both = np.bincount(posting[rows], minlength=m)
        ok = both * (1 + threshold) >= threshold * (size[i] + size) - 1e-9
        ok[i] = False
        if side is not None:
            ok &= side != side[i]
        yield i, np.flatnonzero(ok)


LINKS = "node bigint, links bigint, other bigint"


def _verified(threshold: float):
    """From rows sorted by (root, part): links of each set, and spanning links (other: a set it is linked to)."""

    def block(cross: bool, nodes: list[int], copies: list[int], sides: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        weight = np.array(copies, np.int64)
        side = np.array(sides) if cross else None
        root = list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, n, b = [], [], []
        for i, others in linked(sets, side, threshold):
            if len(others):
                a.append(nodes[i])
                n.append(int(weight[others].sum()))
                b.append(nodes[i])
                mine = find(i)
                for j in np.unique([find(j) for j in others.tolist()]).tolist():
                    if j != mine:
                        root[j] = mine
                        a.append(nodes[i])
                        n.append(0)
                        b.append(nodes[j])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, n, b)], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "part", "cross", "node", "copies", "side", "grams")]
            for root, part, cross, node, copies, side, grams in zip(*cols, strict=True):
                if (root, part, cross) != now:
                    if held[0]:
                        yield block(now[2], *held)
                    now, held = (root, part, cross), ([], [], [], [])
                if held[0] and held[0][-1] == node:
                    continue  # a repeated row
                for x, v in zip(held, (node, copies, side, np.frombuffer(grams, np.uint64)), strict=True):
                    x.append(v)
        if held[0]:
            yield block(now[2], *held)

    return run


def _joined(docs: DataFrame, threshold: float, gram: int, text: str, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, k, rid of every row, with class_k, class_rid of its class's first document (null without grams) and n_links;
    and the tables that are read for it."""
    limits(docs.sparkSession)
    shortest = prefix_depth(threshold=threshold)
    depth = max(DEPTH, shortest)
    rows = keyed(docs, text, key)
    sketches = materialised(rows.mapInArrow(_sketched(gram, TREES * depth), SKETCHES))
    same = ["d1", "d2", "n"]
    kept = sketches.filter("n > 0").groupBy(*same).agg(F.min(F.struct("k", "rid")).alias("s"), F.count(F.lit(1)).alias("copies"), F.min("minima").alias("minima"))
    # The number of a set is fixed when the table is written; what reads the table sees the same one ever after.
    sets = materialised(kept.select(F.monotonically_increasing_id().alias("node"), "s.k", "s.rid", "copies", "minima", *same))
    hits = sets.select("k", "rid", "minima").mapInArrow(_subtrees(TREES, depth, shortest), "route bigint, kind tinyint, h bigint, k bigint, rid bigint, hit boolean")
    hits = hits.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated, "k bigint, rid bigint, h bigint").groupBy("k", "rid").agg(F.collect_list("h").alias("hs"))
    meeting = sets.select("k", "rid", "node", "minima").join(hits, ["k", "rid"]).select(F.explode("hs").alias("route"), "node", "minima")
    begin = F.pmod("route", F.lit(TREES)) * (4 * depth) + 4 * shortest + 1
    meeting = meeting.withColumn("rest", F.substring("minima", begin.cast("int"), F.lit(4 * (depth - shortest))))
    candidates = components(meeting.repartition("route").sortWithinPartitions("route", "rest", "node").mapInArrow(_met, "a bigint, b bigint"))
    members = candidates.union(candidates.select(F.col("root").alias("node"), "root").distinct())
    groups = materialised(sets.select("node", "k", "rid", "copies", "n").join(members, "node"))
    dropped(candidates)
    blocks = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    members = groups.join(blocks, "root").select("k", "rid", "root", "node", "copies", "blocks")
    # A merge join at every size: the texts are shuffled once, whether or not the groups would fit a broadcast just now.
    found = rows.join(members.hint("merge"), ["k", "rid"]).select("root", "node", "copies", "blocks", "text")
    found = found.mapInArrow(_sets(gram), "root bigint, node bigint, copies bigint, blocks int, grams binary")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A set of block s goes to each pair of blocks with s: part (lower, higher); one block: part 0.
    lower, higher = F.least("other", "side"), F.greatest("other", "side")
    dealt = found.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", "node", "copies", "side", "grams", (lower * F.col("blocks") + higher).alias("part"), (lower != higher).alias("cross"))
    dealt = dealt.repartition("root", "part").sortWithinPartitions("root", "part", "node")
    links = materialised(dealt.mapInArrow(_verified(threshold), LINKS))
    dropped(groups)
    classes = components(links.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    with_root = sets.select("node", "k", "rid", "copies", *same).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    least = with_root.groupBy("root").agg(F.min(F.struct("k", "rid")).alias("first"))
    result = with_root.join(least, "root").select(
        *same, F.col("first.k").alias("class_k"), F.col("first.rid").alias("class_rid"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")
    )
    return sketches.select("doc_id", "k", "rid", *same).join(result, same, "left"), [sketches, sets, links, classes]


def near_join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other documents at the threshold or above) of every row."""
    out, _ = _joined(docs, threshold, gram, text, key)
    class_id = F.coalesce("class_k", "k")
    least_long = F.lit(-(2**63)).cast("bigint")  # stands for a null doc_id
    return out.select("doc_id", F.when(class_id != least_long, class_id).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, gram: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with their own columns, of which one row of each class stays: that of its least doc_id.

    Of several rows with that doc_id (or of a class whose least doc_id is null) the one whose text's fingerprint is least
    stays, and of rows equal in doc_id and text one. A text without words is a class of its own with its doc_id.
    """
    found, tables = _joined(docs, threshold, gram, text, key)
    first = (F.col("k") == F.coalesce("class_k", "k")) & (F.col("rid") == F.coalesce("class_rid", "rid"))
    k, rid, nth = private(docs, "k", "rid", "nth")
    kept = materialised(found.filter(first).select(F.col("k").alias(k), F.col("rid").alias(rid)).distinct())
    dropped(*tables)
    own_k, own_rid = row_key(text, key)
    rows = docs.withColumns({k: own_k, rid: own_rid}).join(kept.hint("merge"), [k, rid], "left_semi")
    once = Window.partitionBy(k, rid).orderBy(F.lit(1))
    return rows.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
