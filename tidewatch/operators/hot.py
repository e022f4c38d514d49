"""Limiter and idempotency of keys that hold more rows than one task should read.

Both are folds over a key's requests in time, so a key is one sorted stream. Here a hot key's rows are spread, and what has to go in
order is small:

- The holder of an idempotency key is the first request at or after the end of the one before. That is a pointer from each
  second to the next holder's: it is found among the seconds one ttl ahead, and pointer doubling (jumps of 1, 2, 4, ... holders) marks
  those that the first request leads to, in as many joins as the number of holders has bits. Two holders are never in
  one slot of ttl seconds, so a request finds its holder by an equi-join with its own slot and the one before.
- The limiter's requests are counted by second first. Seconds go to chunks of time that start with nothing allowed before
  them, and each hands the times it has allowed to the next one: chunks whose beginning has changed run again, until none has.
  Chunk k is right after k rounds at the latest, and sooner where a pause or enough refusals make a chunk forget its
  beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import stored

#: Rows from which on a key is hot.
HOT_ROWS = 1_000_000
#: Windows in a chunk of a limiter's time.
CHUNK_WINDOWS = 64


def parted(rows: DataFrame, keys: tuple[str, ...], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of hot keys or None). There are at most rows / hot_rows hot keys."""
    hot = stored(rows.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    if hot.isEmpty():
        return rows, None
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = F.broadcast(hot)
    return rows.join(both, same, "left_anti"), rows.join(both, same, "left_semi")


def _keyed(keys: tuple[str, ...]):
    """One column that stands for the keys, null ones included."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__k")


def _next_holders(nodes: DataFrame, ttl_s: int) -> DataFrame:
    """k, t, next: the first second of k at or after t + ttl_s, null if there is none. nodes: k, t (distinct)."""
    slot = F.floor(F.col("t") / ttl_s)
    placed = nodes.withColumn("slot", slot)
    askers = placed.select("k", (F.col("slot") + 1).alias("slot"), (F.col("t") + ttl_s).alias("at"), F.lit(None).cast("long").alias("target"), "t")
    targets = placed.select("k", "slot", F.col("t").alias("at"), F.col("t").alias("target"), F.lit(None).cast("long").alias("t"))
    down = Window.partitionBy("k", "slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = askers.unionByName(targets).withColumn("near", F.min("target").over(down)).filter("t is not null").select("k", (F.col("slot") - 1).alias("slot"), "t", "near")
    # where the slot ahead has none, the first second of the next slot that has any
    slots = placed.groupBy("k", "slot").agg(F.min("t").alias("first"))
    w = Window.partitionBy("k").orderBy("slot")
    one, two = F.lead("first").over(w), F.lead("first", 2).over(w)
    far = slots.select("k", "slot", F.when(F.lead("slot").over(w) > F.col("slot") + 1, one).otherwise(two).alias("far"))
    return near.join(far, ["k", "slot"]).select("k", "t", F.coalesce("near", "far").alias("next"))


def holders(nodes: DataFrame, ttl_s: int) -> DataFrame:
    """k, t of the seconds at which a request begins to hold its key. nodes: k, t (distinct)."""
    jump = stored(_next_holders(nodes, ttl_s).filter("next is not null"))
    found = stored(nodes.groupBy("k").agg(F.min("t").alias("t")))
    while not jump.isEmpty():
        new = found.join(jump, ["k", "t"]).select("k", F.col("next").alias("t"))
        grown = stored(found.unionByName(new))
        further = jump.select("k", F.col("t").alias("next"), F.col("next").alias("far"))
        found, jump = grown, stored(jump.join(further, ["k", "next"]).select("k", "t", F.col("far").alias("next")))
    return found


def hot_idempotency(rows: DataFrame, keys: tuple[str, ...], ttl_s: int) -> DataFrame:
    """keys, id, outcome of rows (keys, __t seconds, id, __h hash); ids are unique within a key."""
    named = rows.withColumn("__k", _keyed(keys))
    firsts = stored(named.groupBy("__k", "__t").agg(F.min(F.struct("id", "__h")).alias("f")).select(F.col("__k").alias("k"), F.col("__t").alias("t"), "f"))
    held = holders(firsts.select("k", "t"), ttl_s).join(firsts, ["k", "t"])
    slot = lambda c: F.floor(F.col(c) / ttl_s)
    spread = held.select("k", F.explode(F.array(slot("t"), slot("t") + 1)).alias("slot"), F.col("t").alias("since"), "f")
    met = named.withColumn("slot", slot("__t")).join(spread, (F.col("__k") == F.col("k")) & (named["__t"] >= F.col("since")) & (named["__t"] < F.col("since") + ttl_s) & (F.floor(named["__t"] / ttl_s) == spread["slot"]))
    outcome = F.when(F.col("f.id") == F.col("id"), "RUN").when(F.col("f.__h").eqNullSafe(F.col("__h")), "REPLAY").otherwise("CONFLICT")
    return met.select(*keys, "id", outcome.alias("outcome"))


def _run(seconds: DataFrame, most: int, window_s: int, ddl: str, every: bool) -> DataFrame:
    """Each chunk of seconds (k, chunk, t, n, before) in order: with every, (k, t, m) of each second, else (k, chunk, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        allowed: list[int] = []
        for batch in batches:
            ks, chunks, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, chunk, t, n, before in zip(ks, chunks, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if (k, chunk) != now:
                    if now and not every:
                        out.append((*now, allowed))
                    now, allowed = (k, chunk), list(before)
                allowed = [x for x in allowed if x > t - window_s]
                m = min(n, most - len(allowed))
                allowed += [t] * m
                if every:
                    out.append((k, t, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i < 2 or every else pa.array(c, pa.list_(pa.int64())) for i, c in enumerate(zip(*out, strict=True))], names=names)
        if now and not every:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([allowed], pa.list_(pa.int64()))], names=names)

    names = ["k", "t", "m"] if every else ["k", "chunk", "after"]
    return seconds.select("k", "chunk", "t", "n", "before").repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t").mapInArrow(run, ddl)


def hot_rate_limit(rows: DataFrame, key: str, most: int, window_s: int, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """key, id, allowed of rows (key, __t seconds, id); ids are unique within a key."""
    named = rows.withColumn("__k", _keyed((key,)))
    width = window_s * chunk_windows
    seconds = stored(named.groupBy(F.col("__k").alias("k"), F.col("__t").alias("t")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n")).withColumn("chunk", F.floor(F.col("t") / width)))
    none = F.array().cast("array<bigint>")
    begin = stored(seconds.select("k", "chunk").distinct().withColumn("before", none))
    ends, todo = None, begin
    while not todo.isEmpty():
        ran = stored(_run(seconds.join(todo, ["k", "chunk"]), most, window_s, "k string, chunk long, after array<bigint>", False))
        ends = ran if ends is None else stored(ends.join(ran, ["k", "chunk"], "left_anti").unionByName(ran))
        handed = F.lag("after").over(Window.partitionBy("k").orderBy("chunk"))  # a row a chunk
        now = stored(ends.select("k", "chunk", F.coalesce(handed, none).alias("before")))
        changed = now.join(begin.withColumnRenamed("before", "was"), ["k", "chunk"]).filter(F.col("before") != F.col("was"))
        begin, todo = now, stored(changed.select("k", "chunk", "before"))
    allowed = _run(seconds.join(begin, ["k", "chunk"]), most, window_s, "k string, t long, m long", True)
    rank = F.row_number().over(Window.partitionBy("__k", "__t").orderBy("id"))
    front = named.withColumn("__n", rank).filter(F.col("__n") <= most)  # the first of each second, before the shuffle
    winners = front.join(allowed, (F.col("__k") == F.col("k")) & (F.col("__t") == F.col("t"))).filter(F.col("__n") <= F.col("m")).select("__k", "id", F.lit(True).alias("allowed"))
    return named.join(winners, ["__k", "id"], "left").select(key, "id", F.coalesce("allowed", F.lit(False)).alias("allowed"))
