"""Hot keys: the same answers as the folds over one sorted stream, in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import hot, operations
from tidewatch.sources.tables import stored


def attempts(spark, seed, n, span):
    """Half of all rows have one key; others few, null ones included."""
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None, "c"]), r.randint(0, span), i, r.choice("xyz")) for i in range(n)]
    return spark.createDataFrame(rows, "subject string, t long, id long, request_hash string").withColumn("ts", F.timestamp_seconds("t"))


def answers(df, what):
    return sorted((r.id, r[what]) for r in df.collect())


@pytest.mark.parametrize(("seed", "n", "span", "ttl"), [(1, 900, 5000, 100), (3, 400, 60_000, 97), (4, 300, 40, 1000)])
def test_holders_by_pointer_doubling(spark, seed, n, span, ttl):
    df = attempts(spark, seed, n, span)
    key = ("subject",)
    plain = answers(operations.idempotency(df, ttl, key), "outcome")
    assert answers(operations.idempotency(df, ttl, key, hot_rows=5), "outcome") == plain
    assert {o for _, o in plain} >= {"RUN"}


@pytest.mark.parametrize(("seed", "n", "span", "most", "window"), [(1, 900, 5000, 3, 100), (2, 500, 300, 2, 7)])
def test_limiter_by_chunks(spark, seed, n, span, most, window, monkeypatch):
    df = attempts(spark, seed, n, span)
    plain = answers(operations.rate_limit(df, most, window), "allowed")
    assert answers(operations.rate_limit(df, most, window, hot_rows=5), "allowed") == plain
    rows = stored(df.filter("subject = 'hot'").select("subject", F.col("t").alias("__t"), "id"))
    want = [x for x in plain if x[0] in {r.id for r in rows.collect()}]
    assert answers(hot.hot_rate_limit(rows, "subject", most, window, chunk_windows=2), "allowed") == want  # many chunks


def test_half_of_all_rows_in_one_key(spark):
    """200,000 rows, half of one key: every task of the hot part reads a share of them."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 5000)).alias("subject"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), "id", (F.col("id") % 3).cast("string").alias("request_hash"))
    quick = stored(operations.idempotency(df, 600, ("subject",), hot_rows=50_000))
    slow = stored(operations.idempotency(df, 600, ("subject",)))
    assert quick.exceptAll(slow).isEmpty() and slow.exceptAll(quick).isEmpty()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    hot_rows = stored(df.filter("subject = 'hot'").select("subject", (F.col("id") * 3).alias("__t"), "id"))
    parts = stored(hot._next_holders(hot_rows.select(F.col("subject").alias("k"), F.col("__t").alias("t")), 600).withColumn("p", F.spark_partition_id()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert parts.select("p").distinct().count() >= 4 and parts.count() == n // 2
