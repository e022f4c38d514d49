import datetime as dt

from tidewatch.streaming import state


def run(spark, df, path, query, name, mode):
    df.write.parquet(str(path))
    stream = spark.readStream.schema(df.schema).parquet(str(path))
    q = query(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_limiter(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", i) for i in range(5)] + [(9, "u", 100), (10, "v", 1)], "id long, subject string, t long").coalesce(1)
    got = {r.id: r.allowed for r in run(spark, df, tmp_path / "a", lambda s: state.limiter(s, 3, 50, forget=False), "limited", "append")}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True, 10: True}


def test_deliveries(spark, tmp_path):
    df = spark.createDataFrame([("bad", False)] * 6 + [("good", False), ("good", True)], "event_id string, succeeded boolean").coalesce(1)
    got = {r.event_id: (r.attempts, r.status) for r in run(spark, df, tmp_path / "b", lambda s: state.deliveries(s, forget=False), "delivered", "update")}
    assert got == {"bad": (5, "FAILED"), "good": (2, "DELIVERED")}


def test_first_of_key_and_windows(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("k", t), ("k", t), ("m", t)], "key string, ts timestamp").coalesce(1)
    assert sorted(r.key for r in run(spark, df, tmp_path / "c", lambda s: state.first_of_key(s, ["key"], "ts", "1 day"), "firsts", "append")) == ["k", "m"]
    ev = spark.createDataFrame([("A", t), ("A", t), ("B", t)], "change_type string, ts timestamp").coalesce(1)
    assert {r.change_type: r.n for r in run(spark, ev, tmp_path / "d", lambda s: state.windowed_changes(s, "ts", "1 hour", "1 hour"), "windows", "complete")} == {"A": 2, "B": 1}


def test_publish_stream_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run_id string, page_id int").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for n in range(2):
        state.publish_stream(stream(), lambda b: {"pages": b}, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/pages")).count() == 3


def test_a_run_over_two_batches_is_published_whole(spark, tmp_path):
    schema = "run_id string, page_id int, title string"
    there = str(tmp_path / "in")
    go = lambda: state.publish_stream(
        spark.readStream.schema(schema).parquet(there), lambda b: {"pages": b, "sizes": b.groupBy("run_id").count()}, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination(120)
    spark.createDataFrame([("r1", 1, "a"), ("r1", 2, "b"), ("r2", 1, "c")], schema).coalesce(1).write.parquet(there)
    go()
    spark.createDataFrame([("r1", 3, "d"), ("r1", 2, "late")], schema).coalesce(1).write.mode("append").parquet(there)
    go()
    got = sorted((r.run_id, r.page_id, r.title) for r in spark.read.parquet(str(tmp_path / "out/pages")).collect())
    assert got == [("r1", 1, "a"), ("r1", 2, "b"), ("r1", 3, "d"), ("r2", 1, "c")]
    assert {r.run_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out/sizes")).collect()} == {"r1": 3, "r2": 1}
