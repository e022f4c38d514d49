"""Details that go with their runs: counted with the runs, not sorted for a join with them."""

from pyspark.sql import functions as F

from tidewatch.operators.writes import delete_details


def test_details_are_counted_without_a_join(spark):
    details = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "run_id string")
    runs = spark.createDataFrame([("a",), ("a",), ("c",), ("without",), (None,)], "run_id string")
    left, gone = delete_details(details, runs)
    assert sorted(map(tuple, gone.collect())) == [("a", 2), ("c", 1)]
    assert sorted((r.run_id or "") for r in left.collect()) == ["", "b"]
    large = spark.range(1000).select((F.col("id") % 10).cast("string").alias("run_id"))
    plan = delete_details(large, large.filter("run_id < '5'"))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
