"""Point, filtered and first-match scans over Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only a local master may go without, with a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and (now := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        there = now.get()
    if not there:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once, as a Parquet table in the shared folder. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """The rows, computed once, as a table in the shared folder that is bucketed and sorted by key.

    Tables with as many buckets (by default as many as shuffle partitions) join and aggregate by key, or by key and
    more columns, without an exchange, and a filter on one key reads one bucket. A bucket is read by one task, so this is
    for tables that are read key by key. The table goes when the application ends.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidewatch_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # (key, more) is met by buckets of key
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.table(name)


def version(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: another version gives another value."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(there)))


def find_unique(df: DataFrame, condition: Column) -> DataFrame:
    """The row with a unique key: the predicate goes to the scan, two rows at most come back."""
    return df.filter(condition).limit(2)


def find_unique_or_fail(df: DataFrame, condition: Column) -> DataFrame:
    rows = find_unique(df, condition)
    n = rows.count()
    if n != 1:
        raise LookupError(f"expected one row, found {'none' if n == 0 else 'more'}")
    return rows


def find_many(df: DataFrame, condition: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    return rows.select(*columns) if columns else rows


def find_first(df: DataFrame, condition: Column | None, *order: Column) -> DataFrame:
    """The first row by order: planned as a top-1, not as a sort."""
    return find_many(df, condition).orderBy(*order).limit(1)


def ready(spark: SparkSession) -> DataFrame:
    """One row when the engine can run a job at all."""
    return spark.range(1).selectExpr("cast(1 as int) as ok")
