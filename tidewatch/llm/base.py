"""What the operators of this subpackage share: reading tables, Arrow batches, checkpoints, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch sent to a Python worker; bounds a worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def limits(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limits(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives freed memory back to the system: workers stay alive between stages and count against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema, after: Callable[[], None] | None = None
) -> DataFrame:
    """Arrow batches through a function, one at a time; after is called when a task's batches are through."""
    limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)
        if after:
            after()
        release()

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local master, where driver and executors are one
    process, may go without: then a temporary folder is made and set."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not there and (now := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        there = now.get()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The path and its file system, as the JVM has them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialised(df: DataFrame) -> DataFrame:
    """The rows, computed once, as a Parquet table in the shared folder: survives lost executors, cuts the lineage.

    The table goes when the application ends, or with dropped() as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there, files = _files(spark, path)
    files.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewatch_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes tables of materialised(); anything else is left alone. No plan that reads them may be run afterwards."""
    for table in tables:
        if path := getattr(table, "_tidewatch_path", None):
            there, files = _files(table.sparkSession, path)
            files.delete(there, True)


def private(df: DataFrame, *wanted: str) -> list[str]:
    """A column name for each of wanted that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(docs: DataFrame, text: str, keep: tuple[str, ...], made: tuple[str, ...]) -> tuple[DataFrame, str, list[str], str]:
    """The columns named in keep and the whole text: rows, DDL of the kept columns, their names, the text column's name.

    A kept column that bears the name of one that the operator makes (whatever the case) is carried with _ appended.
    """
    taken = {m.lower() for m in made}
    columns: list[Column] = []
    names: list[str] = []
    for c in dict.fromkeys(keep):
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
        columns.append(F.col(f"`{c}`").alias(name))
    own = "text"
    while own.lower() in taken:
        own += "_"
    rows = docs.select(*columns, text_of(F.col(f"`{text}`")).alias(own))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != own)
    return rows, ddl, names, own


def text_of(col: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]
