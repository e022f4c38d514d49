"""Write operators as relations: what a table holds after the write. None of them needs a lock, given one writer per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.codec import redact


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of new to append: those whose key is not there yet, one per key (the first by order)."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    if not order:
        return fresh.dropDuplicates(keys)
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new with existed: whether the key was there already."""
    there = existing.select(*keys, F.lit(True).alias("existed")).dropDuplicates(keys)
    return new.join(there, keys, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def upsert_pages(pages: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The page dimension after a run: first_seen_run_id stays, last_seen_run_id moves. seen: keys, run_id."""
    new = seen.select(*keys, F.col("run_id").alias("__run")).dropDuplicates(keys)
    both = pages.join(new, keys, "full")
    return both.withColumn("first_seen_run_id", F.coalesce("first_seen_run_id", "__run")).withColumn("last_seen_run_id", F.coalesce("__run", "last_seen_run_id")).drop("__run")


def first_write_wins(existing: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return existing.unionByName(insert_new(existing, new, keys, *order).select(*existing.columns))


def guarded_update(df: DataFrame, precondition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after the update, and one row with the number of rows it touched."""
    hit = F.coalesce(precondition, F.lit(False))
    out = df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
    return out, df.agg(F.count_if(hit).alias("affected"))


def delete_details(details: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Details left after those of runs go, and the number that goes per run. Details and runs meet by being counted together: a
    task holds a count per run and sorts no details, and no table of runs is sent to every task."""
    both = details.select("run_id", F.lit(1).alias("n"), F.lit(False).alias("goes")).unionByName(runs.select("run_id", F.lit(0).alias("n"), F.lit(True).alias("goes")))
    counted = both.filter("run_id is not null").groupBy("run_id").agg(F.sum("n").alias("deleted"), F.bool_or("goes").alias("goes"))
    gone = counted.filter("goes and deleted > 0").select("run_id", "deleted")
    return details.join(runs.select("run_id"), "run_id", "left_anti"), gone


def outbox_row(kind: Column, payload: Column, event_id: Column, now: Column) -> Column:
    return F.struct(
        event_id.alias("event_id"), kind.alias("type"), F.lit(1).alias("payload_version"), payload.alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), now.alias("available_at")
    )


def ack(events: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """events after workers answered: delivered, or with delay_s put back until then. Only the holder of the claim counts.

    answers: event_id, claim_token, delay_s (null: delivered), one row per event and token.
    """
    given = answers.select(F.col("event_id").alias("__id"), F.col("claim_token").alias("__token"), F.col("delay_s").alias("__delay"), F.lit(True).alias("__hit"))
    same = (F.col("event_id") == F.col("__id")) & (F.col("claim_token") == F.col("__token"))
    both = events.join(given, same, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    later = now + F.make_dt_interval(secs=F.col("__delay").cast("decimal(18,6)"))
    values = {"delivered_at": F.when(F.col("__delay").isNull(), now).otherwise(F.col("delivered_at")), "available_at": F.when(F.col("__delay").isNotNull(), later).otherwise(F.col("available_at"))}
    values |= {"claim_token": F.lit(None), "claim_until": F.lit(None)}
    return guarded_update(both, F.col("__hit"), values)[0].select(*events.columns)


def write_run(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the runs in df and no other: safe to run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def envelope(data: Column, request_id: Column) -> Column:
    return F.struct(data.alias("data"), request_id.alias("request_id"))


def error_status(code: Column) -> Column:
    """HTTP status of an error's class."""
    return F.when(code == "UNIQUE_VIOLATION", 409).when(code == "ROW_MISSING", 404).when(code == "INVALID_INPUT", 400).otherwise(500)


def audit_row(actor: Column, action: Column, details: Column, now: Column) -> Column:
    """An audit entry; its details are redacted before they are kept."""
    return F.struct(actor.alias("actor_id"), action.alias("action"), redact(details).alias("details"), now.alias("created_at"))
