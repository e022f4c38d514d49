"""Stateful streams: sliding-window limiter, outbox deliveries, idempotent first-of-key, incremental publication.

State is kept per key in Spark's state store and bounded: the limiter keeps at most `most` times and forgets a subject that was
silent for a window, a delivery is one counter that is forgotten DELIVERY_TTL_S after its last attempt, first-of-key keeps one
row within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.ledger import Ledger
from tidewatch.operators.operations import DAY_S, MAX_DELIVERIES

#: How long a delivery's counter outlives its last attempt.
DELIVERY_TTL_S = 7 * DAY_S


def _timeout(forget: bool) -> str:
    """State that waits for its time keeps a stream in batches: one with an availableNow trigger would never end, so it has to
    be told not to forget."""
    return GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout


def limiter(attempts: DataFrame, most: int, window_s: int, forget: bool = True) -> DataFrame:
    """id, subject, t, allowed for a stream of (id bigint, subject string, t bigint seconds). Refused attempts do not count.

    Within a trigger a subject's attempts are judged by time; attempts of a later trigger come after those of an earlier one.
    """

    def judge(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        ok = []
        for t in rows["t"]:
            kept = [x for x in kept if x > t - window_s]
            ok.append(len(kept) < most)
            if ok[-1]:
                kept.append(int(t))
        state.update((kept,))
        if forget:
            state.setTimeoutDuration(window_s * 1000)
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "subject": key[0], "t": rows["t"].to_numpy(), "allowed": ok})

    return attempts.groupBy("subject").applyInPandasWithState(
        judge, "id bigint, subject string, t bigint, allowed boolean", "kept array<bigint>", "append", _timeout(forget)
    )


def deliveries(attempts: DataFrame, forget: bool = True) -> DataFrame:
    """event_id, attempts, status for a stream of delivery attempts (event_id string, succeeded boolean): DELIVERED, PENDING, or FAILED after MAX_DELIVERIES."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, status = state.get if state.exists else (0, "PENDING")
        for frame in frames:
            for ok in frame["succeeded"]:
                if status == "PENDING":
                    n += 1
                    status = "DELIVERED" if ok else "FAILED" if n >= MAX_DELIVERIES else "PENDING"
        state.update((n, status))
        if forget:
            state.setTimeoutDuration(DELIVERY_TTL_S * 1000)
        yield pd.DataFrame({"event_id": [key[0]], "attempts": [n], "status": [status]})

    return attempts.groupBy("event_id").applyInPandasWithState(step, "event_id string, attempts int, status string", "attempts int, status string", "update", _timeout(forget))


def first_of_key(requests: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The first request of each key within ttl: state of older keys is dropped by the watermark."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_changes(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts of changes by type in tumbling windows; rows later than `late` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "change_type").agg(F.count(F.lit(1)).alias("n"))


def publish_stream(
    observations: DataFrame, publish_batch: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str, keys: tuple[str, ...] = ("run_id", "page_id")
) -> Any:
    """Publishes arriving observations batch by batch; publish_batch gives tables by name, each with run_id.

    Observations are kept under path/observations, one folder per run and batch, so a batch that is tried again writes the
    same rows. A run's tables are made of all its observations so far (the first of each key) and replaced as a whole: a run
    may arrive in any number of batches. publish_batch sees the batch's runs alone, so its tables must not look back at
    earlier runs: for publication with baselines and issues see ledger_stream().
    """
    schema = observations.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = f"{path}/observations"
        arrived = batch.withColumn("batch", F.lit(number))
        arrived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(there)
        own = [f for f in schema if f.name != "run_id"]
        layout = T.StructType([*own, schema["run_id"], T.StructField("batch", T.IntegerType())])
        every = spark.read.schema(layout).parquet(there)
        runs = every.filter(F.col("batch") == number).select("run_id").distinct()
        known = every.join(runs, "run_id", "left_semi")
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("batch"))
        merged = known.withColumn("__n", first).filter("__n = 1").select(*schema.names).persist()
        for name, table in publish_batch(merged).items():
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
        merged.unpersist()

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_stream(ended: DataFrame, observations: Callable[[], DataFrame], folder: str, checkpoint: str, suppressed: Callable[[], DataFrame] | None = None) -> Any:
    """Publishes runs as they end, each batch against what was published before (see ledger): baseline, issues and their
    occurrence carry over from batch to batch. ended: project_id, run_id and, where known, token; observations() and
    suppressed() give the present tables. A batch that is tried again finds its runs in the ledger."""

    def publish(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, folder).publish(batch, observations(), suppressed() if suppressed else None)

    return ended.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
