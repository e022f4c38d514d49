"""Quota, limiter, schedules, retention, idempotency, outbox, leases: stateful control logic as relations over its history.

Time is always a parameter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import hot

# Limits of the service.
DAILY_MANUAL_RUNS, MANUAL_SPACING_S, DAY_S = 10, 300, 86_400
LIMITS = {"sign-in/email": (20, 900), "sign-up/email": (20, 3600), "send-verification-email": (10, 3600)}
RETENTION_DAYS, RETENTION_RUNS = 90, 20
MAX_DELIVERIES, MAX_VERIFICATION_ATTEMPTS, BACKOFF_S = 5, 3, 60
FETCH_RETRIES, FETCH_BACKOFF_S = 2, 5
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def crawl_quota(attempts: DataFrame, key: str = "project_id", at: str = "created_at", id_: str = "id") -> DataFrame:
    """Adds refused (DAILY_LIMIT, SPACING or null) to a key's runs, each judged by all its earlier runs in the trailing day."""
    t = seconds(F.col(at))
    w = Window.partitionBy(key).orderBy("__t")
    day = w.rangeBetween(-DAY_S, 0)
    before = Window.partitionBy(key).orderBy("__t", id_)
    one = attempts.withColumn("__t", t)
    n = F.count(F.lit(1)).over(day) - F.count(F.lit(1)).over(w.rangeBetween(0, 0)) + F.row_number().over(Window.partitionBy(key, "__t").orderBy(id_)) - 1
    last = F.lag("__t").over(before)
    return one.withColumn("refused", F.when(n >= DAILY_MANUAL_RUNS, "DAILY_LIMIT").when(last + MANUAL_SPACING_S > F.col("__t"), "SPACING")).drop("__t")


def folded(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ddl: str, fold: Callable[[], Callable[..., object]]) -> DataFrame:
    """Each key's rows in order through a fold that answers every row: linear, and no more than a batch is held.

    df: keys, then order, then further arguments of the fold. Rows of one key are one sorted stream in one task. fold() gives
    a fresh function of (order and further columns) for each key; ddl: the keys, the last order column, the answer.
    """
    answer = T._parse_datatype_string(ddl).names
    rest = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            out = []
            for key, *row in zip(own, *(batch.column(c).to_pylist() for c in rest), strict=True):
                if step is None or key != now:
                    now, step = key, fold()
                out.append(step(*row))
            columns = [*(batch.column(k) for k in keys), batch.column(order[-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=answer)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _ddl(df: DataFrame, columns: Sequence[str], answer: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), answer])


def limiter(most: int, window_s: int) -> Callable[[], Callable[[int, object], bool]]:
    """A fold over ascending times (seconds): whether each is allowed. Refused ones do not count; at most `most` are held."""

    def fold() -> Callable[[int, object], bool]:
        kept: deque[int] = deque()

        def step(t: int, _: object) -> bool:
            while kept and kept[0] <= t - window_s:
                kept.popleft()
            if len(kept) >= most:
                return False
            kept.append(t)
            return True

        return step

    return fold


def rate_limit(attempts: DataFrame, most: int, window_s: int, key: str = "subject", at: str = "ts", id_: str = "id", hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """key, id, allowed for every attempt of one route. A key of over hot_rows rows is spread over tasks."""
    rows = attempts.select(F.col(key), seconds(F.col(at)).alias("__t"), F.col(id_).alias("id"))
    others, many = hot.parted(rows, (key,), hot_rows)
    out = folded(others, (key,), ("__t", "id"), _ddl(rows, (key, "id"), "allowed boolean"), limiter(most, window_s))
    return out if many is None else out.unionByName(hot.hot_rate_limit(many, key, most, window_s))


SCHEDULES_PER_TICK = 20  # fixed value


def due_schedules(schedules: DataFrame, now: Column, take: int = SCHEDULES_PER_TICK) -> DataFrame:
    """What one tick of the scanner claims: enabled schedules that are due, the first `take` by project (a top-k)."""
    return schedules.filter(F.col("enabled") & (F.col("next_run_at") <= now)).orderBy("project_id").limit(take)


def schedule_scan(due: DataFrame, now: Column) -> DataFrame:
    """From schedules (project_id, next_run_at, interval_days, enabled, archived, busy, has_policy, verified): the occurrences
    to record and the next slot. project_id, scheduled_for, status."""
    gap = F.col("interval_days") * DAY_S
    t, n = seconds(F.col("next_run_at")), seconds(now)
    behind = F.when(n >= t, F.floor((n - t) / gap)).otherwise(-1)  # whole slots passed since the next one
    status = F.when(F.col("archived"), "SKIPPED_ARCHIVED").when(F.col("busy"), "SKIPPED_BUSY").when(F.col("has_policy") & ~F.col("verified"), "SKIPPED_UNVERIFIED").when(F.col("has_policy"), "TRIGGERED")
    rows = due.filter(F.col("enabled") & (t <= n)).withColumn("__behind", behind)
    slots = rows.select("project_id", F.explode(F.sequence(F.lit(0), F.col("__behind").cast("int"))).alias("i"), "__behind", t.alias("t"), gap.alias("gap"), status.alias("final"))
    out = slots.select(
        "project_id", F.timestamp_seconds(F.col("t") + F.col("i") * F.col("gap")).alias("scheduled_for"),
        F.when(F.col("i") < F.col("__behind"), "SKIPPED_MISSED").otherwise(F.col("final")).alias("status"),
    )
    return out.filter("status is not null")


def next_slot(next_run_at: Column, interval_days: Column, now: Column) -> Column:
    """First slot of the grid after now."""
    gap, t, n = interval_days * DAY_S, seconds(next_run_at), seconds(now)
    return F.timestamp_seconds(F.when(t > n, t).otherwise(t + (F.floor((n - t) / gap) + 1) * gap))


def scan_counters(occurrences: DataFrame, *keys: str) -> DataFrame:
    s = F.col("status")
    return occurrences.groupBy(*keys).agg(
        F.count_if(s == "TRIGGERED").alias("triggered"), F.count_if(s == "SKIPPED_MISSED").alias("missed"), F.count_if(s.startswith("SKIPPED") & (s != "SKIPPED_MISSED")).alias("skipped")
    )


def protected_runs(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Baselines of projects and bases of active runs."""
    active = runs.filter(~F.col("status").isin(*TERMINAL) & F.col("base_run_id").isNotNull()).select(F.col("base_run_id").alias("run_id"))
    return projects.filter("latest_published_run_id is not null").select(F.col("latest_published_run_id").alias("run_id")).union(active).distinct()


def retention_plan(runs: DataFrame, protected: DataFrame, now: Column, days: int = RETENTION_DAYS, keep: int = RETENTION_RUNS) -> DataFrame:
    """Terminal runs whose details go: older than days or beyond the newest keep of their project (protected ones hold a place), unless protected."""
    live = runs.filter(F.col("status").isin(*TERMINAL) & F.col("finished_at").isNotNull() & F.col("details_expired_at").isNull())
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("finished_at").desc(), F.col("run_id").desc())) - 1
    old = seconds(F.col("finished_at")) < seconds(now) - days * DAY_S
    return live.withColumn("rank", rank).filter(old | (F.col("rank") >= keep)).join(protected, "run_id", "left_anti")


def holder(ttl_s: int) -> Callable[[], Callable[[int, object, object], str]]:
    """A fold over ascending requests of one key: the first holds it for ttl_s."""

    def fold() -> Callable[[int, object, object], str]:
        held: list = []

        def step(t: int, _: object, hash_: object) -> str:
            if held and t < held[0] + ttl_s:
                return "REPLAY" if held[1] == hash_ else "CONFLICT"
            held[:] = [t, hash_]
            return "RUN"

        return step

    return fold


def idempotency(
    requests: DataFrame, ttl_s: int = DAY_S, key: tuple[str, ...] = ("actor_id", "workspace_id", "route", "key"), at: str = "ts", hash_: str = "request_hash", id_: str = "id",
    hot_rows: int = hot.HOT_ROWS,
) -> DataFrame:
    """key, id, outcome (RUN, REPLAY, CONFLICT) of requests: the first of a key runs and holds it for ttl_s; later ones meet it.
    A key of over hot_rows rows is spread over tasks."""
    rows = requests.select(*key, seconds(F.col(at)).alias("__t"), F.col(id_).alias("id"), F.col(hash_).alias("__h"))
    others, many = hot.parted(rows, key, hot_rows)
    out = folded(others, key, ("__t", "id"), _ddl(rows, (*key, "id"), "outcome string"), holder(ttl_s))
    return out if many is None else out.unionByName(hot.hot_idempotency(many, key, ttl_s))


def claimable(events: DataFrame, now: Column) -> Column:
    return F.col("delivered_at").isNull() & (F.col("available_at") <= now) & (F.col("claim_until").isNull() | (F.col("claim_until") < now))


def outbox_claim(events: DataFrame, kind: str, limit: int, now: Column) -> DataFrame:
    """The events a worker claims: due ones of a type, the longest waiting first."""
    return events.filter((F.col("type") == kind) & claimable(events, now)).orderBy("available_at", "event_id").limit(limit)


def delivery(attempts: Column, succeeded: Column, backoff_s: int = 90) -> Column:
    """What becomes of a claimed event, struct(status, delay_s); attempts counts its claims, this one included. One claimed too
    often is not tried again: FAILED."""
    answer = lambda status, delay: F.struct(F.lit(status).alias("status"), F.lit(delay).alias("delay_s"))
    return F.when(attempts > MAX_DELIVERIES, answer("FAILED", 0)).when(succeeded, answer("DELIVERED", 0)).otherwise(answer("PENDING", backoff_s))


def verification_retry(attempts: Column) -> Column:
    """Null when the job gives up, else seconds to wait."""
    return F.when(attempts < MAX_VERIFICATION_ATTEMPTS, attempts * BACKOFF_S)


def fetch_retry(attempts: Column) -> Column:
    return F.when(attempts <= FETCH_RETRIES, attempts * FETCH_BACKOFF_S)


def current_lease(claims: DataFrame) -> DataFrame:
    """Per run the claim of the greatest token; older holders are fenced off."""
    return claims.groupBy("run_id").agg(F.max_by(F.struct("worker", "token", "expires_at"), "token").alias("l")).select("run_id", "l.*")


def recovered(frontier: DataFrame) -> DataFrame:
    """After a crash: what was being fetched is pending again."""
    return frontier.withColumn("state", F.when(F.col("state") == "FETCHING", "PENDING").otherwise(F.col("state")))


def cancel(status: Column, lease_expires_at: Column, now: Column) -> Column:
    """IMMEDIATE for queued runs or without a live lease (one that ends now is not), COOPERATIVE under one; ended runs:
    ALREADY_FINISHED if cancelled, else CONFLICT."""
    ended = F.when(status == "CANCELLED", "ALREADY_FINISHED").when(status.isin(*TERMINAL), "CONFLICT")
    return ended.when((status == "QUEUED") | lease_expires_at.isNull() | (lease_expires_at <= now), "IMMEDIATE").otherwise("COOPERATIVE")


def acquire_leases(runs: DataFrame, now: Column, lease_s: int) -> DataFrame:
    """runs (status, lease_token, lease_expires_at) after a worker took each that is free, with acquired. A new holder raises the
    token, which fences the one before off; a run being finalized stays so."""
    free = ~F.col("status").isin(*TERMINAL) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    return runs.withColumn("acquired", free).withColumns({
        "status": F.when(free & (F.col("status") != "FINALIZING"), "RUNNING").otherwise(F.col("status")),
        "lease_token": F.col("lease_token") + free.cast("int"),
        "lease_expires_at": F.when(free, _after(now, lease_s)).otherwise(F.col("lease_expires_at")),
    })


def renew_leases(runs: DataFrame, held: DataFrame, now: Column, lease_s: int) -> DataFrame:
    """runs with renewed: active ones whose token is the holder's run on for lease_s from now. held: run_id, token, one row a run."""
    both = runs.join(held.select("run_id", F.col("token").alias("__held")), "run_id", "left")
    fine = F.coalesce(F.col("lease_token") == F.col("__held"), F.lit(False)) & ~F.col("status").isin(*TERMINAL)
    expires = F.when(fine, _after(now, lease_s)).otherwise(F.col("lease_expires_at"))
    return both.withColumns({"renewed": fine, "lease_expires_at": expires}).drop("__held")


def _after(now: Column, s: int) -> Column:
    return now + F.expr(f"make_dt_interval(0, 0, 0, {int(s)})")


def create_crawl(requests: DataFrame) -> DataFrame:
    """Adds error (null: accepted): the first guard that refuses, in the service's order."""
    c = F.col
    return requests.withColumn(
        "error",
        F.when(~c("role").isin("OWNER", "ADMIN", "MEMBER"), "FORBIDDEN").when(c("key").isNull() | (c("key") == "") | (F.length("key") > 200), "IDEMPOTENCY_KEY_REQUIRED")
        .when(c("replay"), None).when(~c("project_exists"), "NOT_FOUND").when(c("archived"), "ARCHIVED").when(c("block_reason").isNotNull(), c("block_reason"))
        .when(~c("has_policy"), "NO_POLICY").when(c("active"), "ALREADY_ACTIVE").when(c("runs_today") >= DAILY_MANUAL_RUNS, "DAILY_LIMIT")
        .when(c("seconds_since_last") < MANUAL_SPACING_S, "SPACING"),
    )


def admission() -> Callable[[], Callable[..., str]]:
    """A fold over a project's requests in time. An accepted one is active until it ends, counts for a day, sets the spacing and
    holds its key for a day; refused ones leave nothing. At most DAILY_MANUAL_RUNS accepted ones are held."""

    def fold() -> Callable[..., str]:
        held: deque[tuple[int, tuple, object]] = deque()  # accepted within a day: time, (actor, workspace, key), id
        until = last = None

        def step(t: int, id_: object, actor: object, workspace: object, key: object, lasts: int, early: str | None, late: str | None) -> str:
            nonlocal until, last
            while held and held[0][0] < t - DAY_S:
                held.popleft()
            if early:
                return early
            again = next((i for at, k, i in held if k == (actor, workspace, key) and t < at + DAY_S), None)
            if again is not None:
                return f"REPLAY {again}"
            refused = late or ("ALREADY_ACTIVE" if until is not None and until > t else "DAILY_LIMIT" if len(held) >= DAILY_MANUAL_RUNS else "SPACING" if last is not None and last + MANUAL_SPACING_S > t else None)
            if refused:
                return refused
            held.append((t, (actor, workspace, key), id_))
            until, last = t + lasts, t
            return "ACCEPTED"

        return step

    return fold


@dataclass
class Admitted:
    """What requests for crawls come to, and the rows that accepted ones write."""

    decisions: DataFrame
    runs: DataFrame
    outbox: DataFrame
    audit: DataFrame


def admit(requests: DataFrame) -> Admitted:
    """Requests for crawls, each judged by all that were accepted before it in its project.

    requests: id, project_id, workspace_id, actor_id, role, key, at, lasts_s (how long the crawl goes on if it is accepted),
    policy_id and, of the project: project_exists, archived, block_reason. decisions: project_id, id, outcome (ACCEPTED, REPLAY or the error),
    run_id (of an accepted request or the one that it repeats).
    """
    c = F.col
    idle = {"replay": F.lit(False), "active": F.lit(False), "runs_today": F.lit(0), "seconds_since_last": F.lit(None).cast("long"), "has_policy": c("policy_id").isNotNull()}
    judged = create_crawl(requests.withColumns(idle))
    first = c("error").isin("FORBIDDEN", "IDEMPOTENCY_KEY_REQUIRED")
    rows = judged.select(
        "project_id", seconds(c("at")).alias("__t"), "id", "actor_id", "workspace_id", "key", c("lasts_s").cast("long").alias("__lasts"), F.when(first, c("error")).alias("__early"), F.when(~first, c("error")).alias("__late")
    )
    said = folded(rows, ("project_id",), ("__t", "id"), _ddl(rows, ("project_id", "id"), "said string"), admission())
    outcome = F.split("said", " ")
    kind = outcome[0]
    run = lambda i: F.concat_ws("/", "project_id", i.cast("string"))
    decisions = said.select("project_id", "id", kind.alias("outcome"), F.when(kind == "ACCEPTED", run(c("id"))).when(kind == "REPLAY", run(outcome[1])).alias("run_id"))
    made = requests.join(decisions.filter("outcome = 'ACCEPTED'"), ["project_id", "id"])
    nothing = F.lit(None).cast("string")
    runs = made.select(
        "run_id", "project_id", "policy_id", F.lit("MANUAL").alias("trigger"), F.lit("QUEUED").alias("status"), nothing.alias("base_run_id"), F.lit(0).alias("lease_token"), c("at").alias("created_at")
    )
    payload = F.to_json(F.struct(c("workspace_id").alias("workspaceId"), c("project_id").alias("projectId"), c("run_id").alias("crawlId")))
    outbox = made.select(F.inline(F.array(F.struct(
        F.concat(c("run_id"), F.lit(":requested")).alias("event_id"), F.lit("crawl.requested").alias("type"), c("run_id").alias("aggregate_id"), F.lit(1).alias("payload_version"), payload.alias("payload"),
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), c("at").alias("available_at"),
    ))))
    audit = made.select("workspace_id", "actor_id", F.lit("crawl.created").alias("action"), c("run_id").alias("resource_id"), F.to_json(F.struct(c("project_id").alias("projectId"), F.lit("MANUAL").alias("trigger"))).alias("details"), c("at").alias("created_at"))
    return Admitted(decisions, runs, outbox, audit)


def claims(events: DataFrame, kind: str, workers: list[str], limit: int, now: Column, claim_s: int = 30) -> DataFrame:
    """What several workers claim at once: the first due events of a type, `limit` for each, dealt in turn, so no event goes to two
    and each worker has its own in the order in which they wait. A claim has its worker, a batch number and an end; ack() takes
    an answer only with the claim's token, so a worker whose claim has ended is fenced off.

    The scan keeps a top-k of limit x workers; only these are ranked.
    """
    top = outbox_claim(events, kind, limit * len(workers), now)
    place = F.row_number().over(Window.orderBy("available_at", "event_id")) - 1  # over limit x workers rows at most
    dealt = top.withColumn("__n", place).withColumn("claimed_by", F.element_at(F.array(*map(F.lit, workers)), (F.col("__n") % len(workers)).cast("int") + 1))
    turn = F.floor(F.col("__n") / len(workers)).cast("int")
    token = F.concat_ws(":", "claimed_by", F.unix_micros(now.cast("timestamp")).cast("string"), F.col("event_id").cast("string"))
    return dealt.withColumns({"claim_order": turn, "claim_token": token, "claim_until": _after(now, claim_s)}).drop("__n")


def prune_counters(*counts: DataFrame) -> DataFrame:
    """Rows deleted in all, over the per-run counts of several tables."""
    out = counts[0].select("deleted")
    for c in counts[1:]:
        out = out.union(c.select("deleted"))
    return out.agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


def stale_transitions(transitions: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Transitions that go by age alone."""
    return transitions.filter(seconds(F.col("created_at")) < seconds(now) - days * DAY_S)
