"""Publication written once and fenced: runs are published as they end, batch by batch, each against what was published before.

A batch reads its own runs' observations, those of their baselines (the run of the same project and policy that was published
last) and the issues as the project's last published run left them; so its work grows with the batch, not with what is there.
It writes change events, issues, transitions and summaries under an attempt of its own, and nobody sees them yet.

A run counts as published by one commit: entry n + 1 of its project's ledger, a file that can be created but once. So two
writers of one project are told apart by the file system (create without overwrite, which object stores and HDFS do
atomically): one has entry n + 1, the other finds it taken and looks again. Whose run is in the ledger is a replay; whose
baseline has moved computes its run anew, in a further round. A writer also needs the run's lease: its token must still be the
highest. Readers follow the ledger: rows of attempts without an entry are never seen, and sweep() removes them.

Files: ledger/<project's digest>/<n>.json, leases/<run's digest>/<token>, <table>/attempt=<id>/ (sorted by project, so a project's
rows are few row groups). The driver holds the batch's runs and the last entries of their projects, nothing by page.

Defined results: runs that are not FULL get their decision and publish nothing; a run named twice in a batch is published once;
an empty batch changes nothing; a suppression counts while its end is not before the run's.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import diff, rules
from tidewatch.operators.health import health
from tidewatch.operators.publish import completeness, publish_gate, run_facts

RUN = "project_id string, run_id string, run_no long, policy_id string, scope_generation long, rule_version long, finished_at timestamp_ntz, base_run_id string, prior_attempt string, observed long, http_count long"
_KEYS = "project_id string, run_id string, run_no long, page_id long"
_SCOPE = "scope_generation long, rule_version long, rule_key string"
TABLES = {
    "events": f"{_KEYS}, change_type string, severity string, before string, after string",
    "issues": f"{_KEYS}, {_SCOPE}, from_state string, state string, occurrence int, last_evaluated_run_id string, last_confirmed_run_id string, evidence map<string,string>, own boolean",
    "transitions": f"{_KEYS}, rule_key string, from_state string, to_state string, occurrence int, idempotency_key string",
    "summary": "project_id string, run_id string, run_no long, policy_id string, finished_at timestamp_ntz, comparison_mode string, base_run_id string, urls_crawled long, total long, critical long, "
    "warning long, info long, affected_pages long, issues_open long, issues_resolved long, health_score long, health_score_version long, health_coverage double, reason string",
}
ENTRY = "project_id string, n long, run_id string, run_no long, policy_id string, attempt string, token long, base_run_id string"
ROUNDS = 20


def _digest(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


@dataclass
class Ledger:
    """The published tables of a folder that all writers share."""

    spark: SparkSession
    folder: str

    def _path(self, *parts: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return there, there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list[str]:
        there, files = self._path(*parts)
        return sorted(x.getPath().getName() for x in files.listStatus(there)) if files.exists(there) else []

    def _created(self, text: str, *parts: str) -> bool:
        """Whether this call created the file: the compare and swap that everything rests on. The text is written to a file of
        its own first and then renamed to where nothing may be, so nobody reads half an entry."""
        there, files = self._path(*parts)
        files.mkdirs(there.getParent())
        own, _ = self._path("drafts", uuid.uuid4().hex)
        out = files.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE  # refuses to replace what is there
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(own), files.makeQualified(there), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            files.delete(own, False)
            return False

    def acquire(self, run_id: str) -> int:
        """A token for the run that is higher than all given before: who holds a lower one has lost the lease."""
        while True:
            token = self.token(run_id) + 1
            if self._created("", "leases", _digest(run_id), f"{token:012d}"):
                return token

    def token(self, run_id: str) -> int:
        return int(([*self._listed("leases", _digest(run_id))] or ["0"])[-1])

    def entries(self, project_id: str) -> list[dict]:
        """What was published of a project, in that order."""
        names = [n for n in self._listed("ledger", _digest(project_id)) if n.endswith(".json")]
        return [json.loads(self._text("ledger", _digest(project_id), n)) for n in names]

    def _text(self, *parts: str) -> str:
        there, files = self._path(*parts)
        stream = files.open(there)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commits(self) -> DataFrame:
        """All entries."""
        there, files = self._path("ledger")
        if not files.exists(there):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(f"{self.folder}/ledger")

    def rows(self, name: str) -> DataFrame:
        """All rows of a table, of any attempt."""
        schema = f"{TABLES[name]}, attempt string"
        there, files = self._path(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if files.exists(there) else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """The published rows of a table."""
        return self.rows(name).join(self.commits().select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").select(*_names(TABLES[name]))

    def issues(self) -> DataFrame:
        """The issues of every project as its last published run left them."""
        last = self.commits().groupBy("project_id").agg(F.max_by(F.struct("run_id", "attempt"), "n").alias("l")).select("l.*")
        return self.rows("issues").join(last, ["run_id", "attempt"], "left_semi").select(*_names(TABLES["issues"]))

    def write(self, name: str, table: DataFrame, attempt: str) -> DataFrame:
        """The rows as the attempt's part of a table, read from there."""
        rows = table.select(*_names(TABLES[name])).sortWithinPartitions("project_id", "run_id")
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/attempt={attempt}")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/attempt={attempt}")

    def sweep(self) -> list[str]:
        """Removes the rows of attempts that nothing was committed of; only when no writer is at work."""
        known = {r.attempt for r in self.commits().select("attempt").distinct().collect()}  # one a batch
        gone = {n.removeprefix("attempt=") for name in TABLES for n in self._listed(name) if n.startswith("attempt=")} - known
        for name in TABLES:
            for attempt in gone:
                there, files = self._path(name, f"attempt={attempt}")
                files.delete(there, True)
        return sorted(gone)

    def publish(self, runs: DataFrame, observations: DataFrame, suppressed: DataFrame | None = None, between=None) -> dict[str, str]:
        """Publishes ended runs and returns each one's decision: PUBLISHED, REPLAY, LEASE_LOST, CANCEL_REQUESTED, NOT_FINALIZING or
        PARTIAL.

        runs: project_id, run_id and, where they are known, token, status, cancel_requested (by default the present token,
        FINALIZING, false). observations: of any runs, best partitioned by run_id. between is called before commits (tests).
        """
        extra = {"token": F.lit(None).cast("long"), "status": F.lit("FINALIZING"), "cancel_requested": F.lit(False)}
        ended = runs.withColumns({c: v for c, v in extra.items() if c not in runs.columns}).dropDuplicates(["run_id"])
        facts = completeness(run_facts(observations.join(ended.select("run_id"), "run_id", "left_semi"))).join(ended.select("run_id", "token", F.col("status").alias("lease_status"), "cancel_requested"), "run_id")
        todo = {r.run_id: r for r in facts.collect()}  # a row a run of this batch
        token = {i: r.token if r.token is not None else self.token(i) for i, r in todo.items()}
        out = {i: "PARTIAL" for i, r in todo.items() if r.completeness != "FULL"}
        for _ in range(ROUNDS):
            left = [r for i, r in todo.items() if i not in out]
            ledgers = {p: self.entries(p) for p in {r.project_id for r in left}}
            known = {e["run_id"]: e for es in ledgers.values() for e in es}
            asked = [(r.run_id, r.project_id, r.lease_status, bool(r.cancel_requested), r.run_id in known, True, token[r.run_id] == self.token(r.run_id)) for r in left]
            gate = {a[0]: d for a, d in zip(asked, _gated(self.spark, asked), strict=True)}
            out |= {i: d for i, d in gate.items() if d != "PUBLISH"}
            first: dict[str, object] = {}  # of each project the first run that is left; the next ones build on it
            for r in sorted((r for r in left if r.run_id not in out), key=lambda r: (r.run_no, r.run_id)):
                first.setdefault(r.project_id, r)
            if not first:
                break
            self._round(list(first.values()), ledgers, token, observations, suppressed, out, between)
        return out

    def _round(self, runs: list, ledgers: dict[str, list[dict]], token: dict[str, int], observations: DataFrame, suppressed: DataFrame | None, out: dict[str, str], between) -> None:
        attempt = uuid.uuid4().hex
        rows = []
        for r in runs:
            es = ledgers[r.project_id]
            base = next((e["run_id"] for e in reversed(es) if e["policy_id"] == r.policy_id), None)
            rows.append((r.project_id, r.run_id, r.run_no, r.policy_id, r.scope_generation, r.rule_version, r.finished_at, base, es[-1]["attempt"] if es else None, r.observed, r.http_count))
        batch = self.spark.createDataFrame(rows, RUN)
        prior = [(r.project_id, ledgers[r.project_id][-1]["run_id"], ledgers[r.project_id][-1]["attempt"]) for r in runs if ledgers[r.project_id]]
        wanted = [r.run_id for r in runs] + [x[7] for x in rows if x[7]]
        events, issues = compared(batch, observations.filter(F.col("run_id").isin(wanted)), self._prior(prior))
        events, issues = self.write("events", events, attempt), self.write("issues", issues, attempt)
        self.write("transitions", transitions(issues), attempt)
        self.write("summary", summary(batch, events, issues, suppressed), attempt)
        if between:
            between()
        for r, row in zip(runs, rows, strict=True):
            if self.token(r.run_id) != token[r.run_id]:
                out[r.run_id] = "LEASE_LOST"
                continue
            n = len(ledgers[r.project_id]) + 1
            entry = {"project_id": r.project_id, "n": n, "run_id": r.run_id, "run_no": r.run_no, "policy_id": r.policy_id, "attempt": attempt, "token": token[r.run_id], "base_run_id": row[7]}
            if self._created(json.dumps(entry), "ledger", _digest(r.project_id), f"{n:012d}.json"):
                out[r.run_id] = "PUBLISHED"  # else another writer had this project's next entry: look again

    def _prior(self, heads: list[tuple]) -> DataFrame:
        """The issues that the given runs left."""
        last = self.spark.createDataFrame(heads, "project_id string, run_id string, attempt string")
        every = self.rows("issues").filter(F.col("attempt").isin(sorted({h[2] for h in heads}))) if heads else self.rows("issues").limit(0)
        return every.join(F.broadcast(last), ["project_id", "run_id", "attempt"], "left_semi")


def _gated(spark: SparkSession, asked: list[tuple]) -> list[str]:
    """publish_gate()'s decisions, in order; a run that was published or refused before this batch stays so."""
    if not asked:
        return []
    schema = "i long, status string, cancel_requested boolean, published boolean, same_project boolean, token_matches boolean"
    rows = publish_gate(spark.createDataFrame([(i, *a[2:]) for i, a in enumerate(asked)], schema)).select("i", "decision").collect()
    return [d for _, d in sorted((r.i, r.decision) for r in rows)]


def compared(runs: DataFrame, observations: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, issues) of runs (RUN), one per project, from their own and their baselines' observations and the issues before
    them: one join of the observations, one of the verdicts with the issues."""
    runs = F.broadcast(runs)  # a row a project
    current = observations.join(runs.select("run_id", "base_run_id"), "run_id")
    events = diff.observation_diff(current, observations)
    scope = ("project_id", "scope_generation", "rule_version", "page_id", "rule_key")
    verdicts = rules.evaluate(rules.rule_input(current), keys=("project_id", "scope_generation", "rule_version", "run_id", "run_no", "page_id"))
    before = prior.select(*scope, F.struct("state", "occurrence", "last_evaluated_run_id", "last_confirmed_run_id", "evidence").alias("was"))
    now = verdicts.select(*scope, F.struct("verdict", "evidence").alias("now"))
    run = runs.select("project_id", F.struct("run_id", "run_no", "scope_generation", "rule_version").alias("run"))
    both = now.join(before, list(scope), "full").join(run, "project_id")
    verdict, old = F.coalesce(F.col("now.verdict"), F.lit(rules.UNKNOWN)), F.col("was.state")
    new = rules.next_state(old, verdict)
    fresh = (old.isNull() & new.isNotNull()) | rules.reopens(old, verdict)
    own = (F.col("scope_generation") == F.col("run.scope_generation")) & (F.col("rule_version") == F.col("run.rule_version"))
    issues = both.select(
        "project_id", "run.run_id", "run.run_no", "page_id", "scope_generation", "rule_version", "rule_key", old.alias("from_state"), new.alias("state"),
        (F.coalesce("was.occurrence", F.lit(0)) + fresh.cast("int")).alias("occurrence"),
        F.when(own, F.col("run.run_id")).otherwise(F.col("was.last_evaluated_run_id")).alias("last_evaluated_run_id"),
        F.when(verdict != rules.UNKNOWN, F.col("run.run_id")).otherwise(F.col("was.last_confirmed_run_id")).alias("last_confirmed_run_id"),
        F.when(verdict == rules.PRESENT, F.col("now.evidence")).otherwise(F.col("was.evidence")).alias("evidence"), own.alias("own"),
    )
    return events, issues.filter(F.col("state").isNotNull())


def transitions(issues: DataFrame) -> DataFrame:
    """The state changes that runs made, with their idempotency keys."""
    changed = issues.filter(~F.col("from_state").eqNullSafe(F.col("state"))).withColumnRenamed("state", "to_state")
    issue = F.concat_ws(":", "page_id", "rule_key")
    again = F.concat_ws(":", F.col("run_id"), issue, F.col("to_state"))
    return changed.withColumn("idempotency_key", F.when(F.col("from_state").isNull(), F.concat_ws(":", "run_id", "page_id", "rule_key", F.lit("open"))).otherwise(again))


def summary(runs: DataFrame, events: DataFrame, issues: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One row per run, from its events and the issues that it left."""
    runs = F.broadcast(runs)
    opened = issues.filter("own and state = 'OPEN'").select("project_id", "page_id", "rule_key")
    if suppressed is not None:
        muted = suppressed.join(runs.select("project_id", "finished_at"), "project_id").filter(F.col("suppressed_until") >= F.col("finished_at"))
        opened = opened.join(muted.select("project_id", "page_id", "rule_key").distinct(), ["project_id", "page_id", "rule_key"], "left_anti")
    by_rule = opened.groupBy("project_id", "rule_key").agg(F.count(F.lit(1)).alias("open")).groupBy("project_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_key", F.col("open").cast("double").alias("open")))).alias("open_by_rule"), F.sum("open").alias("issues_open")
    )
    resolved = issues.filter("own and state = 'RESOLVED' and from_state = 'OPEN'").groupBy("project_id").agg(F.count(F.lit(1)).alias("issues_resolved"))
    joined = runs.join(diff.summarize(events, "run_id"), "run_id", "left").join(by_rule, "project_id", "left").join(resolved, "project_id", "left")
    scored = health(joined, "http_count", "observed", "open_by_rule")
    counts = ("total", "critical", "warning", "info", "affected_pages", "issues_open", "issues_resolved")
    return scored.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}).withColumns({
        "comparison_mode": F.when(F.col("base_run_id").isNull(), "BASELINE").otherwise("DIFF"), "urls_crawled": F.col("http_count"), "health_score": F.col("score"),
        "health_score_version": F.col("score_version").cast("bigint"), "health_coverage": F.col("coverage"),
    })
