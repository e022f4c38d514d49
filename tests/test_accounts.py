"""Control-plane writes: decisions in the service's order, what is written, what is audited; and admission and claims."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tidewatch.operators import accounts, operations, reports, writes

T = dt.datetime(2026, 1, 1)
MEMBERS = [("w", "o", "OWNER"), ("w", "a", "ADMIN"), ("w", "m", "MEMBER"), ("x", "a", "OWNER")]


def members(spark):
    return spark.createDataFrame(MEMBERS, "workspace_id string, user_id string, role string")


def asked(spark, rows, more):
    return spark.createDataFrame([(i, T + dt.timedelta(seconds=i), "w", *r) for i, r in enumerate(rows)], f"id int, at timestamp_ntz, workspace_id string, actor_id string, {more}")


def said(w):
    return [r.error for r in w.decisions.orderBy("id").collect()]


def test_invitations(spark):
    rows = [("o", " A@B.C ", "OWNER"), ("a", "a@b.c", "OWNER"), ("a", "a@b.c", "MEMBER"), ("m", "a@b.c", "VIEWER"), ("none", "a@b.c", "VIEWER"), ("a", "a@b.c", "KING")]
    w = accounts.invite(asked(spark, rows, "email string, role string"), members(spark), F.concat(F.lit("t"), "id"))
    assert said(w) == [None, "FORBIDDEN", None, "FORBIDDEN", "NOT_FOUND", "INVALID_INPUT"]
    made = {r.id: r for r in w.rows.collect()}
    assert set(made) == {0, 2} and made[0].email == "a@b.c" and made[0].expires_at == T + dt.timedelta(hours=72) and len(made[0].token_hash) == 64
    assert [(r.action, json.loads(r.details)["role"]) for r in w.audit.orderBy("resource_id").collect()] == [("member.invited", "OWNER"), ("member.invited", "MEMBER")]
    there = spark.createDataFrame([(1, "w", None, None), (2, "w", T, None), (3, "x", None, None), (4, "w", None, T)], "invitation_id int, workspace_id string, consumed_at timestamp_ntz, revoked_at timestamp_ntz")
    w = accounts.revoke(asked(spark, [("a", 1), ("o", 1), ("a", 2), ("a", 3), ("a", 4), ("m", 1), ("a", 9)], "invitation_id int"), there, members(spark))
    assert said(w) == [None, "NOT_FOUND", "NOT_FOUND", "NOT_FOUND", "NOT_FOUND", "FORBIDDEN", "NOT_FOUND"]
    assert [(r.invitation_id, r.revoked_at) for r in w.rows.collect()] == [(1, T)]


def test_projects(spark):
    there = spark.createDataFrame([("w", 1, "a.example", None, "one"), ("w", 2, "b.example", T, None)], "workspace_id string, project_id int, hostname string, archived_at timestamp_ntz, display_name string")
    rows = [("a", "C.example.", " C "), ("o", "c.example", None), ("a", "a.example", None), ("a", "localhost", None), ("m", "d.example", None), ("a", "d.example", "  ")]
    w = accounts.create_projects(asked(spark, rows, "hostname string, display_name string"), there, members(spark))
    assert said(w) == [None, "CONFLICT", "CONFLICT", "INVALID_INPUT", "FORBIDDEN", None]
    assert sorted((r.project_id, r.hostname, r.display_name) for r in w.rows.collect()) == [("p0", "c.example", "C"), ("p5", "d.example", None)]
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "COMPLETED")], "project_id int, status string")
    ask = lambda *rows: accounts.update_projects(asked(spark, rows, "project_id int, archived boolean, renamed boolean, display_name string"), there, runs, members(spark))
    w = ask(("a", 1, True, False, None), ("a", 1, None, True, " new "), ("a", 2, False, True, " "), ("a", 9, True, False, None), ("m", 1, None, True, "x"), ("a", 1, False, False, None))
    assert said(w) == ["ALREADY_ACTIVE", None, None, "NOT_FOUND", "FORBIDDEN", None]
    assert sorted((r.project_id, r.archived_at, r.display_name) for r in w.rows.collect()) == [(1, None, "new"), (1, None, "one"), (2, None, None)]
    assert [r.action for r in w.audit.collect()] == ["project.unarchived"]
    done = spark.createDataFrame([(1, 1, "FAILED"), (1, 2, "VERIFIED"), (2, 1, "RUNNING")], "project_id int, challenge_version int, status string")
    w = accounts.rotate_challenges(asked(spark, [("a", 1), ("o", 1), ("a", 2), ("m", 1), ("a", 7)], "project_id int"), there, done, members(spark), F.lit("secret"))
    assert said(w) == [None, "CONFLICT", "CONFLICT", "FORBIDDEN", "NOT_FOUND"]
    assert [(r.challenge_version, r.record_name, r.status) for r in w.rows.collect()] == [(3, "_tidewatch.a.example", "PENDING")]


def test_current_policy_and_dashboard(spark):
    states = spark.createDataFrame([("p", 1, 1, 7, "r", "OPEN", 1, None, 1), ("p", 2, 1, 7, "r", "OPEN", 1, None, 2)], "project_id string, scope_generation long, rule_version long, page_id long, rule_key string, state string, occurrence int, evidence map<string,string>, run_no long")
    runs = spark.createDataFrame([("p", 1, 1, 1), ("p", 2, 1, 2)], "project_id string, scope_generation long, rule_version long, run_no long")
    policy = lambda g: spark.createDataFrame([("p", g, 1)], "project_id string, scope_generation long, rule_version long")
    got = lambda *a: [r.scope_generation for r in reports.current_issues(states, runs, *a).collect()]
    assert (got(), got(policy(1)), got(policy(3)), got(policy(1).limit(0))) == ([2], [1], [], [])
    df = spark.range(100).select((F.col("id") % 3).alias("project_id"), "id")
    top = reports.shown_first(df, reports.SHOWN_CHANGES, F.desc("id"))
    assert top.count() == 24 and "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_admission_against_one_request_at_a_time(spark):
    r = random.Random(4)
    rows = [(i, r.choice("pq"), "w", r.choice("ab"), r.choice(("MEMBER", "VIEWER", "OWNER")), r.choice(("k", "l", "m", "", None)), r.randint(0, 200_000), r.choice((10, 4000, 60_000)), r.random() < 0.05) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, project_id string, workspace_id string, actor_id string, role string, key string, t long, lasts_s long, archived boolean")
    got = operations.admit(df.withColumns({"at": F.timestamp_seconds("t"), "policy_id": F.lit("x"), "project_exists": F.lit(True), "block_reason": F.lit(None).cast("string")}).drop("t"))
    want, state = {}, {}
    for i, p, w, a, role, key, t, lasts, archived in sorted(rows, key=lambda x: (x[6], x[0])):
        taken = state.setdefault(p, [])
        day = [x for x in taken if x[0] >= t - 86_400]
        again = next((x for x in taken if x[1] == (a, w, key) and t < x[0] + 86_400), None)
        if role == "VIEWER":
            want[i] = ("FORBIDDEN", None)
        elif not key:
            want[i] = ("IDEMPOTENCY_KEY_REQUIRED", None)
        elif again:
            want[i] = ("REPLAY", f"{p}/{again[2]}")
        elif archived:
            want[i] = ("ARCHIVED", None)
        elif any(x[0] + x[3] > t for x in taken):
            want[i] = ("ALREADY_ACTIVE", None)
        elif len(day) >= 10:
            want[i] = ("DAILY_LIMIT", None)
        elif taken and taken[-1][0] + 300 > t:
            want[i] = ("SPACING", None)
        else:
            want[i] = ("ACCEPTED", f"{p}/{i}")
            taken.append((t, (a, w, key), i, lasts))
    assert {x.id: (x.outcome, x.run_id) for x in got.decisions.collect()} == want
    accepted = {v[1] for v in want.values() if v[0] == "ACCEPTED"}
    assert {x.run_id for x in got.runs.collect()} == {x.aggregate_id for x in got.outbox.collect()} == {x.resource_id for x in got.audit.collect()} == accepted
    assert {x[0] for x in want.values()} >= {"ACCEPTED", "REPLAY", "ALREADY_ACTIVE", "ARCHIVED"}


def test_claims_of_several_workers(spark):
    df = spark.createDataFrame([(i, "k" if i % 5 else "z", T + dt.timedelta(seconds=(i * 7) % 50), None, None, None) for i in range(50)], "event_id int, type string, available_at timestamp_ntz, delivered_at timestamp_ntz, claim_until timestamp_ntz, claim_token string")
    now = F.lit(T + dt.timedelta(seconds=40)).cast("timestamp_ntz")
    got = operations.claims(df, "k", ["u", "v", "w"], 5, now).collect()
    due = sorted((r.available_at, r.event_id) for r in df.collect() if r.type == "k" and r.available_at <= T + dt.timedelta(seconds=40))
    assert sorted(r.event_id for r in got) == sorted(i for _, i in due[:15]) and len({r.claim_token for r in got}) == 15
    for w in "uvw":
        own = sorted((r.claim_order, r.available_at, r.event_id) for r in got if r.claimed_by == w)
        assert [o[0] for o in own] == [0, 1, 2, 3, 4] and [o[1:] for o in own] == sorted(o[1:] for o in own)
    held = spark.createDataFrame([(r.event_id, r.claim_token, r.claim_until) for r in got], "event_id int, claim_token string, claim_until timestamp_ntz")
    claimed = df.drop("claim_token", "claim_until").join(held, "event_id", "left")
    answers = spark.createDataFrame([(got[0].event_id, got[0].claim_token, None), (got[1].event_id, "old", None)], "event_id int, claim_token string, delay_s double")
    after = {r.event_id: r for r in writes.ack(claimed, answers, now).collect()}
    assert after[got[0].event_id].delivered_at and not after[got[1].event_id].delivered_at  # an old claim is fenced off
    assert operations.claims(claimed, "k", ["u"], 99, now).join(held, "event_id").count() == 0  # what is claimed is not claimed again
