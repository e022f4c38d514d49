"""Control-plane writes as relations: invitations, their revocation, projects, verification challenges.

Every operator takes requests (id, at, workspace_id, actor_id, ...) and the present tables, and gives the decisions, in the
service's order of checks, the rows to write and an audit row for each that is accepted. Requests of one batch that meet
on one row are judged in the order (at, id): the first one that may has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import codec, urls
from tidewatch.operators.control import can, is_role, latest_verification
from tidewatch.operators.operations import TERMINAL

PREFIX = "_tidewatch"  # of the DNS name that a challenge is read from


@dataclass
class Written:
    """decisions: id, error (null: accepted); rows: what is written; audit: workspace_id, actor_id, action, resource_id, details."""

    decisions: DataFrame
    rows: DataFrame
    audit: DataFrame


def _with_role(requests: DataFrame, members: DataFrame) -> DataFrame:
    """The actor's present role in the workspace; null without a membership."""
    own = members.select("workspace_id", F.col("user_id").alias("actor_id"), F.col("role").alias("actor_role"))
    return requests.join(own, ["workspace_id", "actor_id"], "left")


def _first(df: DataFrame, fine: Column, *keys: str) -> Column:
    """Whether a row is the first of its keys among those that are fine."""
    w = Window.partitionBy(*keys).orderBy(F.when(fine, 0).otherwise(1), "at", "id")
    return fine & (F.row_number().over(w) == 1)


def _audit(rows: DataFrame, action: Column, resource: Column, details: Column) -> DataFrame:
    return rows.select("workspace_id", "actor_id", action.alias("action"), resource.alias("resource_id"), details.alias("details"), F.col("at").alias("created_at"))


def _said(rows: DataFrame) -> DataFrame:
    return rows.select("id", "error")


def invite(requests: DataFrame, members: DataFrame, token: Column) -> Written:
    """requests with email and role. rows: workspace_id, email (trimmed, lower case), role, token_hash, expires_at; the token itself
    is kept nowhere."""
    c = F.col
    asked = _with_role(requests, members)
    error = F.when(c("actor_role").isNull(), "NOT_FOUND").when(~is_role(c("role")), "INVALID_INPUT").when(~can(c("actor_role"), F.lit("manage-members")), "FORBIDDEN")
    error = error.when((c("role") == "OWNER") & ~can(c("actor_role"), F.lit("manage-owners")), "FORBIDDEN")
    judged = asked.withColumns({"error": error, "email": F.lower(F.trim("email"))})
    made = judged.filter("error is null").withColumns({"token_hash": codec.token_hash(token), "expires_at": codec.invitation_expiry(c("at"))})
    details = F.to_json(F.struct("email", "role"))
    return Written(_said(judged), made.select("id", "workspace_id", "email", "role", "token_hash", "expires_at"), _audit(made, F.lit("member.invited"), c("id").cast("string"), details))


def revoke(requests: DataFrame, invitations: DataFrame, members: DataFrame) -> Written:
    """requests with invitation_id. rows: invitation_id, revoked_at. Only an invitation of the workspace that was neither consumed nor
    revoked can be revoked, and only once."""
    c = F.col
    there = invitations.select("invitation_id", "workspace_id", (c("consumed_at").isNull() & c("revoked_at").isNull()).alias("open"))
    asked = _with_role(requests, members).join(there, ["invitation_id", "workspace_id"], "left")
    refused = F.when(c("actor_role").isNull(), "NOT_FOUND").when(~can(c("actor_role"), F.lit("manage-members")), "FORBIDDEN")
    fine = refused.isNull() & F.coalesce("open", F.lit(False))
    judged = asked.withColumn("fine", fine).withColumn("won", _first(asked, c("fine"), "invitation_id")).withColumn("error", F.coalesce(refused, F.when(~c("won"), "NOT_FOUND")))
    made = judged.filter("error is null")
    return Written(_said(judged), made.select("invitation_id", c("at").alias("revoked_at")), _audit(made, F.lit("member.invitation_revoked"), c("invitation_id").cast("string"), F.lit(None).cast("string")))


def create_projects(requests: DataFrame, projects: DataFrame, members: DataFrame) -> Written:
    """requests with hostname and display_name. rows: project_id, workspace_id, hostname, display_name, scope_generation, rule_version.
    A workspace has each host name once."""
    c = F.col
    host = urls.valid_hostname(c("hostname"))
    there = projects.select("workspace_id", c("hostname").alias("host"), F.lit(True).alias("taken")).distinct()
    asked = _with_role(requests, members).withColumn("host", host).join(there, ["workspace_id", "host"], "left")
    refused = F.when(~F.coalesce(can(c("actor_role"), F.lit("manage-project")), F.lit(False)), "FORBIDDEN").when(c("host").isNull(), "INVALID_INPUT").when(c("taken"), "CONFLICT")
    judged = asked.withColumn("fine", refused.isNull()).withColumn("won", _first(asked, c("fine"), "workspace_id", "host")).withColumn("error", F.coalesce(refused, F.when(~c("won"), "CONFLICT")))
    name = F.trim("display_name")
    made = judged.filter("error is null").withColumn("project_id", F.concat(F.lit("p"), c("id").cast("string")))
    rows = made.select("project_id", "workspace_id", c("host").alias("hostname"), F.when(name != "", name).alias("display_name"), F.lit(1).alias("scope_generation"), F.lit(1).alias("rule_version"))
    return Written(_said(judged), rows, _audit(made, F.lit("project.created"), c("project_id"), F.to_json(F.struct(c("host").alias("hostname")))))


def update_projects(requests: DataFrame, projects: DataFrame, runs: DataFrame, members: DataFrame) -> Written:
    """requests with project_id, archived (null: as it is), renamed and display_name, one per project. rows: project_id, archived_at,
    display_name as they are afterwards. A project with an active run is not archived; only a change of archived is audited."""
    c = F.col
    active = runs.filter(~c("status").isin(*TERMINAL)).select("project_id", F.lit(True).alias("active")).distinct()
    there = projects.select("workspace_id", "project_id", c("archived_at").alias("was"), c("display_name").alias("old_name"), F.lit(True).alias("found"))
    asked = _with_role(requests, members).join(there, ["workspace_id", "project_id"], "left").join(active, "project_id", "left")
    moved = F.coalesce(c("archived") != c("was").isNotNull(), F.lit(False))
    error = F.when(~F.coalesce(can(c("actor_role"), F.lit("manage-project")), F.lit(False)), "FORBIDDEN").when(c("found").isNull(), "NOT_FOUND")
    error = error.when(moved & c("archived") & F.coalesce("active", F.lit(False)), "ALREADY_ACTIVE")
    judged = asked.withColumns({"error": error, "moved": moved})
    name = F.trim("display_name")
    made = judged.filter("error is null").withColumns({
        "archived_at": F.when(c("moved"), F.when(c("archived"), c("at"))).otherwise(c("was")), "name": F.when(c("renamed"), F.when(name != "", name)).otherwise(c("old_name"))
    })
    action = F.when(c("archived"), "project.archived").otherwise("project.unarchived")
    return Written(_said(judged), made.select("project_id", "archived_at", c("name").alias("display_name")), _audit(made.filter("moved"), action, c("project_id").cast("string"), F.lit(None).cast("string")))


def rotate_challenges(requests: DataFrame, projects: DataFrame, verifications: DataFrame, members: DataFrame, value: Column) -> Written:
    """requests with project_id. rows: verification_id, project_id, challenge_version, value_hash, record_name, status: the next challenge of a
    project that has no check under way; of requests at once the first has it."""
    c = F.col
    last = latest_verification(verifications.select("project_id", "challenge_version", c("status").alias("last_status")))
    there = projects.select("workspace_id", "project_id", "hostname")
    asked = _with_role(requests, members).join(there, ["workspace_id", "project_id"], "left").join(last, "project_id", "left")
    refused = F.when(~F.coalesce(can(c("actor_role"), F.lit("manage-project")), F.lit(False)), "FORBIDDEN").when(c("hostname").isNull(), "NOT_FOUND").when(c("last_status").isin("PENDING", "RUNNING"), "CONFLICT")
    judged = asked.withColumn("fine", refused.isNull()).withColumn("won", _first(asked, c("fine"), "project_id")).withColumn("error", F.coalesce(refused, F.when(~c("won"), "CONFLICT")))
    made = judged.filter("error is null").withColumns({"next": F.coalesce("challenge_version", F.lit(0)) + 1, "value": value})
    rows = made.select(
        F.concat(F.lit("v"), c("id").cast("string")).alias("verification_id"), "project_id", c("next").alias("challenge_version"), F.sha2("value", 256).alias("value_hash"), codec.challenge_name(PREFIX, c("hostname")).alias("record_name"), F.lit("PENDING").alias("status")
    )
    return Written(_said(judged), rows, _audit(made, F.lit("project.verification_requested"), F.concat(F.lit("v"), c("id").cast("string")), F.to_json(F.struct(c("next").alias("challengeVersion")))))
