"""Roles, members, invitations, verification, guards: decision tables over control-plane relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("OWNER", "ADMIN", "MEMBER", "VIEWER")
# The least role of each action.
LEAST_ROLE = {"view": "VIEWER", "run-crawl": "MEMBER", "manage-project": "ADMIN", "manage-members": "ADMIN", "manage-owners": "OWNER"}


def role_matrix(spark: SparkSession) -> DataFrame:
    """role, action, allowed: 4 x 5 rows."""
    rows = [(r, a, ROLES.index(r) <= ROLES.index(least)) for r in ROLES for a, least in LEAST_ROLE.items()]
    return spark.createDataFrame(rows, "role string, action string, allowed boolean")


def can(role: Column, action: Column) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0))
    least = F.create_map(*[x for a, r in LEAST_ROLE.items() for x in (F.lit(a), F.lit(ROLES.index(r) + 1))])[action]
    return (rank > 0) & F.coalesce(rank <= least, F.lit(False))


def is_role(value: Column) -> Column:
    return F.coalesce(value.isin(*ROLES), F.lit(False))


def can_modify_member(actor: Column, target: Column, new_role: Column) -> Column:
    """Members are managed from ADMIN up; an OWNER as target or as new role needs an OWNER."""
    owners = (target == "OWNER") | F.coalesce(new_role == "OWNER", F.lit(False))
    return F.when(owners, can(actor, F.lit("manage-owners"))).otherwise(can(actor, F.lit("manage-members")))


def member_guard(requests: DataFrame) -> DataFrame:
    """Adds error to requests (kind CHANGE or REMOVE, actor_id, actor_role, target_id, target_role, new_role, owners)."""
    c = F.col
    loses = (c("target_role") == "OWNER") & ((c("kind") == "REMOVE") | (c("new_role") != "OWNER"))
    return requests.withColumn(
        "error",
        F.when(~can_modify_member(c("actor_role"), c("target_role"), c("new_role")), "FORBIDDEN").when((c("kind") == "REMOVE") & (c("actor_id") == c("target_id")), "SELF_REMOVAL")
        .when(loses & (c("owners") <= 1), "LAST_OWNER"),
    )


def accept_invitation(requests: DataFrame, now: Column) -> DataFrame:
    """Adds error and status: the order of the checks is fixed."""
    c = F.col
    gone = ~c("found") | c("revoked") | c("consumed") | (c("expires_at") <= now)
    out = F.when(gone, "INVALID_INVITATION").when(~c("email_verified"), "EMAIL_UNVERIFIED").when(F.lower("email") != F.lower("invited_email"), "EMAIL_MISMATCH").when(c("lost_race"), "CONFLICT").when(c("already_member"), "ALREADY_MEMBER")
    status = F.when(gone, 400).when(out.isin("EMAIL_UNVERIFIED", "EMAIL_MISMATCH"), 403).when(out.isNotNull(), 409).otherwise(200)
    return requests.withColumn("error", out).withColumn("status", status)


def invitation_state(revoked_at: Column, consumed_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "REVOKED").when(consumed_at.isNotNull(), "ACCEPTED").when(expires_at <= now, "EXPIRED").otherwise("PENDING")


def crawl_block_reason(verified_at: Column, status: Column, now: Column) -> Column:
    """Why a project may not be crawled, or null: never verified, then not active, then lapsed."""
    lapsed = now >= verified_at + F.expr("interval 30 days")
    return F.when(verified_at.isNull(), "NOT_VERIFIED").when(status != "ACTIVE", "NOT_ACTIVE").when(lapsed, "VERIFICATION_EXPIRED")


def verification_step(found: Column, attempts: Column) -> Column:
    """Next state of a verification job."""
    return F.when(found, "VERIFIED").when(attempts >= 3, "FAILED").otherwise("PENDING")


def latest_verification(verifications: DataFrame) -> DataFrame:
    """Per project the row of the greatest challenge version."""
    cols = [c for c in verifications.columns if c != "project_id"]
    return verifications.groupBy("project_id").agg(F.max_by(F.struct(*cols), "challenge_version").alias("v")).select("project_id", "v.*")


def next_challenge_version(verifications: DataFrame) -> DataFrame:
    return verifications.groupBy("project_id").agg((F.max("challenge_version") + 1).alias("next_version"))


def project_view(projects: DataFrame, policies: DataFrame, verifications: DataFrame) -> DataFrame:
    """Projects with their current policy and latest verification."""
    p = policies.withColumnRenamed("policy_id", "current_policy_id").drop("project_id")
    return projects.join(p, "current_policy_id", "left").join(latest_verification(verifications), "project_id", "left")


def same_origin(method: Column, origin: Column, expected: Column) -> Column:
    """Whether a request passes: safe methods and requests without an origin do, others only from the expected origin."""
    return F.coalesce(F.upper(method).isin("GET", "HEAD", "OPTIONS"), F.lit(False)) | origin.isNull() | F.coalesce((origin != "null") & (F.lower(origin) == F.lower(expected)), F.lit(False))


def suppress(issues: DataFrame, issue_id: str, until: Column) -> DataFrame:
    return issues.withColumn("suppressed_until", F.when(F.col("issue_id") == issue_id, until).otherwise(F.col("suppressed_until")))


def archive(projects: DataFrame, project_id: str, now: Column) -> DataFrame:
    hit = (F.col("project_id") == project_id) & F.col("archived_at").isNull()
    return projects.withColumn("archived_at", F.when(hit, now).otherwise(F.col("archived_at")))


def memberships(members: DataFrame, users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Memberships with their user and workspace."""
    return members.join(users, "user_id").join(workspaces, "workspace_id")


def invitations(invited: DataFrame, workspaces: DataFrame, now: Column) -> DataFrame:
    """Invitations with their workspace and present state."""
    state = invitation_state(F.col("revoked_at"), F.col("consumed_at"), F.col("expires_at"), now)
    return invited.join(workspaces, "workspace_id").withColumn("state", state)


def owners(members: DataFrame) -> DataFrame:
    return members.groupBy("workspace_id").agg(F.count_if(F.col("role") == "OWNER").alias("owners"))
