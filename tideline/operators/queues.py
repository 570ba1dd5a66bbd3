"""Queues, policies, intake, depth and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..functions.clock import at, plus_days, plus_seconds, seconds_between


def page_queues(queues: DataFrame, after: str, size: int) -> DataFrame:
    return queues.where(F.col("name") > after).orderBy("name").limit(size + 1).select("queue_id", "name", "state_code", "config_version", "active_policy_id")


def gate_matrix(queues: DataFrame) -> DataFrame:
    """What each operation meets at each queue."""
    rows = queues.select("queue_id", "state_code", F.explode(F.array(*[F.lit(o) for o in d.OPERATIONS])).alias("operation"))
    return rows.select("queue_id", "operation", d.gate(F.col("state_code"), F.col("operation")).alias("outcome"))


def config_cas(queues: DataFrame, expected: int, new_state: int) -> DataFrame:
    """A change of state that holds only where the queue's version is the expected one."""
    ok = F.col("config_version") == expected
    return queues.select("queue_id", F.when(ok, "applied").otherwise("version_conflict").alias("result"), F.when(ok, new_state).otherwise(F.col("state_code")).alias("state_code"), F.when(ok, F.col("config_version") + 1).otherwise(F.col("config_version")).alias("config_version"))


def next_policy_version(policies: DataFrame) -> DataFrame:
    return policies.groupBy("queue_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def policy_valid(policies: DataFrame, ceiling: int) -> DataFrame:
    most = min(ceiling, d.RETRY_DELAY_MOST)
    delay = F.col("retry_delay_seconds").between(0, most)
    return policies.select("policy_id", (F.col("max_attempts") >= 1).alias("attempts_ok"), delay.alias("delay_ok"), ((F.col("max_attempts") >= 1) & delay).alias("valid"))


def catalog_missing(catalog: DataFrame, queues: DataFrame) -> DataFrame:
    """Queues of a catalog(name) that do not exist yet."""
    return catalog.join(queues, "name", "left_anti").select("name")


def dedup_outcomes(submissions: DataFrame) -> DataFrame:
    """The first submission of a scope wins; later ones are replays if their fingerprint agrees, else conflicts."""
    w = Window.partitionBy("producer_id", "queue_name", "idem_key").orderBy("submitted_at", "submission_id")
    first, mine = F.first_value("fingerprint").over(w), F.row_number().over(w)
    outcome = F.when(mine == 1, "new").when(F.col("fingerprint") == first, "replay").otherwise("conflict")
    return submissions.select("submission_id", "producer_id", "queue_name", "idem_key", outcome.alias("outcome"))


def winners(submissions: DataFrame) -> DataFrame:
    first = F.min(F.struct("submitted_at", "submission_id", "fingerprint")).alias("f")
    return submissions.groupBy("producer_id", "queue_name", "idem_key").agg(first).select("producer_id", "queue_name", "idem_key", "f.*")


def resolve_submission(submissions: DataFrame, now: str, days: int) -> DataFrame:
    expires = plus_days(F.col("submitted_at"), days)
    return winners(submissions).select("producer_id", "queue_name", "idem_key", "submission_id", expires.alias("expires_at"), (at(now) < expires).alias("visible"))


def queue_depth(tasks: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state_code") == s)
    return tasks.where(F.col("state_code") <= d.LEASED).groupBy("queue_id").agg(n(d.DELAYED).alias("delayed"), n(d.READY).alias("ready"), n(d.LEASED).alias("leased"))


def instance_depth(tasks: DataFrame) -> DataFrame:
    depth = queue_depth(tasks)
    return depth.agg(F.coalesce(F.sum(F.col("delayed") + F.col("ready") + F.col("leased")), F.lit(0)).alias("depth"))


def depth_admission(tasks: DataFrame, queues: DataFrame, per_queue: int, instance: int) -> DataFrame:
    """Whether one more task is let in, and which ceiling keeps it out."""
    depth = queue_depth(tasks).select("queue_id", (F.col("delayed") + F.col("ready") + F.col("leased")).alias("depth"))
    rows = queues.select("queue_id").join(depth, "queue_id", "left").select("queue_id", F.coalesce("depth", F.lit(0)).alias("depth"))
    rows = rows.join(F.broadcast(instance_depth(tasks).select(F.col("depth").alias("instance_depth"))))  # one row
    scope = F.when(F.col("depth") + 1 > per_queue, "queue").when(F.col("instance_depth") + 1 > instance, "instance")
    return rows.select("queue_id", "depth", "instance_depth", scope.alias("reject_scope"))


def drain_progress(queues: DataFrame, tasks: DataFrame) -> DataFrame:
    depth = queue_depth(tasks)
    rows = queues.join(depth, "queue_id", "left")
    left = F.coalesce(F.col("delayed") + F.col("ready") + F.col("leased"), F.lit(0))
    return rows.select("queue_id", "name", left.alias("remaining"), (F.col("state_code") == d.QUEUE_DRAINING).alias("draining"), ((F.col("state_code") == d.QUEUE_DRAINING) & (left == 0)).alias("complete"))


def queue_stats(queues: DataFrame, tasks: DataFrame, now: str) -> DataFrame:
    """Depths (0 for a queue without tasks), and the ready task that has waited longest with its age."""
    depth = queue_depth(tasks)
    oldest = tasks.where(F.col("state_code") == d.READY).groupBy("queue_id").agg(F.min(F.struct("available_at", "task_id")).alias("o"))
    rows = queues.join(depth, "queue_id", "left").join(oldest, "queue_id", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("delayed", "ready", "leased")]
    age = F.greatest(F.lit(0), seconds_between(F.col("o.available_at"), at(now)))
    return rows.select("queue_id", "name", *counts, F.col("o.task_id").alias("oldest_ready_id"), F.when(F.col("o").isNotNull(), age).alias("oldest_ready_age"))


def stats_snapshot(queues: DataFrame, tasks: DataFrame, now: str, most_seconds: int) -> DataFrame:
    """When each queue was last seen, how fresh that is, and the worst and the earliest of all."""
    seen = tasks.where(F.col("created_at") <= at(now)).groupBy("queue_id").agg(F.max("created_at").alias("as_of"))
    rows = queues.select("queue_id").join(seen, "queue_id", "left")
    rows = rows.withColumn("freshness", d.freshness(seconds_between(F.col("as_of"), at(now)), most_seconds))
    rank = F.when(F.col("freshness") == "fresh", 0).when(F.col("freshness") == "stale", 1).otherwise(2)
    total = rows.agg(F.min("as_of").alias("snapshot_as_of"), F.max(rank).alias("worst"))
    names = F.array(F.lit("fresh"), F.lit("stale"), F.lit("unavailable"))
    return rows.join(F.broadcast(total)).select("queue_id", "as_of", "freshness", "snapshot_as_of", F.element_at(names, F.col("worst") + 1).alias("snapshot_freshness"))


def list_audit(audit: DataFrame, queues: DataFrame, since: str, until: str, size: int) -> DataFrame:
    """audit(audit_id, audit_at, queue_id, operation_code), with queue names where there are any and a label for every code."""
    rows = audit.where(F.col("audit_at").between(at(since), at(until))).join(queues.select("queue_id", "name"), "queue_id", "left")
    got = rows.orderBy(F.desc("audit_at"), F.desc("audit_id")).limit(size + 1)
    return got.select("audit_id", "audit_at", "queue_id", F.col("name").alias("queue_name"), d.audit_label(F.col("operation_code")).alias("operation"))


def registry_purge(registry: DataFrame, now: str, batch: int) -> DataFrame:
    """registry(id, expires_at): what one batch deletes, the least expiry that stays, and whether more has expired."""
    numbered = registry.where(F.col("expires_at") <= at(now)).orderBy("expires_at", "id").limit(batch).select("id")
    rest = registry.join(numbered, "id", "left_anti")
    kept = rest.agg(F.min("expires_at").alias("oldest_remaining"), F.coalesce(F.bool_or(F.col("expires_at") <= at(now)), F.lit(False)).alias("more_work"))
    return numbered.agg(F.count("*").alias("deleted")).join(F.broadcast(kept))


def registry_extend(registry: DataFrame, seconds: int) -> DataFrame:
    """registry(id, created_at, expires_at): the later expiry, within 30 to 365 days of creation; no change where that is not later."""
    asked = plus_seconds(F.col("expires_at"), seconds)
    bound = F.greatest(F.least(asked, plus_days(F.col("created_at"), 365)), plus_days(F.col("created_at"), 30))
    ok = bound > F.col("expires_at")
    return registry.select("id", F.when(ok, bound).otherwise(F.col("expires_at")).alias("expires_at"), ok.alias("extended"))


def schedule_resolve(rows: DataFrame, now: str, horizon: int) -> DataFrame:
    """rows(id, requested_at): when and in which state a task starts, or that it lies too far ahead. Past times stay; null is now."""
    when = F.coalesce("requested_at", at(now))
    far = when > plus_seconds(at(now), horizon)
    label = F.when(far, "rejected").when(when > at(now), "delayed").otherwise("immediate")
    return rows.select("id", F.when(~far, when).alias("available_at"), label.alias("schedule"))


def heartbeat_interval(policies: DataFrame) -> DataFrame:
    lease = F.col("retry_delay_seconds") + 1
    return policies.select("policy_id", lease.alias("lease_seconds"), F.greatest(F.lit(1), F.floor(lease / 3)).cast("long").alias("heartbeat_seconds"))


def name_valid(names: DataFrame) -> DataFrame:
    return names.select("source", "name", d.valid_name(F.col("name")).alias("valid"), d.valid_name(F.lower("name")).alias("lower_valid"))
