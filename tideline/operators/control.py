"""Commands that add rows, and who may see or do what. Inputs are DataFrames of commands; outputs are the rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..functions.clock import at

#: Most children of one completion, and most bytes of them all.
SPAWN_MOST, SPAWN_BYTES = 64, 512 * 1024
# Filters that a list may never take.
FORBIDDEN = ("payload", "payload_contains", "worker_token", "claim_token")


class FilterError(ValueError):
    """A filter that lists do not take."""


def checked_filters(filters: dict, allowed: frozenset[str], longest: int = 128) -> dict:
    """filters without empty values; payloads are never searched, unknown and overlong filters are refused."""
    for k, v in filters.items():
        if k in FORBIDDEN or k not in allowed:
            raise FilterError(f"filter {k} is not allowed")
        if isinstance(v, str) and len(v) > longest:
            raise FilterError(f"filter {k} is too long")
    return {k: v for k, v in filters.items() if v not in (None, "")}


def visible(rows: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Rows of the queues that grants(principal, queue_id; null for all) give to a principal."""
    mine = grants.where(F.col("principal") == principal).select(F.col("queue_id").alias("granted")).distinct()
    return rows.join(mine, F.col("granted").isNull() | (F.col("granted") == F.col("queue_id")), "left_semi")


def spawned(completions: DataFrame, now: str) -> DataFrame:
    """Tasks that completions(task_id, spawn: array of (queue_id, priority, payload)) add, with their lineage. Oversized ones add none."""
    size = F.aggregate("spawn", F.lit(0), lambda a, x: a + F.octet_length(x["payload"]))
    fits = completions.where((F.size("spawn") <= SPAWN_MOST) & (size <= SPAWN_BYTES))
    rows = fits.select(F.col("task_id").alias("source_task_id"), F.posexplode("spawn").alias("spawn_ordinal", "child"))
    return rows.select("source_task_id", "spawn_ordinal", "child.*", F.lit(d.READY).alias("state_code"), at(now).alias("available_at"))


def emitted(completions: DataFrame, now: str) -> DataFrame:
    """Deliveries that completions(task_id, events: array of string) add."""
    return completions.select(F.col("task_id").alias("source_task_id"), F.posexplode("events").alias("ordinal", "envelope")).withColumn("state_code", F.lit(d.PENDING)).withColumn("available_at", at(now)).withColumn("delivery_attempt", F.lit(0))


def replayed(tasks: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """New tasks for dead-lettered ones among ids(task_id), linked to them with the next free ordinals; the dead ones stay as they are."""
    dead = tasks.where(F.col("state_code") == d.DEAD).join(ids, "task_id", "left_semi")
    used = tasks.where("source_task_id is not null").groupBy(F.col("source_task_id").alias("task_id")).agg((F.max("spawn_ordinal") + 1).alias("next"))
    return dead.join(used, "task_id", "left").select(F.col("task_id").alias("source_task_id"), F.coalesce("next", F.lit(0)).alias("spawn_ordinal"), "queue_id", "priority", "policy_id", F.lit(d.READY).alias("state_code"), at(now).alias("available_at"))


def elevation_factor(elevations: DataFrame, now: str) -> DataFrame:
    """elevations(queue_id, factor, granted_at, expires_at): the factor in force for each queue, of several the one granted last."""
    live = elevations.where((F.col("granted_at") <= at(now)) & (F.col("expires_at") > at(now)))
    return live.groupBy("queue_id").agg(F.max_by("factor", F.struct("granted_at", "factor")).alias("factor"))


def counter_drift(stored: DataFrame, depth: DataFrame) -> DataFrame:
    """Stored counters(queue_id, delayed, ready, leased) that differ from derived depths, with the difference."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    s, g = stored.alias("s"), depth.alias("g")
    rows = s.join(g, "queue_id", "left").select("queue_id", *[(zero(F.col(f"g.{c}")) - zero(F.col(f"s.{c}"))).alias(f"{c}_diff") for c in ("delayed", "ready", "leased")])
    return rows.where("delayed_diff <> 0 or ready_diff <> 0 or leased_diff <> 0")


def force_expired(tasks: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """tasks with the leases of ids(task_id) ended now, for expire_leases to settle."""
    asked = ids.select(F.col("task_id").alias("__asked")).distinct()
    rows = tasks.join(asked, F.col("task_id") == F.col("__asked"), "left")
    hit = F.col("__asked").isNotNull() & (F.col("state_code") == d.LEASED)
    return rows.withColumn("lease_expires_at", F.when(hit, F.least("lease_expires_at", at(now))).otherwise(F.col("lease_expires_at"))).drop("__asked")


def terminal_replay(commands: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """commands(claim_id, operation, fingerprint) against done(claim_id, operation, fingerprint, expires_at): fresh, replay or conflict."""
    live = done.where(F.col("expires_at") > at(now)).select("claim_id", "operation", F.col("fingerprint").alias("known"))
    rows = commands.join(live, ["claim_id", "operation"], "left")
    return rows.select("claim_id", "operation", F.when(F.col("known").isNull(), "fresh").when(F.col("known") == F.col("fingerprint"), "replay").otherwise("conflict").alias("outcome"))


def capped_total(rows: DataFrame, by: str, size: str, order: str, most: int) -> DataFrame:
    """Rows of each group, in order, for as long as the running total of `size` stays within `most`."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("running_total", total).where(F.col("running_total") <= most)
