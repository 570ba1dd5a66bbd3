"""Outgoing deliveries: what is due, how it ended, and when it is tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..functions.clock import at, plus_days, seconds_between


def delivery_claimable(rows: DataFrame, now: str, limit: int) -> DataFrame:
    got = rows.where(d.delivery_claimable(at(now))).orderBy("available_at", "event_id").limit(limit)
    return got.select("event_id", "available_at", (F.col("state_code") == d.PUBLISHING).alias("reclaimed"), (F.col("delivery_attempt") + 1).alias("delivery_attempt"))


def delivery_depth(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("state_code") == d.PENDING).alias("pending"), F.count_if(F.col("state_code") == d.PUBLISHING).alias("publishing"))


def delivery_lag(rows: DataFrame, now: str) -> DataFrame:
    first = rows.where(F.col("state_code") == d.PENDING).agg(F.min("available_at").alias("first"))
    return first.select(F.coalesce(F.greatest(F.lit(0), seconds_between(F.col("first"), at(now))), F.lit(0)).alias("lag_seconds"))


def delivery_outcome(rows: DataFrame, most_attempts: int) -> DataFrame:
    """What a failed try means for each delivery that is under way."""
    final = F.col("failure_code").isNotNull() | (F.col("delivery_attempt") >= most_attempts)
    return rows.where(F.col("state_code") == d.PUBLISHING).select("event_id", "delivery_attempt", F.when(final, d.DELIVERY_DEAD).otherwise(d.PENDING).alias("new_state"))


def delivery_backoff(rows: DataFrame, base: float, most: float, cap: float) -> DataFrame:
    """rows(event_id, delivery_attempt, hint): seconds to wait, and whether the policy or the server's hint set them."""
    policy = d.exponential(base, F.greatest(F.col("delivery_attempt") - 1, F.lit(0)), most)
    hint = d.capped_hint(F.col("hint"), cap)
    told = F.coalesce(hint >= policy, F.lit(False))
    return rows.select("event_id", F.when(told, hint).otherwise(policy).alias("delay_seconds"), F.when(told, "retry_after").otherwise("policy").alias("source"))


def delivery_in_queue(rows: DataFrame, tasks: DataFrame, queue_id: int) -> DataFrame:
    ids = tasks.where(F.col("queue_id") == queue_id).select(F.col("task_id").alias("source_task_id"))
    return rows.join(ids, "source_task_id", "left_semi").select("event_id", "source_task_id", "state_code")


def bridge_backoff(rows: DataFrame, initial: float, most: float) -> DataFrame:
    return rows.select("event_id", d.exponential(initial, F.greatest(F.col("delivery_attempt") - 1, F.lit(0)), most).alias("delay_seconds"))


def client_backoff(rows: DataFrame, initial: float, multiplier: float, most: float, hint_most: float) -> DataFrame:
    """rows(sample_id, failures, hint_ms): the later of the exponential delay and the server's hint."""
    steps = F.least(F.col("failures").cast("double"), F.lit(60.0))
    delay = F.least(F.lit(initial) * F.pow(F.lit(multiplier), steps), F.lit(most))
    hint = F.least(F.greatest(F.coalesce("hint_ms", F.lit(0)), F.lit(0)) / 1000.0, F.lit(hint_most))
    return rows.select("sample_id", F.round(F.greatest(delay, hint), 6).alias("delay_seconds"))


def bridge_alert(groups: DataFrame, now: str, warn_seconds: int) -> DataFrame:
    """groups(name, oldest, pending, delivered, retries): a warning where a backlog is old and either stands still or fails."""
    lag = seconds_between(F.col("oldest"), at(now))
    bad = (F.col("pending") > 0) & (lag >= warn_seconds) & ((F.col("delivered") == 0) | (F.col("retries") > 0))
    return groups.select("name", "pending", F.when(F.coalesce(bad, F.lit(False)), "warning").otherwise("none").alias("severity"))


def outbox_claim_batch(rows: DataFrame, now: str, limit: int) -> DataFrame:
    """rows(namespace, row_id, ...): the due intents, oldest first."""
    got = rows.where(d.delivery_claimable(at(now))).orderBy("available_at", "namespace", "row_id").limit(limit)
    return got.select("namespace", "row_id", "available_at")


def capped_depth(rows: DataFrame, cap: int) -> DataFrame:
    """A count that looks at cap + 1 rows at most."""
    seen = rows.where(F.col("state_code") == d.PENDING).limit(cap + 1).agg(F.count("*").alias("n"))
    return seen.select(F.least("n", F.lit(cap)).alias("depth"), (F.col("n") > cap).alias("capped"))


def oldest_pending(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("state_code") == d.PENDING).agg(F.min("available_at").alias("oldest_pending"))


def published_purge(rows: DataFrame, now: str, days: int) -> DataFrame:
    return rows.where((F.col("state_code") == d.PUBLISHED) & (F.col("terminal_at") < plus_days(at(now), -days))).select("event_id", "terminal_at")
