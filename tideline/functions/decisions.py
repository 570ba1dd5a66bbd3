"""Decision rules as column expressions: pure, and so pushed down and compiled with the plan around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import plus_days, plus_seconds

# State codes.
DELAYED, READY, LEASED, SUCCEEDED, DEAD, CANCELLED = 1, 2, 3, 10, 11, 12
ATTEMPT_ACTIVE = 1
QUEUE_ACTIVE, QUEUE_PAUSED, QUEUE_DRAINING = 1, 2, 3
PENDING, PUBLISHING, PUBLISHED, DELIVERY_DEAD = 1, 2, 10, 11
# Audit operations that have a name.
AUDIT_NAMES = ("create_queue", "create_policy", "activate_policy", "set_queue_state", "run_maintenance", "replay_dead_letter", "bulk_replay", "bulk_cancel")
# Operations that queue states gate, and the two cells that are not 'allowed'.
OPERATIONS = ("external_enqueue", "internal_spawn", "claim", "lease_mutation", "cancel", "delivery_relay")
GATED = {(QUEUE_DRAINING, "external_enqueue"): "rejected", (QUEUE_PAUSED, "claim"): "paused_empty"}
RETRY_DELAY_MOST = 86_400


def claimable(now: Column) -> Column:
    """Waiting and due, or leased under a lease that has ended."""
    waiting = F.col("state_code").isin(DELAYED, READY) & (F.col("available_at") <= now)
    return waiting | ((F.col("state_code") == LEASED) & (F.col("lease_expires_at") <= now))


def delivery_claimable(now: Column) -> Column:
    return ((F.col("state_code") == PENDING) & (F.col("available_at") <= now)) | ((F.col("state_code") == PUBLISHING) & (F.col("lease_expires_at") <= now))


def attempts_allowed() -> Column:
    return F.when(F.col("enabled"), F.col("max_attempts")).otherwise(1)


def retries_left(completed: Column) -> Column:
    return completed < attempts_allowed()


def exhausted_reason() -> Column:
    return F.when(F.col("enabled"), "attempts_exhausted").otherwise("retry_disabled")


def waiting_state(available: Column, now: Column) -> Column:
    return F.when(available <= now, READY).otherwise(DELAYED)


def retry_at(now: Column) -> Column:
    return plus_seconds(now, F.col("retry_delay_seconds"))


def gate(state: Column, operation: Column) -> Column:
    out = F
    for (s, o), verdict in GATED.items():
        out = out.when((state == s) & (operation == o), verdict)
    return out.otherwise("allowed")


def audit_label(code: Column) -> Column:
    named = F.element_at(F.array(*[F.lit(x) for x in AUDIT_NAMES]), F.least(code, F.lit(len(AUDIT_NAMES))))
    return F.when(code.between(1, len(AUDIT_NAMES)), named).otherwise(F.concat(F.lit("operation_"), code.cast("string")))


def freshness(age_seconds: Column, most: int) -> Column:
    return F.when(age_seconds.isNull(), "unavailable").when((age_seconds >= 0) & (age_seconds <= most), "fresh").otherwise("stale")


def ratio_rank(ratio: Column, warn: float = 0.7, critical: float = 0.9) -> Column:
    """0 ok, 1 warning, 2 critical."""
    return F.when(ratio >= critical, 2).when(ratio >= warn, 1).otherwise(0)


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), rank + 1)


def wait_as_ratio(wait: Column) -> Column:
    """Seconds of waiting for a connection, on the scale of the ratios."""
    return F.when(wait >= 0.2, 0.95).when(wait >= 0.05, 0.7 + (wait - 0.05) / 0.15 * 0.2).when(wait >= 0.03, 0.55).otherwise(0.2)


def exponential(base: Column | float, exponent: Column, most: float) -> Column:
    """min(base * 2**exponent, most), without overflow for large exponents."""
    b = F.lit(float(base)) if isinstance(base, (int, float)) else base
    return F.least(b * F.pow(F.lit(2.0), F.least(exponent.cast("double"), F.lit(60.0))), F.lit(float(most)))


def capped_hint(hint: Column, most: float) -> Column:
    """A server's hint of seconds to wait; null unless it is a finite number of at least 0."""
    h = hint.cast("double")
    return F.when(h.isNull() | F.isnan(h) | (h < 0) | (h == float("inf")), None).otherwise(F.least(h, F.lit(float(most))))


def retention_expired(created: Column, days: int, now: Column) -> Column:
    return now >= plus_days(created, days)


def valid_name(name: Column) -> Column:
    return F.length(name).between(1, 128) & name.rlike(r"\A[a-z0-9][a-z0-9._-]*\z")


def bounded_code(code: Column, most: int = 128) -> Column:
    cleaned = F.regexp_replace(F.trim(code), r"[^\p{L}\p{N}_-]", "_")
    return F.substring(F.when(F.length(cleaned) > 0, cleaned).otherwise("maintenance_failed"), 1, most)


def http_class(status: Column) -> Column:
    """What a delivery's HTTP status means: ack, retry or permanent."""
    return F.when(status.between(200, 299), "ack").when(status.isin(408, 425, 429) | (status >= 500), "retry").otherwise("permanent")
