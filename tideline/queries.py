"""Queries over the driver's tables, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.clock import at, plus_days, plus_seconds
from .operators import delivery, queues, tasks, upkeep
from .plans import oracle
from .sources import fixtures
from .sources.fixtures import E, N

Tables = Callable[[str], DataFrame]
_BOUND: dict[str, Callable[[SparkSession, Tables], DataFrame]] = {}


def _query(f: Callable[[SparkSession, Tables], DataFrame]) -> Callable[[SparkSession, Tables], DataFrame]:
    _BOUND[f.__name__] = f
    return f


def _bind(name: str, f: Callable[..., DataFrame], *inputs: str, **params: object) -> None:
    """Register an operator over derived tables."""
    _BOUND[name] = lambda spark, t: f(*[t(i) for i in inputs], **params)


T, Q, P, A, D, L, S = "fx_tasks", "fx_queues", "fx_policies", "fx_attempts", "fx_delivery", "fx_latency", "fx_submissions"
_bind("scan_claimable", tasks.scan_claimable, T, now=N)
_bind("claim_head", tasks.claim_head, T, Q, now=N)
_bind("claim_batch", tasks.claim_batch, T, Q, P, A, now=N, per_queue=3, lease_seconds=30)
_bind("expire_leases", tasks.expire_leases, T, P, A, now=N)
_bind("retry_decision", tasks.retry_decision, T, P, A, now=N)
_bind("fail_outcome", tasks.retry_decision, T, P, A, now=N, fatal="handler.error")
_bind("attempt_counts", tasks.attempt_counts, A)
_bind("last_failure", tasks.last_failure, A)
_bind("wait_processing", tasks.wait_processing, A)
_bind("project_active", tasks.project_active, T)
_bind("page_tasks", tasks.page_tasks, T, P, queue_id=3, size=50, skip=50)
_bind("list_dead_letters", tasks.list_dead_letters, T, since="1997-01-01 00:00:00", until="1997-12-31 00:00:00", size=50)
_bind("page_queues", queues.page_queues, Q, after="nation-12", size=10)
_bind("task_lookup", tasks.task_lookup, T, P, Q, A, now=N, days=90)
_bind("all_tasks", tasks.all_tasks, T)
_bind("bulk_replay_candidates", tasks.bulk_candidates, T, states=[11], time="terminal_at", cap=100)
_bind("bulk_cancel_candidates", tasks.bulk_candidates, T, states=[1, 2], time="created_at", cap=100)
_bind("complete_apply", tasks.complete_apply, T, now=N)
_bind("move_terminal", tasks.move_counts, T, now=N)
_bind("lease_fence", tasks.lease_fence, T, A, now=N)
_bind("spawn_children", tasks.spawn_children, T)
_bind("spawn_depth", tasks.spawn_depth, T)
_bind("spawn_fanout", tasks.spawn_fanout, T)
_bind("next_spawn_ordinal", tasks.next_spawn_ordinal, T)
_bind("lineage_consistency", tasks.lineage_consistency, T)
_bind("ordinal_contiguity", upkeep.ordinal_contiguity, "conversations")
_bind("heartbeat_interval", queues.heartbeat_interval, P)
_bind("dedup_outcomes", queues.dedup_outcomes, S)
_bind("resolve_submission", queues.resolve_submission, S, now=E, days=90)
_bind("depth_admission", queues.depth_admission, T, Q, per_queue=400, instance=10_000)
_bind("queue_depth", queues.queue_depth, T)
_bind("instance_depth", queues.instance_depth, T)
_bind("drain_progress", queues.drain_progress, Q, T)
_bind("queue_stats", queues.queue_stats, Q, T, now=N)
_bind("stats_snapshot", queues.stats_snapshot, Q, T, now=N, most_seconds=21_600)
_bind("gate_matrix", queues.gate_matrix, Q)
_bind("config_cas", queues.config_cas, Q, expected=2, new_state=2)
_bind("next_policy_version", queues.next_policy_version, P)
_bind("policy_valid", queues.policy_valid, P, ceiling=43_200)
_bind("delivery_claimable", delivery.delivery_claimable, D, now=E, limit=100)
_bind("delivery_depth", delivery.delivery_depth, D)
_bind("delivery_lag", delivery.delivery_lag, D, now=E)
_bind("delivery_outcome", delivery.delivery_outcome, D, most_attempts=50)
_bind("delivery_in_queue", delivery.delivery_in_queue, D, T, queue_id=7)
_bind("bridge_backoff", delivery.bridge_backoff, D, initial=0.5, most=60.0)
_bind("capped_depth", delivery.capped_depth, D, cap=500)
_bind("oldest_pending", delivery.oldest_pending, D)
_bind("published_purge", delivery.published_purge, D, now=E, days=10)
_bind("partition_days", upkeep.partition_days, A, time="claimed_at")
_bind("op_stats", upkeep.op_stats, L)
_bind("op_percentiles", upkeep.op_percentiles, L)
_bind("qualification", upkeep.qualification, L, measured_seconds=30.0)
_bind("latency_histogram", upkeep.latency_histogram, L)
_bind("metric_series", upkeep.metric_series, L)
_bind("error_ratio", upkeep.error_ratio, L)
_bind("longpoll_error_ratio", upkeep.longpoll_error_ratio, L)
_bind("pressure_status", upkeep.pressure_status, "fx_pressure")
_bind("peak_pressure", upkeep.peak_pressure, "fx_pressure")
_bind("payload_size", upkeep.payload_size, "documents", soft=8_192, hard=16_384)
_bind("content_hash", upkeep.content_hash, "documents")
_bind("redact_diag", upkeep.redact_diag, "events", longest=5)
_bind("inv_report", upkeep.inv_report, T, A)
_bind("inv_due_gating", upkeep.inv_due_gating, T, now=N)


@_query
def claim_multi(spark: SparkSession, t: Tables) -> DataFrame:
    asked = [(1, 1, 5), (1, 2, 2), (1, 3, 7), (2, 1, 1), (2, 2, 4), (3, 1, 24), (3, 2, 0)]
    requests = spark.createDataFrame(asked, "request_id int, position int, queue_id int")
    return tasks.claim_multi(tasks.claim_head(t(T), t(Q), N), requests).select("request_id", "position", F.col("queue_id").cast("int"), "task_id")


@_query
def list_attempts(spark: SparkSession, t: Tables) -> DataFrame:
    return tasks.list_attempts(t(A), F.col("task_id") % 50 == 7, "1995-01-01 00:00:00", "1997-12-31 00:00:00", 50)


@_query
def list_audit(spark: SparkSession, t: Tables) -> DataFrame:
    audit = t(D).select(F.col("event_id").alias("audit_id"), F.col("available_at").alias("audit_at"), (F.col("source_task_id") % 30).alias("queue_id"), (1 + F.col("event_id") % 15).cast("int").alias("operation_code"))
    return queues.list_audit(audit, t(Q), "2024-01-01 00:00:00", "2024-01-08 00:00:00", 50)


@_query
def cancel_apply(spark: SparkSession, t: Tables) -> DataFrame:
    return tasks.cancel_apply(t(T), F.col("task_id") % 13 == 0, N)


@_query
def schedule_resolve(spark: SparkSession, t: Tables) -> DataFrame:
    return queues.schedule_resolve(t(D).select(F.col("event_id").alias("id"), F.col("available_at").alias("requested_at")), E, 86_400)


@_query
def catalog_missing(spark: SparkSession, t: Tables) -> DataFrame:
    catalog = spark.createDataFrame([(n,) for n in ("nation-1", "nation-3", "mail-out", "image-resize", "nation-24")], "name string")
    return queues.catalog_missing(catalog, t(Q))


@_query
def delivery_backoff(spark: SparkSession, t: Tables) -> DataFrame:
    rows = t(D).withColumn("hint", F.when(F.col("delivery_attempt") % 3 == 0, F.col("delivery_attempt") * 2))
    return delivery.delivery_backoff(rows, 1.0, 300.0, 3600.0)


@_query
def client_backoff(spark: SparkSession, t: Tables) -> DataFrame:
    rows = t(L).select("sample_id", (F.col("sample_id") % 8).alias("failures"), F.when(F.col("sample_id") % 5 == 0, (F.col("sample_id") % 40) * 100).alias("hint_ms"))
    return delivery.client_backoff(rows, 0.05, 2.0, 2.0, 30.0)


@_query
def bridge_alert(spark: SparkSession, t: Tables) -> DataFrame:
    pending = F.col("state_code") == 1
    groups = t(D).groupBy(F.col("event_type").alias("name")).agg(F.min(F.when(pending, F.col("available_at"))).alias("oldest"), F.count_if(pending).alias("pending"), F.count_if(F.col("state_code") == 10).alias("delivered"), F.count_if(F.col("delivery_attempt") > 1).alias("retries"))
    return delivery.bridge_alert(groups, E, 300)


@_query
def outbox_claim_batch(spark: SparkSession, t: Tables) -> DataFrame:
    return delivery.outbox_claim_batch(t(D).select(F.col("event_type").alias("namespace"), F.col("event_id").alias("row_id"), "available_at", "state_code", "lease_expires_at"), E, 50)


@_query
def registry_purge(spark: SparkSession, t: Tables) -> DataFrame:
    return queues.registry_purge(t(S).select(F.col("submission_id").alias("id"), plus_days(F.col("submitted_at"), 10).alias("expires_at")), E, 1_000)


@_query
def registry_extend(spark: SparkSession, t: Tables) -> DataFrame:
    expires = F.col("submitted_at") + F.make_dt_interval((F.col("submission_id") % 400).cast("int"))
    return queues.registry_extend(t(S).select(F.col("submission_id").alias("id"), F.col("submitted_at").alias("created_at"), expires.alias("expires_at")), 20 * 86_400)


def _parents(t: Tables) -> DataFrame:
    rows = t(A).where(F.col("worker_id").isin("w0", "w1", "w2", "w3"))
    return rows.select(F.col("worker_id").alias("parent"), F.to_date("claimed_at").alias("day")).distinct()


@_query
def missing_partitions(spark: SparkSession, t: Tables) -> DataFrame:
    present = _parents(t)
    return upkeep.missing_partitions(present, present.select("parent").distinct(), N[:10], 30)


@_query
def partition_headroom(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.partition_headroom(_parents(t), N[:10])


@_query
def partition_names(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.partition_names(t(A).select(F.to_date("claimed_at").alias("day")).distinct(), "task_attempts")


def _days(t: Tables) -> DataFrame:
    day = lambda rows, time, parent: upkeep.partition_days(rows, time).select(F.lit(parent).alias("parent"), "day", "rows")
    return day(t(A), "claimed_at", "task_attempts").unionByName(day(t(T).where("terminal_at is not null"), "terminal_at", "tasks_terminal"))


@_query
def retention_plan(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.retention_plan(_days(t), N, 90)


@_query
def retention_window(spark: SparkSession, t: Tables) -> DataFrame:
    oldest = lambda rows, time, name: rows.agg(F.to_date(F.min(time)).alias("day")).select(F.lit(name).alias("window"), "day")
    return upkeep.retention_window(oldest(t(A), "claimed_at", "attempt").unionByName(oldest(t(T), "terminal_at", "task_terminal")), N[:10])


@_query
def retention_alerts(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.retention_alerts(upkeep.partition_headroom(_parents(t), N[:10]), outcome="failed", failures=2, stale=True)


@_query
def maintenance_status(spark: SparkSession, t: Tables) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("singleton"), F.lit("succeeded").alias("outcome"), at(N).alias("started_at"), plus_seconds(at(N), 60).alias("finished_at"), F.lit(0).alias("consecutive_failures"))


@_query
def select_candidate(spark: SparkSession, t: Tables) -> DataFrame:
    valid = ~F.col("outcome").isin("planned_pause", "planned_drain", "invalid_request")
    runs = t(L).withColumn("candidate_id", F.concat_ws("/", "operation", "scenario"))
    p99 = upkeep.nearest_ranks(runs.where(valid), ["candidate_id"], "latency_ns", p99_ns=990)
    rows = runs.groupBy("candidate_id").agg((F.count("*") * 1024).alias("bytes"), F.count("*").alias("wal_bytes"), (F.count_if(F.col("outcome").isin("success", "empty")) / F.nullif(F.count_if(valid), F.lit(0))).alias("success_ratio"))
    return upkeep.select_candidate(rows.join(p99, "candidate_id", "left"))


@_query
def workload_matrix(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.workload_matrix(spark, payload_bytes=[1_024, 262_144, 1_048_576], queues=[1, 10, 100], operation=["cancel", "claim", "complete", "enqueue", "fail", "heartbeat"], scenario=["due", "future", "reclaim"])


@_query
def event_valid(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.event_valid(t("pages").select(F.col("page_id").alias("id"), F.col("url").alias("source"), F.split_part("url", F.lit(":"), F.lit(1)).alias("type")))


@_query
def name_valid(spark: SparkSession, t: Tables) -> DataFrame:
    name = lambda table, column: t(table).select(F.lit(table).alias("source"), F.col(column).alias("name"))
    return queues.name_valid(name("nation", "n_name").unionByName(name("customer", "c_name")))


@_query
def bound_code(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.bound_code(t(T).where("failure_code is not null"))


@_query
def inv_unique(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.inv_unique(t("lineitem"), "l_orderkey", "l_linenumber")


@_query
def inv_claim_ordering(spark: SparkSession, t: Tables) -> DataFrame:
    return upkeep.inv_claim_ordering(t(T), tasks.claim_head(t(T), t(Q), N), N)


def _over_tables(f: Callable[[SparkSession, Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, lambda name: fixtures.load(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _over_tables(f) for name, f in sorted(_BOUND.items())}
ORACLE_SQL: dict[str, str] = {name: fixtures.oracle(sql) for name, sql in oracle.SQL.items()}
