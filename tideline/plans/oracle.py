"""For each query the same result in SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

N = "TIMESTAMP '1998-09-02 00:00:00'"
E = "TIMESTAMP '2024-01-20 00:00:00'"
DUE = f"((state_code IN (1, 2) AND available_at <= {N}) OR (state_code = 3 AND lease_expires_at <= {N}))"
DDUE = f"((state_code = 1 AND available_at <= {E}) OR (state_code = 2 AND lease_expires_at <= {E}))"
SEC = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 1000000) AS BIGINT)"
VALID = "outcome NOT IN ('planned_pause', 'planned_drain', 'invalid_request')"
HEAD = f"""SELECT queue_id, task_id, priority, available_at, state_code AS source_state FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.queue_id ORDER BY t.priority DESC, t.available_at, t.task_id) AS r
  FROM (SELECT * FROM fx_tasks WHERE {DUE}) t JOIN fx_queues q ON q.queue_id = t.queue_id AND q.state_code <> 2) x WHERE r = 1"""
ENDED = "SELECT task_id, count(*) FILTER (WHERE outcome_code <> 1) AS ended, max(generation) AS generation FROM fx_attempts GROUP BY task_id"
LASTF = """SELECT task_id, attempt_id, failure_code, ended_at FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ended_at DESC, attempt_id DESC) AS r FROM fx_attempts WHERE failure_code IS NOT NULL AND ended_at IS NOT NULL) y WHERE r = 1"""
EXPIRY = f"""SELECT task_id, completed, new_state,
  CASE WHEN new_state < 10 THEN {N} + to_seconds(retry_delay_seconds) END AS new_available_at,
  CASE WHEN new_state >= 10 THEN {N} END AS terminal_at,
  CASE WHEN new_state = 11 THEN 'lease.expired' END AS failure_code,
  CASE WHEN new_state = 12 THEN 'cancel_requested' WHEN new_state = 11 THEN CASE WHEN enabled THEN 'attempts_exhausted' ELSE 'retry_disabled' END ELSE 'retry_scheduled' END AS reason
FROM (SELECT *, CAST(CASE WHEN cancel_requested THEN 12 WHEN completed >= CASE WHEN enabled THEN max_attempts ELSE 1 END THEN 11 WHEN retry_delay_seconds = 0 THEN 2 ELSE 1 END AS INT) AS new_state
      FROM (SELECT t.task_id, t.cancel_requested, p.enabled, p.max_attempts, p.retry_delay_seconds, CAST(coalesce(a.ended, 0) + 1 AS INT) AS completed
            FROM fx_tasks t JOIN fx_policies p ON p.policy_id = t.policy_id LEFT JOIN ({ENDED}) a ON a.task_id = t.task_id
            WHERE t.state_code = 3 AND t.lease_expires_at <= {N}) z) v"""


def _decision(stop: str) -> str:
    return f"""SELECT task_id, completed, CASE WHEN go THEN 'retry_scheduled' ELSE 'dead_lettered' END AS outcome,
  CASE WHEN go THEN NULL WHEN stop THEN 'non_retryable' WHEN enabled THEN 'attempts_exhausted' ELSE 'retry_disabled' END AS reason,
  CAST(CASE WHEN NOT go THEN 11 WHEN retry_delay_seconds = 0 THEN 2 ELSE 1 END AS INT) AS new_state,
  CASE WHEN go THEN {N} + to_seconds(retry_delay_seconds) END AS available_at
FROM (SELECT *, completed < CASE WHEN enabled THEN max_attempts ELSE 1 END AND NOT stop AS go FROM (
  SELECT t.task_id, p.enabled, p.max_attempts, p.retry_delay_seconds, CAST(coalesce(a.ended, 0) + 1 AS INT) AS completed, {stop} AS stop
  FROM fx_tasks t JOIN fx_policies p ON p.policy_id = t.policy_id LEFT JOIN ({ENDED}) a ON a.task_id = t.task_id LEFT JOIN ({LASTF}) f ON f.task_id = t.task_id
  WHERE t.state_code = 3) z) v"""


DEPTH = "SELECT queue_id, count(*) FILTER (WHERE state_code = 1) AS delayed, count(*) FILTER (WHERE state_code = 2) AS ready, count(*) FILTER (WHERE state_code = 3) AS leased FROM fx_tasks WHERE state_code <= 3 GROUP BY queue_id"
PARENTS = "SELECT DISTINCT worker_id AS parent, CAST(claimed_at AS DATE) AS day FROM fx_attempts WHERE worker_id IN ('w0', 'w1', 'w2', 'w3')"
HEADROOM = f"""WITH p AS ({PARENTS}),
  m AS (SELECT q.parent, min(g.d) AS missing FROM (SELECT DISTINCT parent FROM p) q CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1998-09-02', DATE '2008-09-02', INTERVAL 1 DAY)) AS DATE) AS d) g
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.parent = q.parent AND p.day = g.d) GROUP BY q.parent),
  r AS (SELECT parent, CASE WHEN missing > DATE '1998-09-02' THEN missing - 1 END AS through, CAST(missing - DATE '1998-09-02' - 1 AS INT) AS remaining,
        missing <= DATE '1998-09-02' + 30 AND EXISTS (SELECT 1 FROM p WHERE p.parent = m.parent AND p.day > m.missing) AS interior_gap FROM m)
SELECT parent, through, remaining, interior_gap, parent = first_value(parent) OVER (ORDER BY NOT interior_gap, CASE WHEN interior_gap THEN 0 ELSE remaining END, parent) AS worst FROM r"""
P99 = "(SELECT CAST(quantile_disc(latency_ns, 0.99) AS BIGINT) FROM fx_latency WHERE operation = '{o}' AND scenario = 'baseline' AND " + VALID + ")"
AUDIT_NAMES = "['create_queue', 'create_policy', 'activate_policy', 'set_queue_state', 'run_maintenance', 'replay_dead_letter', 'bulk_replay', 'bulk_cancel']"

SQL = {
    "scan_claimable": f"SELECT task_id, queue_id, state_code, priority, available_at FROM fx_tasks WHERE {DUE}",
    "claim_head": HEAD,
    "claim_batch": f"""SELECT queue_id, task_id, CAST(r AS INT) AS rank, source_state, 3 AS state_code, CAST(coalesce(generation, 0) + 1 AS INT) AS generation, {N} + INTERVAL 30 SECOND AS lease_expires_at FROM (
  SELECT t.queue_id, t.task_id, t.state_code AS source_state, a.generation, row_number() OVER (PARTITION BY t.queue_id ORDER BY t.priority DESC, t.available_at, t.task_id) AS r
  FROM (SELECT * FROM fx_tasks WHERE {DUE}) t JOIN fx_queues q ON q.queue_id = t.queue_id AND q.state_code <> 2
  LEFT JOIN ({ENDED}) a ON a.task_id = t.task_id
  WHERE t.task_id NOT IN (SELECT task_id FROM ({EXPIRY}) e WHERE new_state <> 2)) x WHERE r <= 3""",
    "claim_multi": f"""SELECT request_id, position, queue_id, task_id FROM (
  SELECT r.*, h.task_id, row_number() OVER (PARTITION BY r.request_id ORDER BY r.position) AS k
  FROM (VALUES (1, 1, 5), (1, 2, 2), (1, 3, 7), (2, 1, 1), (2, 2, 4), (3, 1, 24), (3, 2, 0)) AS r(request_id, position, queue_id) JOIN ({HEAD}) h ON h.queue_id = r.queue_id) x WHERE k = 1""",
    "expire_leases": EXPIRY,
    "retry_decision": _decision("false"),
    "fail_outcome": _decision("coalesce(f.failure_code = 'handler.error', false)"),
    "attempt_counts": "SELECT task_id, count(*) AS total, count(*) FILTER (WHERE outcome_code <> 1) AS ended, count(*) FILTER (WHERE outcome_code = 1) AS active, max(generation) AS max_generation FROM fx_attempts GROUP BY task_id",
    "last_failure": LASTF,
    "wait_processing": f"""SELECT attempt_id, task_id, {SEC.format(a="lag(ended_at) OVER (PARTITION BY task_id ORDER BY generation)", b="claimed_at")} AS wait_seconds, {SEC.format(a="claimed_at", b="ended_at")} AS processing_seconds FROM fx_attempts""",
    "project_active": """SELECT task_id, queue_id, CASE state_code WHEN 1 THEN 'delayed' WHEN 2 THEN 'ready' ELSE 'leased' END AS state, priority,
  CASE WHEN state_code = 3 THEN claimed_at END AS claimed_at, CASE WHEN state_code = 3 THEN lease_expires_at END AS lease_expires_at, CASE WHEN state_code = 3 THEN worker_id END AS worker_id FROM fx_tasks WHERE state_code <= 3""",
    "page_tasks": """WITH r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, task_id DESC) AS k FROM fx_tasks WHERE queue_id = 3 AND state_code <= 3)
SELECT task_id, state_code, created_at, version AS policy_version, (SELECT count(*) FROM r WHERE k BETWEEN 51 AND 101) > 50 AS has_more FROM r JOIN fx_policies p ON p.policy_id = r.policy_id WHERE k BETWEEN 51 AND 101""",
    "list_attempts": """SELECT attempt_id, task_id, claimed_at, ended_at, CASE outcome_code WHEN 1 THEN 'active' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'retry_scheduled' WHEN 4 THEN 'dead_lettered' WHEN 5 THEN 'expired' ELSE 'cancelled' END AS outcome
FROM fx_attempts WHERE task_id % 50 = 7 AND claimed_at >= TIMESTAMP '1995-01-01 00:00:00' AND claimed_at <= TIMESTAMP '1997-12-31 00:00:00' ORDER BY claimed_at DESC, attempt_id DESC LIMIT 51""",
    "list_dead_letters": "SELECT task_id, queue_id, terminal_at, failure_code, CAST(NULL AS VARCHAR) AS payload FROM fx_tasks WHERE state_code = 11 AND terminal_at >= TIMESTAMP '1997-01-01 00:00:00' AND terminal_at <= TIMESTAMP '1997-12-31 00:00:00' ORDER BY terminal_at DESC, task_id DESC LIMIT 51",
    "list_audit": f"""SELECT audit_id, audit_at, a.queue_id, q.name AS queue_name, CASE WHEN code <= 8 THEN ({AUDIT_NAMES})[code] ELSE 'operation_' || code END AS operation FROM (
  SELECT event_id AS audit_id, available_at AS audit_at, source_task_id % 30 AS queue_id, CAST(1 + event_id % 15 AS INT) AS code FROM fx_delivery
  WHERE available_at >= TIMESTAMP '2024-01-01 00:00:00' AND available_at <= TIMESTAMP '2024-01-08 00:00:00' ORDER BY available_at DESC, event_id DESC LIMIT 51) a LEFT JOIN fx_queues q ON q.queue_id = a.queue_id""",
    "page_queues": "SELECT queue_id, name, state_code, config_version, active_policy_id FROM fx_queues WHERE name > 'nation-12' ORDER BY name LIMIT 11",
    "task_lookup": f"""SELECT t.task_id, q.name AS queue_name, t.state_code, CASE WHEN t.state_code <= 3 THEN 'active' ELSE 'terminal' END AS part, p.version AS policy_version, CAST(coalesce(a.ended, 0) AS BIGINT) AS ended_attempts, coalesce(t.failure_code, f.failure_code) AS failure_code
FROM fx_tasks t JOIN fx_queues q ON q.queue_id = t.queue_id JOIN fx_policies p ON p.policy_id = t.policy_id LEFT JOIN ({ENDED}) a ON a.task_id = t.task_id LEFT JOIN ({LASTF}) f ON f.task_id = t.task_id
WHERE t.state_code <= 3 OR {N} < t.terminal_at + INTERVAL 90 DAY""",
    "all_tasks": "SELECT task_id, queue_id, state_code, CASE WHEN state_code <= 3 THEN 'active' ELSE 'terminal' END AS part FROM fx_tasks",
    "bulk_replay_candidates": "WITH r AS (SELECT *, row_number() OVER (ORDER BY terminal_at, task_id) AS k FROM fx_tasks WHERE state_code = 11) SELECT task_id, queue_id, terminal_at, (SELECT count(*) FROM r) > 100 AS truncated FROM r WHERE k <= 100",
    "bulk_cancel_candidates": "WITH r AS (SELECT *, row_number() OVER (ORDER BY created_at, task_id) AS k FROM fx_tasks WHERE state_code IN (1, 2)) SELECT task_id, queue_id, created_at, (SELECT count(*) FROM r) > 100 AS truncated FROM r WHERE k <= 100",
    "cancel_apply": f"""SELECT task_id, state_code AS old_state, CAST(CASE WHEN state_code <= 2 OR (state_code = 3 AND cancel_requested) THEN 12 ELSE state_code END AS INT) AS new_state,
  CASE WHEN state_code <= 2 THEN 'cancelled' WHEN state_code > 3 THEN 'already_terminal' WHEN cancel_requested THEN 'acknowledged' ELSE 'requested' END AS result,
  CASE WHEN state_code <= 2 OR (state_code = 3 AND cancel_requested) THEN {N} ELSE terminal_at END AS terminal_at FROM fx_tasks WHERE task_id % 13 = 0""",
    "complete_apply": f"SELECT task_id, queue_id, 10 AS new_state, {N} AS terminal_at FROM fx_tasks WHERE state_code = 3 AND lease_expires_at > {N} AND NOT cancel_requested",
    "move_terminal": f"SELECT queue_id, CAST(sum(CASE WHEN m THEN 0 ELSE 1 END) AS BIGINT) AS remaining, CAST(sum(CASE WHEN m THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM (SELECT queue_id, state_code = 3 AND lease_expires_at > {N} AND NOT cancel_requested AS m FROM fx_tasks WHERE state_code <= 3) x GROUP BY queue_id",
    "lease_fence": f"SELECT t.task_id, a.generation, CASE WHEN t.lease_expires_at > {N} THEN 'CURRENT' ELSE 'STALE' END AS fence FROM fx_tasks t JOIN ({ENDED}) a ON a.task_id = t.task_id WHERE t.state_code = 3",
    "spawn_children": "SELECT source_task_id, count(*) AS children, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY spawn_ordinal, task_id) AS child_ids FROM fx_tasks WHERE source_task_id IS NOT NULL GROUP BY source_task_id",
    "spawn_depth": """WITH RECURSIVE t(task_id, root, depth) AS (
  SELECT a.task_id, a.task_id, 0 FROM fx_tasks a WHERE a.source_task_id IS NULL OR a.source_task_id = a.task_id OR NOT EXISTS (SELECT 1 FROM fx_tasks p WHERE p.task_id = a.source_task_id)
  UNION ALL SELECT c.task_id, t.root, t.depth + 1 FROM fx_tasks c JOIN t ON c.source_task_id = t.task_id AND c.task_id <> t.task_id)
SELECT root, max(depth) AS max_depth, count(*) AS size FROM t GROUP BY root HAVING count(*) > 1""",
    "spawn_fanout": "SELECT source_task_id, count(*) AS children, CAST(sum(payload_bytes) AS BIGINT) AS bytes, sum(payload_bytes) > 524288 AS over_limit FROM fx_tasks WHERE source_task_id IS NOT NULL GROUP BY source_task_id",
    "next_spawn_ordinal": "SELECT t.task_id, CAST(coalesce((SELECT max(c.spawn_ordinal) + 1 FROM fx_tasks c WHERE c.source_task_id = t.task_id), 0) AS INT) AS next_ordinal FROM fx_tasks t",
    "lineage_consistency": "SELECT source_task_id, count(*) AS children, list_sort(list(spawn_ordinal)) = range(0, count(*)) AS consistent FROM fx_tasks WHERE source_task_id IS NOT NULL GROUP BY source_task_id",
    "ordinal_contiguity": "SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, list_sort(list(turn)) = range(0, count(*)) AS contiguous FROM conversations GROUP BY conv_id",
    "heartbeat_interval": "SELECT policy_id, CAST(retry_delay_seconds + 1 AS INT) AS lease_seconds, CAST(greatest(1, (retry_delay_seconds + 1) // 3) AS BIGINT) AS heartbeat_seconds FROM fx_policies",
    "dedup_outcomes": """SELECT submission_id, s.producer_id, s.queue_name, s.idem_key, CASE WHEN s.submission_id = w.wid THEN 'new' WHEN s.fingerprint = w.fp THEN 'replay' ELSE 'conflict' END AS outcome
FROM fx_submissions s JOIN (SELECT producer_id, queue_name, idem_key, arg_min(submission_id, (submitted_at, submission_id)) AS wid, arg_min(fingerprint, (submitted_at, submission_id)) AS fp FROM fx_submissions GROUP BY ALL) w
  ON w.producer_id = s.producer_id AND w.queue_name = s.queue_name AND w.idem_key = s.idem_key""",
    "resolve_submission": f"""SELECT producer_id, queue_name, idem_key, submission_id, submitted_at + INTERVAL 90 DAY AS expires_at, {E} < submitted_at + INTERVAL 90 DAY AS visible FROM (
  SELECT *, row_number() OVER (PARTITION BY producer_id, queue_name, idem_key ORDER BY submitted_at, submission_id) AS r FROM fx_submissions) x WHERE r = 1""",
    "depth_admission": f"""WITH dd AS (SELECT q.queue_id, CAST(coalesce(delayed + ready + leased, 0) AS BIGINT) AS depth FROM fx_queues q LEFT JOIN ({DEPTH}) d ON d.queue_id = q.queue_id), i AS (SELECT CAST(count(*) AS BIGINT) AS instance_depth FROM fx_tasks WHERE state_code <= 3)
SELECT queue_id, depth, instance_depth, CASE WHEN depth + 1 > 400 THEN 'queue' WHEN instance_depth + 1 > 10000 THEN 'instance' END AS reject_scope FROM dd CROSS JOIN i""",
    "schedule_resolve": f"""SELECT event_id AS id, CASE WHEN available_at > {E} + INTERVAL 86400 SECOND THEN NULL ELSE coalesce(available_at, {E}) END AS available_at,
  CASE WHEN available_at > {E} + INTERVAL 86400 SECOND THEN 'rejected' WHEN available_at > {E} THEN 'delayed' ELSE 'immediate' END AS schedule FROM fx_delivery""",
    "queue_depth": DEPTH,
    "instance_depth": "SELECT count(*) AS depth FROM fx_tasks WHERE state_code <= 3",
    "drain_progress": f"SELECT q.queue_id, q.name, CAST(coalesce(delayed + ready + leased, 0) AS BIGINT) AS remaining, state_code = 3 AS draining, state_code = 3 AND coalesce(delayed + ready + leased, 0) = 0 AS complete FROM fx_queues q LEFT JOIN ({DEPTH}) d ON d.queue_id = q.queue_id",
    "queue_stats": f"""SELECT q.queue_id, q.name, coalesce(d.delayed, 0) AS delayed, coalesce(d.ready, 0) AS ready, coalesce(d.leased, 0) AS leased, o.task_id AS oldest_ready_id, CAST(greatest(0, {SEC.format(a="o.available_at", b=N)}) AS BIGINT) AS oldest_ready_age
FROM fx_queues q LEFT JOIN ({DEPTH}) d ON d.queue_id = q.queue_id LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY available_at, task_id) AS r FROM fx_tasks WHERE state_code = 2) o ON o.queue_id = q.queue_id AND o.r = 1""".replace("CAST(greatest(0,", "CASE WHEN o.task_id IS NOT NULL THEN CAST(greatest(0,").replace("AS oldest_ready_age", "END AS oldest_ready_age"),
    "stats_snapshot": f"""WITH s AS (SELECT q.queue_id, max(t.created_at) AS as_of FROM fx_queues q LEFT JOIN fx_tasks t ON t.queue_id = q.queue_id AND t.created_at <= {N} GROUP BY q.queue_id),
f AS (SELECT *, CASE WHEN as_of IS NULL THEN 'unavailable' WHEN {SEC.format(a="as_of", b=N)} BETWEEN 0 AND 21600 THEN 'fresh' ELSE 'stale' END AS freshness FROM s)
SELECT queue_id, as_of, freshness, (SELECT min(as_of) FROM f) AS snapshot_as_of, (SELECT max(freshness) FROM f) AS snapshot_freshness FROM f""",
    "gate_matrix": "SELECT queue_id, o.operation, CASE WHEN state_code = 3 AND o.operation = 'external_enqueue' THEN 'rejected' WHEN state_code = 2 AND o.operation = 'claim' THEN 'paused_empty' ELSE 'allowed' END AS outcome FROM fx_queues CROSS JOIN (VALUES ('external_enqueue'), ('internal_spawn'), ('claim'), ('lease_mutation'), ('cancel'), ('delivery_relay')) AS o(operation)",
    "config_cas": "SELECT queue_id, CASE WHEN config_version = 2 THEN 'applied' ELSE 'version_conflict' END AS result, CAST(CASE WHEN config_version = 2 THEN 2 ELSE state_code END AS INT) AS state_code, CASE WHEN config_version = 2 THEN 3 ELSE config_version END AS config_version FROM fx_queues",
    "next_policy_version": "SELECT queue_id, CAST(max(version) + 1 AS INT) AS next_version FROM fx_policies GROUP BY queue_id",
    "policy_valid": "SELECT policy_id, max_attempts >= 1 AS attempts_ok, retry_delay_seconds >= 0 AND retry_delay_seconds <= 43200 AS delay_ok, max_attempts >= 1 AND retry_delay_seconds >= 0 AND retry_delay_seconds <= 43200 AS valid FROM fx_policies",
    "catalog_missing": "SELECT name FROM (VALUES ('nation-1'), ('nation-3'), ('mail-out'), ('image-resize'), ('nation-24')) AS c(name) WHERE name NOT IN (SELECT name FROM fx_queues)",
    "delivery_claimable": f"SELECT event_id, available_at, state_code = 2 AS reclaimed, CAST(delivery_attempt + 1 AS INT) AS delivery_attempt FROM fx_delivery WHERE {DDUE} ORDER BY available_at, event_id LIMIT 100",
    "delivery_depth": "SELECT count(*) FILTER (WHERE state_code = 1) AS pending, count(*) FILTER (WHERE state_code = 2) AS publishing FROM fx_delivery",
    "delivery_lag": f"SELECT CAST(coalesce(greatest(0, {SEC.format(a='min(available_at)', b=E)}), 0) AS BIGINT) AS lag_seconds FROM fx_delivery WHERE state_code = 1",
    "delivery_outcome": "SELECT event_id, delivery_attempt, CAST(CASE WHEN failure_code IS NOT NULL OR delivery_attempt >= 50 THEN 11 ELSE 1 END AS INT) AS new_state FROM fx_delivery WHERE state_code = 2",
    "delivery_backoff": """SELECT event_id, CAST(CASE WHEN hint >= policy THEN hint ELSE policy END AS DOUBLE) AS delay_seconds, CASE WHEN hint >= policy THEN 'retry_after' ELSE 'policy' END AS source
FROM (SELECT event_id, least(pow(2.0, greatest(delivery_attempt - 1, 0)), 300.0) AS policy, CASE WHEN delivery_attempt % 3 = 0 THEN least(delivery_attempt * 2.0, 3600.0) END AS hint FROM fx_delivery) x""",
    "delivery_in_queue": "SELECT event_id, source_task_id, state_code FROM fx_delivery WHERE source_task_id IN (SELECT task_id FROM fx_tasks WHERE queue_id = 7)",
    "bridge_backoff": "SELECT event_id, CAST(least(0.5 * pow(2.0, greatest(delivery_attempt - 1, 0)), 60.0) AS DOUBLE) AS delay_seconds FROM fx_delivery",
    "client_backoff": "SELECT sample_id, round(CAST(greatest(least(0.05 * pow(2.0, sample_id % 8), 2.0), CASE WHEN sample_id % 5 = 0 THEN least((sample_id % 40) * 100 / 1000.0, 30.0) ELSE 0.0 END) AS DOUBLE), 6) AS delay_seconds FROM fx_latency",
    "bridge_alert": f"""SELECT event_type AS name, pending, CASE WHEN pending > 0 AND {SEC.format(a="oldest", b=E)} >= 300 AND (delivered = 0 OR retries > 0) THEN 'warning' ELSE 'none' END AS severity
FROM (SELECT event_type, count(*) FILTER (WHERE state_code = 1) AS pending, min(available_at) FILTER (WHERE state_code = 1) AS oldest, count(*) FILTER (WHERE state_code = 10) AS delivered, count(*) FILTER (WHERE delivery_attempt > 1) AS retries FROM fx_delivery GROUP BY event_type) x""",
    "outbox_claim_batch": f"SELECT event_type AS namespace, event_id AS row_id, available_at FROM fx_delivery WHERE {DDUE} ORDER BY available_at, event_type, event_id LIMIT 50",
    "capped_depth": "SELECT CAST(least(count(*), 500) AS BIGINT) AS depth, count(*) > 500 AS capped FROM fx_delivery WHERE state_code = 1",
    "oldest_pending": "SELECT min(available_at) AS oldest_pending FROM fx_delivery WHERE state_code = 1",
    "published_purge": f"SELECT event_id, terminal_at FROM fx_delivery WHERE state_code = 10 AND terminal_at < {E} - INTERVAL 10 DAY",
    "registry_purge": f"""WITH r AS (SELECT *, submitted_at + INTERVAL 10 DAY AS expires_at, row_number() OVER (ORDER BY submitted_at, submission_id) AS k FROM fx_submissions), g AS (SELECT * FROM r WHERE expires_at <= {E} AND k <= 1000)
SELECT (SELECT count(*) FROM g) AS deleted, min(expires_at) AS oldest_remaining, coalesce(bool_or(expires_at <= {E}), false) AS more_work FROM r WHERE submission_id NOT IN (SELECT submission_id FROM g)""",
    "registry_extend": """SELECT submission_id AS id, CASE WHEN b > expires_at THEN b ELSE expires_at END AS expires_at, b > expires_at AS extended FROM (
  SELECT submission_id, expires_at, greatest(least(expires_at + INTERVAL 20 DAY, submitted_at + INTERVAL 365 DAY), submitted_at + INTERVAL 30 DAY) AS b FROM (SELECT *, submitted_at + INTERVAL 1 DAY * (submission_id % 400) AS expires_at FROM fx_submissions) y) x""",
    "partition_days": "SELECT CAST(claimed_at AS DATE) AS day, count(*) AS rows, min(claimed_at) AS first_at, max(claimed_at) AS last_at FROM fx_attempts GROUP BY CAST(claimed_at AS DATE)",
    "missing_partitions": f"SELECT p.parent, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT parent FROM ({PARENTS}) z) p CROSS JOIN (SELECT DATE '1998-09-02' + CAST(i AS INT) AS day FROM range(0, 31) r(i)) d WHERE NOT EXISTS (SELECT 1 FROM ({PARENTS}) x WHERE x.parent = p.parent AND x.day = d.day)",
    "partition_headroom": HEADROOM,
    "partition_names": "SELECT DISTINCT CAST(claimed_at AS DATE) AS day, 'task_attempts_' || strftime(claimed_at, '%Y%m%d') AS child, CAST(claimed_at AS DATE) AS parsed_day FROM fx_attempts",
    "retention_plan": f"""SELECT parent, day, rows, CASE WHEN day + INTERVAL 1 DAY + INTERVAL 90 DAY <= {N} THEN 'drop' ELSE 'keep' END AS action FROM (
  SELECT 'task_attempts' AS parent, CAST(claimed_at AS DATE) AS day, count(*) AS rows FROM fx_attempts GROUP BY CAST(claimed_at AS DATE)
  UNION ALL SELECT 'tasks_terminal', CAST(terminal_at AS DATE), count(*) FROM fx_tasks WHERE terminal_at IS NOT NULL GROUP BY CAST(terminal_at AS DATE)) x""",
    "retention_window": """SELECT w.window, w.policy_days, CASE WHEN w.partitioned THEN CAST(DATE '1998-09-02' - o.day AS INT) END AS oldest_age_days
FROM (VALUES ('task_terminal', 90, true), ('attempt', 90, true), ('admin_audit', 90, true), ('correctness_enqueue_dedup', 90, false), ('correctness_complete_replay', 7, false), ('correctness_admin_replay', 30, false), ('delivery_published', 30, true), ('delivery_dead_letter', 90, true)) AS w("window", policy_days, partitioned)
LEFT JOIN (SELECT 'attempt' AS "window", CAST(min(claimed_at) AS DATE) AS day FROM fx_attempts UNION ALL SELECT 'task_terminal', CAST(min(terminal_at) AS DATE) FROM fx_tasks) o ON o."window" = w."window" """,
    "retention_alerts": f"""WITH h AS ({HEADROOM}) SELECT CASE WHEN remaining <= 0 THEN 'premake_headroom_exhausted' ELSE 'premake_headroom_low' END AS kind, CASE WHEN remaining <= 0 THEN 'critical' ELSE 'warning' END AS severity FROM h WHERE worst AND remaining <= 3
UNION ALL SELECT 'sustained_maintenance_failure', 'critical' UNION ALL SELECT 'stats_stale', 'warning'""",
    "maintenance_status": f"SELECT 1 AS singleton, 'succeeded' AS outcome, {N} AS started_at, {N} + INTERVAL 60 SECOND AS finished_at, 0 AS consecutive_failures",
    "op_stats": f"""SELECT operation, scenario, count(*) AS samples, count(*) FILTER (WHERE {VALID}) AS valid_attempts, count(*) FILTER (WHERE outcome IN ('success', 'empty')) AS successes, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'planned_pause') AS planned_pause, count(*) FILTER (WHERE outcome = 'planned_drain') AS planned_drain, count(*) FILTER (WHERE outcome = 'invalid_request') AS invalid_requests,
  round(count(*) FILTER (WHERE outcome IN ('success', 'empty')) / nullif(count(*) FILTER (WHERE {VALID}), 0)::DOUBLE, 6) AS success_ratio FROM fx_latency GROUP BY operation, scenario""",
    "op_percentiles": f"SELECT operation, scenario, CAST(quantile_disc(latency_ns, 0.5) AS BIGINT) AS p50_ns, CAST(quantile_disc(latency_ns, 0.99) AS BIGINT) AS p99_ns FROM fx_latency WHERE {VALID} GROUP BY operation, scenario",
    "qualification": f"""SELECT *, CASE WHEN claims_per_second >= 500 AND success_ratio >= 0.999 AND enqueue_p99_ns <= 100000000 AND claim_p99_ns <= 100000000 AND heartbeat_p99_ns <= 100000000 AND complete_p99_ns <= 200000000 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT round(count(*) FILTER (WHERE operation = 'claim' AND outcome = 'success') / 30.0::DOUBLE, 6) AS claims_per_second, round(count(*) FILTER (WHERE outcome IN ('success', 'empty')) / count(*) FILTER (WHERE {VALID})::DOUBLE, 6) AS success_ratio,
    {P99.format(o="enqueue")} AS enqueue_p99_ns, {P99.format(o="claim")} AS claim_p99_ns, {P99.format(o="heartbeat")} AS heartbeat_p99_ns, {P99.format(o="complete")} AS complete_p99_ns FROM fx_latency) x""",
    "latency_histogram": """SELECT o.operation, b.le, count(s.latency_ns) AS n FROM (SELECT DISTINCT operation FROM fx_latency) o CROSS JOIN (VALUES ('0.005', 0.005), ('0.010', 0.01), ('0.025', 0.025), ('0.050', 0.05), ('0.100', 0.1), ('0.200', 0.2), ('0.500', 0.5), ('1.000', 1.0), ('2.500', 2.5), ('5.000', 5.0), ('+Inf', 1e300)) AS b(le, v)
LEFT JOIN fx_latency s ON s.operation = o.operation AND s.latency_ns / 1e9 <= b.v GROUP BY o.operation, b.le""",
    "metric_series": "SELECT operation, outcome, count(*) AS counter, CAST(sum(latency_ns) AS BIGINT) AS sum_ns, arg_max(latency_ns, (ts, sample_id)) AS gauge_ns FROM fx_latency GROUP BY operation, outcome",
    "error_ratio": "SELECT operation, errors, total, CASE WHEN total > 0 THEN round(errors / total::DOUBLE, 6) ELSE 0.0 END AS error_ratio FROM (SELECT operation, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome IN ('success', 'error')) AS total FROM fx_latency GROUP BY operation) x",
    "longpoll_error_ratio": "SELECT count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS total, round(count(*) FILTER (WHERE outcome = 'error') / count(*)::DOUBLE, 6) AS error_ratio FROM fx_latency WHERE operation = 'claim'",
    "select_candidate": f"""WITH c AS (SELECT operation || '/' || scenario AS candidate_id, count(*) * 1024 AS bytes, CAST(quantile_disc(latency_ns, 0.99) FILTER (WHERE {VALID}) AS BIGINT) AS p99_ns, count(*) AS wal_bytes, count(*) FILTER (WHERE outcome IN ('success', 'empty')) / nullif(count(*) FILTER (WHERE {VALID}), 0)::DOUBLE AS success_ratio FROM fx_latency GROUP BY operation, scenario),
r AS (SELECT *, concat_ws(',', CASE WHEN success_ratio IS NULL OR success_ratio < 0.5 THEN 'success_ratio' END, CASE WHEN p99_ns IS NULL OR p99_ns > 400000000 THEN 'claim_p99' END) AS reasons FROM c)
SELECT candidate_id, reasons, coalesce(candidate_id = (SELECT candidate_id FROM r WHERE reasons = '' ORDER BY bytes, p99_ns, wal_bytes, candidate_id LIMIT 1), false) AS selected FROM r""",
    "workload_matrix": "SELECT payload_bytes, queues, operation, scenario, CAST(row_number() OVER (ORDER BY payload_bytes, queues, operation, scenario) AS INT) AS cell FROM (VALUES (1024), (262144), (1048576)) AS a(payload_bytes) CROSS JOIN (VALUES (1), (10), (100)) AS b(queues) CROSS JOIN (VALUES ('cancel'), ('claim'), ('complete'), ('enqueue'), ('fail'), ('heartbeat')) AS c(operation) CROSS JOIN (VALUES ('due'), ('future'), ('reclaim')) AS d(scenario)",
    "pressure_status": """SELECT observed_at, s(wal) AS wal_status, s(disk) AS disk_status, s(autovacuum) AS autovacuum_status, CASE greatest(f, w) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS pool_status, CASE WHEN greatest(f, w) = 0 THEN 'within_budget' WHEN f >= w THEN 'pool_saturation' ELSE 'pool_wait' END AS pool_reason
FROM (SELECT *, CASE WHEN pool_saturation >= 0.9 THEN 2 WHEN pool_saturation >= 0.7 THEN 1 ELSE 0 END AS f, CASE WHEN pool_wait_seconds >= 0.2 THEN 2 WHEN pool_wait_seconds >= 0.05 THEN 1 ELSE 0 END AS w FROM fx_pressure) x""".replace("s(wal)", "CASE WHEN wal IS NULL THEN 'unavailable' WHEN wal >= 0.9 THEN 'critical' WHEN wal >= 0.7 THEN 'warning' ELSE 'ok' END").replace("s(disk)", "CASE WHEN disk IS NULL THEN 'unavailable' WHEN disk >= 0.9 THEN 'critical' WHEN disk >= 0.7 THEN 'warning' ELSE 'ok' END").replace("s(autovacuum)", "CASE WHEN autovacuum IS NULL THEN 'unavailable' WHEN autovacuum >= 0.9 THEN 'critical' WHEN autovacuum >= 0.7 THEN 'warning' ELSE 'ok' END"),
    "peak_pressure": """SELECT observed_at, round(coalesce(p, 1.0), 6) AS peak, p IS NULL AS clear_blocked FROM (SELECT observed_at, greatest(wal, disk, autovacuum, pool_saturation,
  CASE WHEN pool_wait_seconds IS NULL THEN NULL WHEN pool_wait_seconds >= 0.2 THEN 0.95 WHEN pool_wait_seconds >= 0.05 THEN 0.7 + (pool_wait_seconds - 0.05) / 0.15 * 0.2 WHEN pool_wait_seconds >= 0.03 THEN 0.55 ELSE 0.2 END)::DOUBLE AS p FROM fx_pressure) x""",
    "payload_size": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, strlen(text) > 8192 AS over_soft, strlen(text) > 16384 AS over_hard FROM documents",
    "content_hash": "SELECT sha256(text) AS fingerprint, min(doc_id) AS first_doc_id, count(*) AS copies, substr(sha256(text), 1, 16) AS reference FROM documents GROUP BY sha256(text)",
    "redact_diag": "SELECT event_id, CASE WHEN length(event_type) > 5 THEN substr(event_type, 1, 5) || '...' ELSE event_type END AS event_type, value, '[REDACTED]' AS props FROM events",
    "event_valid": "SELECT page_id AS id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$') AS source_ok, length(split_part(url, ':', 1)) > 0 AS type_ok FROM pages",
    "name_valid": """SELECT source, name, length(name) BETWEEN 1 AND 128 AND regexp_matches(name, '\\A[a-z0-9][a-z0-9._-]*\\z') AS valid, length(name) BETWEEN 1 AND 128 AND regexp_matches(lower(name), '\\A[a-z0-9][a-z0-9._-]*\\z') AS lower_valid
FROM (SELECT 'nation' AS source, n_name AS name FROM nation UNION ALL SELECT 'customer', c_name FROM customer) x""",
    "bound_code": "SELECT task_id, CASE WHEN regexp_replace(trim(failure_code), '[^A-Za-z0-9_-]', '_', 'g') = '' THEN 'maintenance_failed' ELSE substr(regexp_replace(trim(failure_code), '[^A-Za-z0-9_-]', '_', 'g'), 1, 128) END AS code FROM fx_tasks WHERE failure_code IS NOT NULL",
    "inv_report": """SELECT 'claim_fields' AS invariant, count(*) FILTER (WHERE (claimed_at IS NULL) <> (lease_expires_at IS NULL) OR (claimed_at IS NULL) <> (worker_id IS NULL)) AS violations FROM fx_tasks
UNION ALL SELECT 'lineage_pair', count(*) FILTER (WHERE (source_task_id IS NULL) <> (spawn_ordinal IS NULL)) FROM fx_tasks
UNION ALL SELECT 'leased_has_claim', count(*) FILTER (WHERE state_code = 3 AND claimed_at IS NULL) FROM fx_tasks
UNION ALL SELECT 'priority_range', count(*) FILTER (WHERE priority < -32768 OR priority > 32767) FROM fx_tasks
UNION ALL SELECT 'terminal_time', count(*) FILTER (WHERE (state_code >= 10) <> (terminal_at IS NOT NULL)) FROM fx_tasks
UNION ALL SELECT 'attempt_ends_after_claim', count(*) FILTER (WHERE ended_at < claimed_at) FROM fx_attempts
UNION ALL SELECT 'active_has_no_end', count(*) FILTER (WHERE (outcome_code = 1) <> (ended_at IS NULL)) FROM fx_attempts""",
    "inv_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "inv_due_gating": f"SELECT queue_id, count(*) FILTER (WHERE {DUE}) AS due, count(*) FILTER (WHERE state_code <= 2 AND NOT {DUE}) AS future FROM fx_tasks WHERE state_code <= 3 GROUP BY queue_id HAVING count(*) FILTER (WHERE {DUE}) > 0",
    "inv_claim_ordering": f"SELECT count(*) AS violations FROM ({HEAD}) h WHERE h.priority <> (SELECT max(t.priority) FROM fx_tasks t WHERE t.queue_id = h.queue_id AND {DUE.replace('state_code', 't.state_code').replace('available_at', 't.available_at').replace('lease_expires_at', 't.lease_expires_at')})",
}
