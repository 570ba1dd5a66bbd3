"""Domain tables derived from the driver's star-schema tables. The same SQL runs in Spark and in the checking database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Store time of order-derived and of event-derived tables.
N, E = "1998-09-02 00:00:00", "2024-01-20 00:00:00"

SQL = {
    "fx_queues": """
SELECT CAST(n_nationkey AS BIGINT) AS queue_id,
       lower(replace(n_name, '_', '-')) AS name,
       CAST(1 + n_nationkey % 3 AS INT) AS state_code,
       CAST(1 + n_nationkey % 4 AS BIGINT) AS config_version,
       CAST(n_nationkey * 10 + 2 AS BIGINT) AS active_policy_id
FROM {nation}""",
    "fx_policies": """
SELECT CAST(n_nationkey * 10 + v AS BIGINT) AS policy_id,
       CAST(n_nationkey AS BIGINT) AS queue_id,
       CAST(v AS INT) AS version,
       n_nationkey % 5 <> 0 AS enabled,
       CAST(2 + (n_nationkey + v) % 4 AS INT) AS max_attempts,
       CAST(CASE WHEN n_nationkey % 4 = 1 THEN 0 ELSE (n_nationkey * 3600 * v) % 86401 END AS INT) AS retry_delay_seconds
FROM {nation} CROSS JOIN (VALUES (1), (2)) AS t(v)""",
    "fx_tasks": """
SELECT o_orderkey AS task_id,
       CAST(c_nationkey AS BIGINT) AS queue_id,
       c_mktsegment AS producer_id,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 3
                 WHEN o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-09-02 00:00:00' THEN 1
                 WHEN o_orderstatus = 'O' THEN 2
                 ELSE 10 + o_orderkey % 3 END AS INT) AS state_code,
       5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
       o_orderdate AS available_at,
       CAST(c_nationkey * 10 + 1 + o_orderkey % 2 AS BIGINT) AS policy_id,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS claimed_at,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '1' HOUR * (1 + o_orderkey % 48) END AS lease_expires_at,
       CASE WHEN o_orderstatus = 'P' THEN concat('w', CAST(o_orderkey % 32 AS STRING)) END AS worker_id,
       o_orderstatus = 'P' AND o_orderkey % 11 = 0 AS cancel_requested,
       CASE WHEN o_orderkey % 7 IN (3, 4, 5) THEN CAST((o_orderkey - o_orderkey % 7) / 7 AS BIGINT) END AS source_task_id,
       CASE WHEN o_orderkey % 7 IN (3, 4, 5) THEN CAST(o_orderkey % 7 - 3 AS INT) END AS spawn_ordinal,
       CAST(1 + floor(o_totalprice) AS BIGINT) AS payload_bytes,
       o_orderdate - INTERVAL '1' HOUR * (o_orderkey % 24) AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * (o_orderkey % 60) END AS terminal_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1
            THEN CASE WHEN o_orderkey % 4 = 0 THEN 'lease.expired' WHEN o_orderkey % 4 = 1 THEN 'handler.timeout' ELSE 'handler.error' END
            END AS failure_code
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fx_attempts": """
SELECT l_orderkey * 1000 + generation AS attempt_id,
       l_orderkey AS task_id,
       CAST(generation AS INT) AS generation,
       l_shipdate AS claimed_at,
       concat('w', CAST(l_suppkey AS STRING)) AS worker_id,
       l_shipdate + INTERVAL '1' HOUR * (1 + l_linenumber) AS lease_expires_at,
       CASE WHEN outcome_code <> 1 THEN l_shipdate + INTERVAL '1' MINUTE * CAST(floor(l_quantity) AS INT) END AS ended_at,
       outcome_code,
       CASE WHEN outcome_code IN (3, 4) THEN CASE WHEN l_suppkey % 3 = 0 THEN 'handler.timeout' ELSE 'handler.error' END
            WHEN outcome_code = 5 THEN 'lease.expired' END AS failure_code
FROM (SELECT *,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS generation,
             CAST(CASE WHEN l_linestatus = 'O' AND l_discount = 0.0 THEN 1 WHEN l_returnflag = 'N' THEN 2
                       WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'F' THEN 4 ELSE 5 END AS INT) AS outcome_code
      FROM {lineitem}) AS x""",
    "fx_delivery": """
SELECT event_id, user_id AS source_task_id,
       CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 11 ELSE 10 END AS INT) AS state_code,
       ts AS available_at,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS delivery_attempt,
       CASE WHEN event_type = 'view' THEN ts + INTERVAL '1' HOUR * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS lease_expires_at,
       CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN ts END AS terminal_at,
       CASE WHEN event_type = 'error' THEN 'delivery.permanent' END AS failure_code,
       props AS envelope, event_type
FROM {events}""",
    "fx_latency": """
SELECT event_id AS sample_id,
       CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'enqueue' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'heartbeat' ELSE 'complete' END AS operation,
       CASE WHEN event_type = 'purchase' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 20 THEN 'max_fanout' ELSE 'baseline' END AS scenario,
       CAST(floor(value * 1000000) AS BIGINT) AS latency_ns,
       CASE WHEN event_id % 20 = 0 THEN 'planned_pause' WHEN event_id % 20 = 1 THEN 'planned_drain' WHEN event_id % 20 = 2 THEN 'invalid_request'
            WHEN event_id % 20 = 3 THEN 'error' WHEN event_id % 20 IN (4, 5) THEN 'empty' ELSE 'success' END AS outcome,
       ts
FROM {events}""",
    "fx_submissions": """
SELECT event_id AS submission_id, ts AS submitted_at, CAST(user_id AS STRING) AS producer_id, event_type AS queue_name,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 AS idem_key,
       CAST(floor(value) AS BIGINT) % 2 AS fingerprint
FROM {events}""",
    "fx_pressure": """
SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS observed_at,
       max(CASE WHEN event_type = 'click' THEN least(value / 300.0, 1.0) END) AS wal,
       max(CASE WHEN event_type = 'view' THEN least(value / 300.0, 1.0) END) AS disk,
       max(CASE WHEN event_type = 'error' THEN least(value / 300.0, 1.0) END) AS autovacuum,
       max(CASE WHEN event_type = 'purchase' THEN least(value / 300.0, 1.0) END) AS pool_saturation,
       max(CASE WHEN event_type = 'signup' THEN value / 1000.0 END) AS pool_wait_seconds
FROM {events} GROUP BY CAST(date_trunc('hour', ts) AS {ntz})""",
}
TABLES = ("nation", "customer", "orders", "lineitem", "events", "documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's own."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name].replace("{ntz}", "TIMESTAMP_NTZ"), **used)


def oracle(query: str) -> str:
    """query with the derived tables that it names put before it, as one statement for the checking database."""
    used = [n for n in SQL if n in query]
    parts = [f"{n} AS ({SQL[n].format(ntz='TIMESTAMP', **{t: t for t in TABLES})}\n)" for n in used]
    body = query.strip()
    if parts:
        recursive = body.upper().startswith("WITH RECURSIVE")
        if body.upper().startswith("WITH"):
            body = ", " + body[len("WITH RECURSIVE") if recursive else len("WITH") :].lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{body}"
    return body
