"""Decision tables and boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import decisions as d
from tideline.functions import text
from tideline.functions.clock import at, plus_seconds, seconds_between
from tideline.operators import delivery, queues, tasks, upkeep

NOW = "2024-01-01 00:00:00"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_boundaries_of_claimable(spark):
    rows = spark.createDataFrame([(1, 1, 0, None), (2, 2, 1, None), (3, 3, 0, 0), (4, 3, 0, 1), (5, 10, 0, 0)], "id int, state_code int, a int, l int")
    rows = rows.withColumn("available_at", plus_seconds(at(NOW), F.col("a"))).withColumn("lease_expires_at", plus_seconds(at(NOW), F.col("l")))
    assert [r.id for r in rows.where(d.claimable(at(NOW))).orderBy("id").collect()] == [1, 3]


@pytest.mark.parametrize(("enabled", "most", "done", "goes_on"), [(True, 3, 2, True), (True, 3, 3, False), (False, 3, 1, False), (True, 1, 1, False)])
def test_retries(spark, enabled, most, done, goes_on):
    r = spark.createDataFrame([(enabled, most)], "enabled boolean, max_attempts int").select(d.retries_left(F.lit(done)).alias("go"), d.exhausted_reason().alias("why")).first()
    assert r.go == goes_on
    assert r.why == ("attempts_exhausted" if enabled else "retry_disabled")


def test_gate_has_two_closed_cells(spark):
    q = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "queue_id int, state_code int")
    got = {(r.queue_id, r.operation): r.outcome for r in queues.gate_matrix(q).collect()}
    assert len(got) == 18
    assert {k: v for k, v in got.items() if v != "allowed"} == {(3, "external_enqueue"): "rejected", (2, "claim"): "paused_empty"}


@pytest.mark.parametrize(("age", "want"), [(-1, "stale"), (0, "fresh"), (30, "fresh"), (31, "stale"), (None, "unavailable")])
def test_freshness(spark, age, want):
    assert one(spark, x=d.freshness(F.lit(age).cast("long"), 30)).x == want


@pytest.mark.parametrize(("wait", "want"), [(0.0, 0.2), (0.03, 0.55), (0.05, 0.7), (0.125, 0.8), (0.2, 0.95), (9.0, 0.95)])
def test_wait_as_ratio(spark, wait, want):
    assert one(spark, x=d.wait_as_ratio(F.lit(wait))).x == pytest.approx(want)


@pytest.mark.parametrize(("hint", "want"), [(None, None), (-1.0, None), (float("nan"), None), (float("inf"), None), (5.0, 5.0), (99.0, 10.0)])
def test_capped_hint(spark, hint, want):
    assert one(spark, x=d.capped_hint(F.lit(hint).cast("double"), 10.0)).x == want


def test_backoff_does_not_overflow(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 10_000, None), (3, 2, 4.0), (4, 2, 1.0)], "event_id long, delivery_attempt int, hint double")
    got = {r.event_id: (r.delay_seconds, r.source) for r in delivery.delivery_backoff(rows, 1.0, 300.0, 3600.0).collect()}
    assert got == {1: (1.0, "policy"), 2: (300.0, "policy"), 3: (4.0, "retry_after"), 4: (2.0, "policy")}


@pytest.mark.parametrize(("status", "want"), [(200, "ack"), (204, "ack"), (302, "permanent"), (404, "permanent"), (408, "retry"), (425, "retry"), (429, "retry"), (500, "retry"), (503, "retry")])
def test_http_class(spark, status, want):
    assert one(spark, x=d.http_class(F.lit(status))).x == want


def test_names_and_codes(spark):
    names = {"a": True, "a.b-c_1": True, "A": False, "": False, "-a": False, "a" * 128: True, "a" * 129: False, "a\n": False, "a\nb": False}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", d.valid_name(F.col("name")).alias("ok")).collect()
    assert {r.name: r.ok for r in got} == names
    codes = {"lease.expired": "lease_expired", "  ": "maintenance_failed", "x" * 200: "x" * 128, "é-1": "é-1"}
    got = spark.createDataFrame([(n,) for n in codes], "c string").select("c", d.bounded_code(F.col("c")).alias("b")).collect()
    assert {r.c: r.b for r in got} == codes


def test_audit_labels(spark):
    got = spark.range(1, 16).select(d.audit_label(F.col("id").cast("int")).alias("x")).collect()
    assert [got[0].x, got[7].x, got[8].x, got[14].x] == ["create_queue", "bulk_cancel", "operation_9", "operation_15"]


def test_seconds_between_rounds_down(spark):
    t = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:01.9'")
    assert one(spark, x=seconds_between(at(NOW), t)).x == 1


def test_schedule(spark):
    rows = spark.createDataFrame([(1, None), (2, -5), (3, 10), (4, 86_400), (5, 86_401)], "id int, s int").withColumn("requested_at", plus_seconds(at(NOW), F.col("s")))
    resolved = queues.schedule_resolve(rows, NOW, 86_400).join(rows.select("id", "s"), "id").collect()
    assert {r.id: r.schedule for r in resolved} == {1: "immediate", 2: "immediate", 3: "delayed", 4: "delayed", 5: "rejected"}
    now = {r.id: r.available_at for r in resolved}
    assert {k: None if v is None else (v - now[1]).total_seconds() for k, v in now.items()} == {1: 0, 2: -5, 3: 10, 4: 86_400, 5: None}


def test_queue_without_tasks_has_zeros(spark):
    rows = spark.createDataFrame([(1, "busy"), (2, "idle")], "queue_id long, name string")
    tasks = spark.createDataFrame([(7, 1, 2)], "task_id long, queue_id long, state_code int").withColumn("available_at", plus_seconds(at(NOW), F.lit(-9)))
    got = {r.name: tuple(r)[2:] for r in queues.queue_stats(rows, tasks, NOW).collect()}
    assert got == {"busy": (0, 1, 0, 7, 9), "idle": (0, 0, 0, None, None)}


def test_registry_extension_is_clamped(spark):
    rows = spark.createDataFrame([(1, 0, 10), (2, 0, 100), (3, 0, 365)], "id int, c int, e int").select("id", at(NOW).alias("created_at"), plus_seconds(at(NOW), F.col("e") * 86_400).alias("expires_at"))
    got = {r.id: ((r.expires_at - dt.datetime(2024, 1, 1)).days, r.extended) for r in queues.registry_extend(rows, 5 * 86_400).collect()}
    assert got == {1: (30, True), 2: (105, True), 3: (365, False)}


def test_headroom_starts_today(spark):
    runs = {"a": [0, 1, 2], "b": [0, 1, 3], "c": [1, 2], "d": [-2, -1], "e": [0, *range(1, 41), 45], "f": [0]}
    rows = spark.createDataFrame([(p, k) for p, ks in runs.items() for k in [*ks, ks[0]]], "parent string, k int").select("parent", F.date_add(F.to_date(F.lit(NOW[:10])), F.col("k")).alias("day"))
    got = {r.parent: (r.through is None, r.remaining, r.interior_gap, r.worst) for r in upkeep.partition_headroom(rows, NOW[:10]).collect()}
    assert got == {"a": (False, 2, False, False), "b": (False, 1, True, True), "c": (True, -1, True, False), "d": (True, -1, False, False), "e": (False, 40, False, False), "f": (False, 0, False, False)}
    got = {r.parent: r.worst for r in upkeep.partition_headroom(rows.where("parent in ('a', 'd', 'f')"), NOW[:10]).collect()}
    assert got == {"a": False, "d": True, "f": False}


def test_retention_alerts(spark):
    def kinds(remaining, *run):
        rows = spark.createDataFrame([("a", remaining, True), ("b", 9, False)], "parent string, remaining int, worst boolean")
        return [tuple(r) for r in upkeep.retention_alerts(rows, *run).collect()]

    assert kinds(0, "succeeded", 0, False) == [("premake_headroom_exhausted", "critical")]
    assert kinds(3, "failed", 1, True) == [("premake_headroom_low", "warning"), ("stats_stale", "warning")]
    assert kinds(4, "failed", 2, False) == [("sustained_maintenance_failure", "critical")]
    assert kinds(4, "succeeded", 2, False) == []


def test_nearest_ranks(spark):
    import math
    import random

    random.seed(3)
    groups = {"a": [7], "b": [random.randrange(10**9) for _ in range(999)], "c": [5] * 40 + [6] * 60, "d": [0, 0, 1], "e": list(range(1, 101))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v long")
    got = {r.k: (r.p50, r.p99, r.all) for r in upkeep.nearest_ranks(rows, ["k"], "v", p50=500, p99=990, all=1000).collect()}
    rank = lambda vs, p: sorted(vs)[max(1, math.ceil(p * len(vs) / 1000)) - 1]
    assert got == {k: tuple(rank(vs, p) for p in (500, 990, 1000)) for k, vs in groups.items()}
    assert upkeep.nearest_ranks(rows.where("v is null"), ["k"], "v", p50=500).isEmpty()


def test_spawn_depth(spark):
    chain = [(k, k - 1 if k else None) for k in range(70)]
    # A star under 100, an unknown source, a source that is the task itself, and a cycle with a branch into it.
    more = [(100, None), *[(k, 100) for k in range(101, 110)], (200, 999), (201, 200), (300, 300), (301, 300), (400, 401), (401, 402), (402, 400), (403, 400), (500, None)]
    got = tasks.spawn_depth(spark.createDataFrame(chain + more, "task_id long, source_task_id long"))
    assert {r.root: (r.max_depth, r["size"]) for r in got.collect()} == {0: (69, 70), 100: (1, 10), 200: (1, 2), 300: (1, 2)}
    assert tasks.spawn_depth(spark.createDataFrame([], "task_id long, source_task_id long")).isEmpty()


def test_conservation_of_moves(spark):
    from tideline.sources import fixtures

    t = fixtures.load(spark, "/root/testdata/sf0.001", "fx_tasks")
    rest, moved = tasks.move_terminal(t, fixtures.N)
    assert rest.count() + moved.count() == t.where("state_code <= 3").count()
    assert rest.join(moved, "task_id").isEmpty()


def test_claims_are_distinct_and_later(spark):
    from tideline.sources import fixtures

    load = lambda n: fixtures.load(spark, "/root/testdata/sf0.001", n)
    got = tasks.claim_batch(load("fx_tasks"), load("fx_queues"), load("fx_policies"), load("fx_attempts"), fixtures.N, 3, 30)
    assert got.select("task_id").distinct().count() == got.count() > 0
    last = load("fx_attempts").groupBy("task_id").agg(F.max("generation").alias("g"))
    assert got.join(last, "task_id").where("generation <= g").isEmpty()


def test_top_k_is_limited_before_the_shuffle(spark):
    from tideline.sources import fixtures

    load = lambda n: fixtures.load(spark, "/root/testdata/sf0.001", n)
    plan = tasks.claim_head(load("fx_tasks"), load("fx_queues"), fixtures.N)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "PushedFilters" in plan
    assert "BroadcastHashJoin" in plan


def test_canonical_json():
    assert text.canonical('{"b": 1, "a": [1.5, "é", null]}') == '{"a":[1.5,"é",null],"b":1}'
    assert text.canonical("NaN") is None
    assert text.canonical("{") is None
    assert text.canonical(None) is None


def test_canonical_json_column(spark):
    rows = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a": 2, "b": 1}',), (None,)], "j string").select(text.fingerprint(F.col("j")).alias("f")).collect()
    assert rows[0].f == rows[1].f
    assert rows[2].f is None


def test_sanitiser(spark):
    allowed = frozenset({"ok", "deep", "token", "List"})
    clean = lambda v: text.sanitise(v, allowed)
    assert clean({"ok": "x" * 2049, "OK ": "x" * 2048, "other": 1}) == {"ok": "[TRUNCATED]", "OK ": "x" * 2048}
    # Secret keys are masked, allowed or not, and at any depth.
    assert clean({"token": 1, "My Password": {"ok": 1}, "deep": {"Set-Cookie": 2, "ok": None}}) == {"token": "[REDACTED]", "My Password": "[REDACTED]", "deep": {"Set-Cookie": "[REDACTED]", "ok": None}}
    assert clean({"list": list(range(65))}) == {"list": [*range(64), "[TRUNCATED]"]}
    assert clean(list(range(64))) == list(range(64))
    value, cut = 7, "[TRUNCATED]"
    for k in range(9):
        value, cut = {"deep": value}, cut if k == 0 else {"deep": cut}
    assert clean(value["deep"]) == value["deep"]
    assert clean(value) == {"deep": cut}
    rows = spark.createDataFrame([('{"ok": true, "no": 1}',), ("{broken",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.sanitised_json(F.col("t"), allowed)).collect()] == ['{"ok": true}', "[REDACTED]", None]


def test_cursors():
    key = b"k" * 32
    token = text.encode_cursor({"t": "2024", "id": 7}, key)
    assert text.decode_cursor(token, key) == {"t": "2024", "id": 7}
    for bad in (token[:-2] + "AA", "!", token + "x" * 600):
        with pytest.raises(ValueError):
            text.decode_cursor(bad, key)


def test_confirmations():
    key = b"k"
    token = text.confirmation("bulk_cancel", {"queue": 3}, 1000, key)
    assert text.confirmed(token, "bulk_cancel", {"queue": 3}, 1300, key)
    assert not text.confirmed(token, "bulk_cancel", {"queue": 3}, 1301, key)
    assert not text.confirmed(token, "bulk_cancel", {"queue": 4}, 1001, key)
