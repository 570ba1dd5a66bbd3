import pytest
from pyspark.sql import functions as F

from tideline.functions.clock import at, plus_seconds
from tideline.operators import control
from tideline.streaming import webhook

NOW = "2024-01-01 00:00:00"


def test_filters():
    assert control.checked_filters({"queue": "a", "code": ""}, frozenset({"queue", "code"})) == {"queue": "a"}
    for bad in ({"payload": "x"}, {"other": 1}, {"queue": "x" * 129}):
        with pytest.raises(control.FilterError):
            control.checked_filters(bad, frozenset({"queue"}))


def test_visibility(spark):
    rows = spark.createDataFrame([(1,), (2,)], "queue_id int")
    grants = spark.createDataFrame([("a", 1), ("root", None), ("a", 1)], "principal string, queue_id int")
    assert [r.queue_id for r in control.visible(rows, grants, "a").collect()] == [1]
    assert control.visible(rows, grants, "root").count() == 2
    assert control.visible(rows, grants, "nobody").isEmpty()


def test_spawn_and_events(spark):
    schema = "task_id long, spawn array<struct<queue_id: int, priority: int, payload: string>>, events array<string>"
    rows = spark.createDataFrame([(1, [(5, 0, "{}"), (6, 1, "{}")], ["e"]), (2, [(1, 0, "x" * 600_000)], []), (3, [(1, 0, "{}")] * 65, None)], schema)
    assert [(r.source_task_id, r.spawn_ordinal, r.queue_id) for r in control.spawned(rows, NOW).orderBy("spawn_ordinal").collect()] == [(1, 0, 5), (1, 1, 6)]
    assert [(r.source_task_id, r.ordinal) for r in control.emitted(rows, NOW).collect()] == [(1, 0)]


def test_replay_of_dead_letters(spark):
    tasks = spark.createDataFrame([(1, 11, None, None), (2, 10, None, None), (3, 2, 1, 4)], "task_id long, state_code int, source_task_id long, spawn_ordinal int").select("*", F.lit(7).alias("queue_id"), F.lit(0).alias("priority"), F.lit(1).alias("policy_id"))
    got = control.replayed(tasks, spark.createDataFrame([(1,), (2,)], "task_id long"), NOW).collect()
    assert [(r.source_task_id, r.spawn_ordinal) for r in got] == [(1, 5)]


def test_elevations(spark):
    rows = spark.createDataFrame([(1, 2.0, -10, 10), (1, 3.0, -5, 1), (1, 9.0, -20, 0), (2, 4.0, 1, 5)], "queue_id int, factor double, g int, e int")
    rows = rows.select("queue_id", "factor", plus_seconds(at(NOW), F.col("g")).alias("granted_at"), plus_seconds(at(NOW), F.col("e")).alias("expires_at"))
    assert [(r.queue_id, r.factor) for r in control.elevation_factor(rows, NOW).collect()] == [(1, 3.0)]


def test_drift_and_force(spark):
    schema = "queue_id int, delayed long, ready long, leased long"
    got = control.counter_drift(spark.createDataFrame([(1, 1, 1, 1), (2, 0, 3, 0), (3, 1, 0, 0)], schema), spark.createDataFrame([(1, 1, 1, 1), (2, 0, 2, 0)], schema)).collect()
    assert {(r.queue_id, r.delayed_diff, r.ready_diff) for r in got} == {(2, 0, -1), (3, -1, 0)}
    tasks = spark.createDataFrame([(1, 3), (2, 3), (3, 2)], "task_id long, state_code int").withColumn("lease_expires_at", plus_seconds(at(NOW), 60))
    out = control.force_expired(tasks, spark.createDataFrame([(1,), (3,)], "task_id long"), NOW)
    assert [r.task_id for r in out.where(F.col("lease_expires_at") <= at(NOW)).collect()] == [1]


def test_terminal_replay(spark):
    done = spark.createDataFrame([("c", "complete", "f", 5), ("d", "complete", "f", -5)], "claim_id string, operation string, fingerprint string, s int").select("claim_id", "operation", "fingerprint", plus_seconds(at(NOW), F.col("s")).alias("expires_at"))
    asked = spark.createDataFrame([("c", "complete", "f"), ("c", "fail", "f"), ("d", "complete", "g")], "claim_id string, operation string, fingerprint string")
    got = {(r.claim_id, r.operation): r.outcome for r in control.terminal_replay(asked, done, NOW).collect()}
    assert got == {("c", "complete"): "replay", ("c", "fail"): "fresh", ("d", "complete"): "fresh"}


def test_webhook_classes(spark):
    rows = spark.createDataFrame([(200, "a"), (503, "b"), (404, "c"), (0, "d"), (1, "x" * 50)], "event_id long, envelope string")
    codes = {b"a": 200, b"b": 503, b"c": 404, b"d": 0}
    got = webhook.delivered(rows, "http://unused", 2, largest=40, send=lambda url, body, timeout: codes[body])
    assert {r.event_id: r["class"] for r in got.collect()} == {200: "ack", 503: "retry", 404: "permanent", 0: "retry", 1: "permanent"}
