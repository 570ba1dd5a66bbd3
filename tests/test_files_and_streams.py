import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import files
from tideline.streaming import state

T0 = dt.datetime(2024, 1, 1)


def s(n):
    return T0 + dt.timedelta(seconds=n)


def catalog(*names, **changed):
    return {"schema_version": 1, "queues": [{"name": n, "initial_policy": {"enabled": True, "max_attempts": 3, "backoff_strategy": "fixed", "retry_delay_seconds": 5} | changed} for n in names]}


def test_catalog(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(catalog("a", "b"), indent=1))
    assert [r.name for r in files.read_catalog(spark, str(p)).orderBy("name").collect()] == ["a", "b"]
    for bad in ("{", json.dumps(catalog("a", "a")), json.dumps(catalog("a", extra=1)), json.dumps(catalog("a", max_attempts=True)), json.dumps({"queues": []}), json.dumps(catalog("a", backoff_strategy="other"))):
        p.write_text(bad)
        with pytest.raises(files.CatalogError):
            files.read_catalog(spark, str(p))


def test_latency_source(spark, tmp_path):
    p = tmp_path / "x.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write('{"operation":"claim","scenario":"baseline","latency_ns":5,"outcome":"success","fan_out":0}\n')
    assert files.read_latency(spark, str(p)).first().latency_ns == 5
    with gzip.open(p, "at") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):
        files.read_latency(spark, str(p)).collect()


def test_history_is_read_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(i, s(86_400 * i)) for i in range(5)], "id int, at timestamp")
    files.append_history(rows, str(tmp_path / "h"), "at")
    got = files.read_history(spark, str(tmp_path / "h"), "2024-01-02", "2024-01-03")
    assert sorted(r.id for r in got.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()
    assert files.history_days(spark, str(tmp_path / "h")).count() == 5


def test_generator_is_deterministic(spark):
    a, b = (files.generated(spark, 10, 100).collect() for _ in range(2))
    assert a == b
    assert len(a[0].payload) == 100
    assert files.round_robin(files.generated(spark, 10, 1), 3).groupBy("queue_id").count().count() == 3


def test_envelope(spark):
    rows = spark.createDataFrame([(1, "t", s(0), "{}")], "event_id long, type string, at timestamp, data string")
    e = json.loads(files.envelope(rows, "urn:x").first().envelope)
    assert e["id"] == "1"
    assert e["time"] == "2024-01-01T00:00:00.000000Z"


def stream(spark, tmp_path, f, schema, *batches):
    """Rows that f makes of a stream of files, restarted after each."""
    src, out, ck = tmp_path / "src", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = f(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(str(out)).collect()


SUBMISSION = "submission_id long, submitted_at timestamp, producer_id string, queue_name string, idem_key int, fingerprint long"


def test_outcomes_across_restarts(spark, tmp_path):
    one = [(1, s(0), "p", "q", 1, 7), (2, s(1), "p", "q", 1, 7)]
    two = [(3, s(2), "p", "q", 1, 8), (4, s(3), "p", "q", 2, 8)]
    three = [(5, s(1000), "p", "q", 1, 8)]
    got = stream(spark, tmp_path, lambda d: state.outcomes(d, 500), SUBMISSION, one, two, three)
    assert {r.submission_id: r.outcome for r in got} == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "new"}


def test_lease_timeouts(spark, tmp_path):
    schema = "task_id long, generation long, event_at timestamp, lease_expires_at timestamp"
    one = [(1, 1, s(0), s(10)), (2, 1, s(0), s(10)), (3, 1, s(0), s(10))]
    two = [(1, 1, s(5), s(60)), (2, 1, s(6), None)]
    got = stream(spark, tmp_path, state.lease_timeouts, schema, one, two, [(9, 1, s(30), s(900))], [(9, 1, s(31), s(900))])
    assert [(r.task_id, r.generation) for r in got] == [(3, 1)]


def test_delayed_visibility(spark, tmp_path):
    schema = "task_id long, event_at timestamp, available_at timestamp"
    got = stream(spark, tmp_path, state.delayed_visibility, schema, [(1, s(5), s(0)), (2, s(5), s(20))], [(3, s(30), s(90))], [(4, s(31), s(95))])
    assert {r.task_id for r in got} == {1, 2}


def test_overload_modes(spark, tmp_path):
    schema = "name string, at timestamp, peak double, blocked boolean"
    peaks = [0.8, 0.8, 0.95, 0.95, 0.6, 0.6, 0.4, 0.4]
    rows = [("x", s(i), p, False) for i, p in enumerate(peaks)]
    got = stream(spark, tmp_path, state.overload_modes, schema, rows[:3], rows[3:])
    assert [r.mode for r in sorted(got, key=lambda r: r["at"])] == ["normal", "warning", "warning", "enqueue_throttle", "enqueue_throttle", "enqueue_throttle", "warning", "warning"]


def test_next_mode():
    def modes(*samples):
        held, out = (0, 0, 0, -1.0), []
        for at, peak, blocked in samples:
            held = state.next_mode(held, at, peak, blocked)
            out.append(held[0])
        return out

    # A critical peak goes straight to throttling, and from there to a failure of readiness.
    assert modes((0, 0.9, False), (1, 0.9, False), (2, 1.0, False), (3, 1.0, False), (4, 1.0, False)) == [0, 2, 2, 3, 3]
    assert modes((0, 0.9, False), (1, 0.69, False), (2, 0.9, False), (3, 0.7, False)) == [0, 0, 0, 1]
    # Clearing counts after the hold, starts over at a high or blocked sample, and goes down by one step.
    up = [(0, 0.9, False), (0, 0.9, False)]
    assert modes(*up, (1, 0.1, False), (1.9, 0.1, False), (2, 0.1, False), (2.1, 0.1, False)) == [0, 2, 2, 2, 2, 1]
    assert modes(*up, (1, 0.1, False), (2, 0.1, False), (3, 0.1, True), (4, 0.1, False), (5, 0.1, False), (6, 0.1, False)) == [0, 2, 2, 2, 2, 2, 2, 1]
    assert modes(*up, (1, 0.1, False), (2, 0.1, False), (3, 0.75, False), (4, 0.1, False), (5, 0.1, False)) == [0, 2, 2, 2, 2, 2, 2]


def test_token_bucket(spark, tmp_path):
    schema = "name string, at timestamp, request_id long"
    got = stream(spark, tmp_path, lambda d: state.rate_limited(d, 1.0, 2.0), schema, [("x", s(0), 1), ("x", s(0), 2), ("x", s(0), 3)], [("x", s(1), 4), ("x", s(1), 5)])
    assert {r.request_id: r.allowed for r in got} == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_circuit_breaker(spark, tmp_path):
    held, out = ("closed", 0, 0, 0.0), []
    calls = [(0, False), (1, False), (2, True), (31, True), (32, False), (61, True), (62, True), (63, True), (64, False), (65, True), (66, False)]
    for at, ok in calls:
        held, verdict = state.next_circuit(held, at, ok, 2, 2, 30.0)
        out.append((verdict, held[0]))
    want = [("failed", "closed"), ("failed", "open"), ("rejected", "open"), ("passed", "half_open"), ("failed", "open"), ("rejected", "open"), ("passed", "half_open"), ("passed", "closed"), ("failed", "closed"), ("passed", "closed"), ("failed", "closed")]
    assert out == want
    rows = [("x", s(at), at, ok) for at, ok in calls]
    got = stream(spark, tmp_path, lambda d: state.circuit_breaker(d, 2, 2, 30.0), "name string, at timestamp, call_id long, ok boolean", rows[:4], rows[4:])
    assert [(r.verdict, r.state) for r in sorted(got, key=lambda r: r.call_id)] == want


def test_dedup_within_watermark(spark, tmp_path):
    got = stream(spark, tmp_path, lambda d: state.dedup(d, "1 hour").select("submission_id"), SUBMISSION, [(1, s(0), "p", "q", 1, 7)], [(2, s(9), "p", "q", 1, 7), (3, s(9), "p", "q", 3, 7)])
    assert sorted(r.submission_id for r in got) == [1, 3]


def test_relay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    sent = []
    q = state.relay(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, k: sent.extend(r.id for r in df.select(F.col("id")).collect()), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert sorted(sent) == [0, 1, 2]
