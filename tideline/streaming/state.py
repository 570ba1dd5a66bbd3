"""Streaming forms of what carries state over time.

All of them take event time from their input. State is kept for each key and is bounded: expired
entries are dropped, folds keep a few numbers. TIMESTAMP_NTZ can't carry a watermark, so times are
cast to TIMESTAMP; sessions should be in UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Thresholds that raise and clear the modes.
ENTER_WARN, ENTER_CRITICAL, CLEAR_WARN, CLEAR_CRITICAL, CLEAR_HOLD = 0.7, 0.9, 0.5, 0.7, 1.0
MODES = ("normal", "warning", "enqueue_throttle", "readiness_failure")


def dedup(submissions: DataFrame, keep: str) -> DataFrame:
    """The first submission of each scope within `keep` (such as '90 days') of event time."""
    timed = submissions.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark("submitted_at", keep)
    return timed.dropDuplicatesWithinWatermark(["producer_id", "queue_name", "idem_key"])


def outcomes(submissions: DataFrame, keep_seconds: int) -> DataFrame:
    """new, replay or conflict for each submission, against the first one of its scope; scopes are forgotten keep_seconds after it.

    In a micro-batch submissions of a scope go by time, then id.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["submitted_at", "submission_id"], kind="stable")
        first = state.getOption
        out = []
        for r in rows.itertuples():
            at = r.submitted_at.timestamp()
            if first is None or at >= first[1] + keep_seconds:
                first = (int(r.fingerprint), at)
                out.append("new")
            else:
                out.append("replay" if int(r.fingerprint) == first[0] else "conflict")
        state.update(first)
        expires = int((first[1] + keep_seconds) * 1000)
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        else:
            state.remove()
        yield pd.DataFrame({"submission_id": rows["submission_id"], "outcome": out})

    timed = submissions.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark("submitted_at", "0 seconds")
    return timed.groupBy("producer_id", "queue_name", "idem_key").applyInPandasWithState(fold, "submission_id bigint, outcome string", "fingerprint bigint, at double", "append", GroupStateTimeout.EventTimeTimeout)


def lease_timeouts(leases: DataFrame) -> DataFrame:
    """leases(task_id, generation, event_at, lease_expires_at; a null expiry ends the lease): tasks whose lease ran out, with the generation.

    A heartbeat is a later row of the same generation; older generations are ignored. Leases end when the watermark passes them.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            generation, expires = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "generation": [generation], "expired_at": [pd.Timestamp(expires, unit="ms")]})
            return
        held = state.getOption
        for r in pd.concat(list(frames)).sort_values(["event_at", "generation"], kind="stable").itertuples():
            if held is None or r.generation >= held[0]:
                held = (int(r.generation), -1 if pd.isna(r.lease_expires_at) else int(r.lease_expires_at.timestamp() * 1000))
        if held is None or held[1] < 0:
            # The generation stays known for as long as the state lives, so that late heartbeats do not revive the lease.
            state.update(held)
            return
        if held[1] <= state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "generation": [held[0]], "expired_at": [pd.Timestamp(held[1], unit="ms")]})
            return
        state.update(held)
        state.setTimeoutTimestamp(held[1])

    timed = leases.withColumn("event_at", F.col("event_at").cast("timestamp")).withColumn("lease_expires_at", F.col("lease_expires_at").cast("timestamp")).withWatermark("event_at", "0 seconds")
    return timed.groupBy("task_id").applyInPandasWithState(fold, "task_id bigint, generation bigint, expired_at timestamp", "generation bigint, expires bigint", "append", GroupStateTimeout.EventTimeTimeout)


def delayed_visibility(tasks: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """tasks(task_id, event_at, available_at) that the watermark has reached, each once."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
        else:
            due = int(max(f["available_at"].max() for f in frames).timestamp() * 1000)
            if due > state.getCurrentWatermarkMs():
                state.update((due,))
                state.setTimeoutTimestamp(due)
                return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "visible_at": [pd.Timestamp(due, unit="ms")]})

    timed = tasks.withColumn("event_at", F.col("event_at").cast("timestamp")).withColumn("available_at", F.col("available_at").cast("timestamp")).withWatermark("event_at", "0 seconds")
    return timed.groupBy("task_id").applyInPandasWithState(fold, "task_id bigint, visible_at timestamp", "due bigint", "append", GroupStateTimeout.EventTimeTimeout)


def next_mode(held: tuple[int, int, int, float], at: float, peak: float, blocked: bool, hold: float = CLEAR_HOLD) -> tuple[int, int, int, float]:
    """(mode, samples that raise it, samples that clear it, start of clearing or -1) after a sample.

    Two raising samples in a row set the mode that the last one calls for: a critical peak throttles from below, and fails
    readiness from there. Clearing starts at a sample under the mode's threshold; samples count once `hold` seconds have passed
    since, and two lower the mode by a step. Any other sample, or a blocked one, starts it over.
    """
    mode, raising, clearing, since = held
    called = (3 if mode >= 2 else 2) if peak >= ENTER_CRITICAL else 1 if peak >= ENTER_WARN else 0
    if called > mode:
        return (called, 0, 0, -1.0) if raising + 1 >= 2 else (mode, raising + 1, 0, -1.0)
    if mode == 0 or blocked or peak >= (CLEAR_WARN if mode == 1 else CLEAR_CRITICAL):
        return mode, 0, 0, -1.0
    if since < 0:
        return mode, 0, 0, at
    if at - since < hold:
        return mode, 0, clearing, since
    return (mode - 1, 0, 0, -1.0) if clearing + 1 >= 2 else (mode, 0, clearing + 1, since)


def take_tokens(tokens: float, last: float, at: float, rate: float, burst: float, cost: float = 1.0) -> tuple[bool, float]:
    """(let through, tokens left) of a bucket that refills at `rate` a second up to `burst`. Time does not run back."""
    tokens = min(burst, tokens + max(at - last, 0.0) * rate)
    return (True, tokens - cost) if tokens >= cost else (False, tokens)


Circuit = tuple[str, int, int, float]


def next_circuit(held: Circuit, at: float, ok: bool, failures: int, successes: int, cool_down: float) -> tuple[Circuit, str]:
    """The circuit (state, failures, successes, opened) after a call at a time that would end ok or not, and the verdict on the call.

    `failures` in a row open it. After cool_down it is half open: `successes` calls close it, and one failure opens it again.
    A call ends before the next one begins, so one probe at most is under way.
    """
    state, failed, passed, opened = held
    if state == "open" and at >= opened + cool_down:
        state, passed = "half_open", 0
    if state == "open":
        return (state, failed, passed, opened), "rejected"
    if ok:
        closes = state == "half_open" and passed + 1 >= successes
        return ("closed", 0, 0, opened) if closes or state == "closed" else (state, failed, passed + 1, opened), "passed"
    opens = state == "half_open" or failed + 1 >= failures
    return ("open", failures, 0, at) if opens else (state, failed + 1, 0, opened), "failed"


def _folded(rows: DataFrame, key: str, order: list[str], step: Callable[[tuple, object], tuple[tuple, tuple]], start: tuple, schema: str, state_schema: str, names: list[str]) -> DataFrame:
    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.getOption or start, []
        for r in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples():
            held, made = step(held, r)
            out.append((group[0], *made))
        state.update(held)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(fold, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def overload_modes(samples: DataFrame, hold: float = CLEAR_HOLD) -> DataFrame:
    """samples(name, at, peak, blocked): the mode after each sample."""

    def step(held: tuple, r) -> tuple[tuple, tuple]:
        held = next_mode(tuple(held), r.at.timestamp(), float(r.peak), bool(r.blocked), hold)
        return held, (r.at, MODES[held[0]])

    return _folded(samples, "name", ["at"], step, (0, 0, 0, -1.0), "name string, at timestamp, mode string", "mode int, raising int, clearing int, since double", ["name", "at", "mode"])


def rate_limited(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests(name, at, request_id): which are let through by a token bucket for each name."""

    def step(held: tuple, r) -> tuple[tuple, tuple]:
        at = r.at.timestamp()
        tokens, last = (burst, at) if held[1] < 0 else held
        ok, tokens = take_tokens(tokens, last, at, rate, burst)
        return (tokens, max(at, last)), (int(r.request_id), ok)

    return _folded(requests, "name", ["at", "request_id"], step, (burst, -1.0), "name string, request_id bigint, allowed boolean", "tokens double, last double", ["name", "request_id", "allowed"])


def circuit_breaker(calls: DataFrame, failures: int = 5, successes: int = 1, cool_down: float = 30.0) -> DataFrame:
    """calls(name, at, call_id, ok): the verdict on each call and the state after it."""

    def step(held: tuple, r) -> tuple[tuple, tuple]:
        held, verdict = next_circuit(tuple(held), r.at.timestamp(), bool(r.ok), failures, successes, cool_down)
        return held, (int(r.call_id), verdict, held[0])

    return _folded(calls, "name", ["at", "call_id"], step, ("closed", 0, 0, 0.0), "name string, call_id bigint, verdict string, state string", "state string, failed int, passed int, opened double", ["name", "call_id", "verdict", "state"])


def relay(deliveries: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch of deliveries to `send`; a batch is handed over again after a failure, so it must be idempotent."""
    return deliveries.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
