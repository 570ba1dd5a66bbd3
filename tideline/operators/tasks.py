"""Claims, transitions and listings over tasks(task_id, queue_id, state_code, priority, available_at, policy_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cutting import cut
from ..functions import decisions as d
from ..functions.clock import at, plus_days, plus_seconds, seconds_between


def _claim_order() -> list[Column]:
    return [F.desc("priority"), F.asc("available_at"), F.asc("task_id")]


def scan_claimable(tasks: DataFrame, now: str) -> DataFrame:
    return tasks.where(d.claimable(at(now))).select("task_id", "queue_id", "state_code", "priority", "available_at")


def _open_queues(queues: DataFrame) -> DataFrame:
    return queues.where(F.col("state_code") != d.QUEUE_PAUSED).select("queue_id")


def claim_head(tasks: DataFrame, queues: DataFrame, now: str) -> DataFrame:
    """The first claimable task of each queue that is not paused."""
    rank = F.row_number().over(Window.partitionBy("queue_id").orderBy(*_claim_order()))
    due = tasks.where(d.claimable(at(now))).join(_open_queues(queues), "queue_id")
    return due.withColumn("rank", rank).where("rank = 1").select("queue_id", "task_id", "priority", "available_at", F.col("state_code").alias("source_state"))


def ended_attempts(attempts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Ended attempts and the last generation of each task; `of`: only the attempts of its tasks are aggregated."""
    if of is not None:
        attempts = attempts.join(of.select("task_id"), "task_id", "left_semi")
    return attempts.groupBy("task_id").agg(F.count_if(F.col("outcome_code") != d.ATTEMPT_ACTIVE).alias("ended"), F.max("generation").alias("generation"))


def with_policy(tasks: DataFrame, policies: DataFrame) -> DataFrame:
    """Tasks with the policy that they were enqueued under."""
    return tasks.join(policies.select("policy_id", "enabled", "max_attempts", "retry_delay_seconds"), "policy_id")


def expiry(tasks: DataFrame, policies: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """Leases that have ended, and what becomes of their tasks: new_state, reason, new_available_at, terminal_at, completed."""
    ended = tasks.where((F.col("state_code") == d.LEASED) & (F.col("lease_expires_at") <= at(now)))
    known = with_policy(ended, policies).join(ended_attempts(attempts, ended).select("task_id", "ended"), "task_id", "left")
    completed = (F.coalesce("ended", F.lit(0)) + 1).cast("int")
    again = d.retry_at(at(now))
    state = F.when(F.col("cancel_requested"), d.CANCELLED).when(d.retries_left(F.col("completed")), d.waiting_state(again, at(now))).otherwise(d.DEAD)
    known = known.withColumn("completed", completed).withColumn("new_state", state)
    return known.select(
        "*",
        F.when(F.col("new_state") <= d.READY, again).alias("new_available_at"),
        F.when(F.col("new_state") >= d.SUCCEEDED, at(now)).alias("ended_at"),
        F.when(F.col("new_state") == d.DEAD, "lease.expired").alias("new_failure_code"),
        F.when(F.col("new_state") == d.CANCELLED, "cancel_requested").when(F.col("new_state") == d.DEAD, d.exhausted_reason()).otherwise("retry_scheduled").alias("reason"),
    )


def expire_leases(tasks: DataFrame, policies: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    out = expiry(tasks, policies, attempts, now)
    return out.select("task_id", "completed", "new_state", "new_available_at", F.col("ended_at").alias("terminal_at"), F.col("new_failure_code").alias("failure_code"), "reason")


def claim_batch(tasks: DataFrame, queues: DataFrame, policies: DataFrame, attempts: DataFrame, now: str, per_queue: int, lease_seconds: int) -> DataFrame:
    """The tasks that workers get when each open queue gives out `per_queue`.

    Ended leases keep their old place in the order; those that are cancelled, dead-lettered or delayed are passed over.
    """
    due = tasks.where(d.claimable(at(now))).join(_open_queues(queues), "queue_id")
    passed = expiry(tasks, policies, attempts, now).where(F.col("new_state") != d.READY).select("task_id")
    rank = F.row_number().over(Window.partitionBy("queue_id").orderBy(*_claim_order()))
    got = due.join(passed, "task_id", "left_anti").withColumn("rank", rank).where(F.col("rank") <= per_queue)
    last = ended_attempts(attempts, got).select("task_id", "generation")
    return got.join(last, "task_id", "left").select(
        "queue_id", "task_id", F.col("rank").cast("int").alias("rank"), F.col("state_code").alias("source_state"), F.lit(d.LEASED).alias("state_code"),
        (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), plus_seconds(at(now), lease_seconds).alias("lease_expires_at"),
    )


def claim_multi(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, position, queue_id): the head of the first queue, in the order asked for, that has one."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("position"))
    return requests.join(heads, "queue_id").withColumn("r", rank).where("r = 1").select("request_id", "position", "queue_id", "task_id")


def retry_decision(tasks: DataFrame, policies: DataFrame, attempts: DataFrame, now: str, fatal: str | None = None) -> DataFrame:
    """Leased tasks as if their attempt failed now. fatal: a failure code that is not retried (the latest failure's code is looked at)."""
    held = with_policy(tasks.where(F.col("state_code") == d.LEASED), policies)
    known = held.join(ended_attempts(attempts, held).select("task_id", "ended"), "task_id", "left").withColumn("completed", (F.coalesce("ended", F.lit(0)) + 1).cast("int"))
    stop = F.lit(False)
    if fatal is not None:
        last = last_failure(attempts).select("task_id", F.col("failure_code").alias("last_code"))
        known = known.join(last, "task_id", "left")
        stop = F.coalesce(F.col("last_code") == fatal, F.lit(False))
    again = d.retry_at(at(now))
    go = d.retries_left(F.col("completed")) & ~stop
    return known.select(
        "task_id", "completed",
        F.when(go, "retry_scheduled").otherwise("dead_lettered").alias("outcome"),
        F.when(go, None).when(stop, "non_retryable").otherwise(d.exhausted_reason()).alias("reason"),
        F.when(go, d.waiting_state(again, at(now))).otherwise(d.DEAD).alias("new_state"),
        F.when(go, again).alias("available_at"),
    )


def attempt_counts(attempts: DataFrame) -> DataFrame:
    active = F.col("outcome_code") == d.ATTEMPT_ACTIVE
    return attempts.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(~active).alias("ended"), F.count_if(active).alias("active"), F.max("generation").alias("max_generation"))


def last_failure(attempts: DataFrame) -> DataFrame:
    """The failure that ended last, of each task that has one."""
    latest = F.max_by(F.struct("attempt_id", "failure_code", "ended_at"), F.struct("ended_at", "attempt_id"))
    failed = attempts.where(F.col("failure_code").isNotNull() & F.col("ended_at").isNotNull())
    return failed.groupBy("task_id").agg(latest.alias("f")).select("task_id", "f.attempt_id", "f.failure_code", "f.ended_at")


def wait_processing(attempts: DataFrame) -> DataFrame:
    before = F.lag("ended_at").over(Window.partitionBy("task_id").orderBy("generation"))
    return attempts.select("attempt_id", "task_id", seconds_between(before, F.col("claimed_at")).alias("wait_seconds"), seconds_between(F.col("claimed_at"), F.col("ended_at")).alias("processing_seconds"))


def project_active(tasks: DataFrame) -> DataFrame:
    """Tasks that have not ended; what belongs to a claim only while one is held."""
    held = lambda c: F.when(F.col("state_code") == d.LEASED, F.col(c)).alias(c)
    name = F.element_at(F.array(F.lit("delayed"), F.lit("ready"), F.lit("leased")), F.col("state_code"))
    return tasks.where(F.col("state_code") <= d.LEASED).select("task_id", "queue_id", F.when(F.col("state_code") <= d.LEASED, name).alias("state"), "priority", held("claimed_at"), held("lease_expires_at"), held("worker_id"))


def page(rows: DataFrame, time: str, key: str, size: int, before: tuple[str, int] | None = None) -> DataFrame:
    """One row more than a page, latest first, after the keyset cursor `before` (time, key)."""
    if before:
        moment, last = at(before[0]), F.lit(before[1])
        rows = rows.where((F.col(time) < moment) | ((F.col(time) == moment) & (F.col(key) < last)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def page_tasks(tasks: DataFrame, policies: DataFrame, queue_id: int, size: int, skip: int) -> DataFrame:
    """The page of a queue's unfinished tasks behind the first `skip`, whose last row is the cursor; has_more tells of a row behind it."""
    rows = tasks.where((F.col("queue_id") == queue_id) & (F.col("state_code") <= d.LEASED))
    seen = rows.orderBy(F.desc("created_at"), F.desc("task_id")).limit(skip)
    cursor = seen.agg(F.min(F.struct("created_at", "task_id")).alias("c")).select(F.col("c.created_at").alias("c_at"), F.col("c.task_id").alias("c_id"))
    after = rows.join(F.broadcast(cursor), (F.col("created_at") < F.col("c_at")) | ((F.col("created_at") == F.col("c_at")) & (F.col("task_id") < F.col("c_id"))))
    got = page(after, "created_at", "task_id", size)
    more = F.count("*").over(Window.partitionBy()) > size
    return got.join(policies.select("policy_id", "version"), "policy_id").select("task_id", "state_code", "created_at", F.col("version").alias("policy_version"), more.alias("has_more"))


def list_attempts(attempts: DataFrame, task_ids: Column, since: str, until: str, size: int) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("active", "succeeded", "retry_scheduled", "dead_lettered", "expired", "cancelled")])
    rows = attempts.where(task_ids & F.col("claimed_at").between(at(since), at(until)))
    return page(rows, "claimed_at", "attempt_id", size).select("attempt_id", "task_id", "claimed_at", "ended_at", F.element_at(names, F.col("outcome_code")).alias("outcome"))


def list_dead_letters(tasks: DataFrame, since: str, until: str, size: int) -> DataFrame:
    rows = tasks.where((F.col("state_code") == d.DEAD) & F.col("terminal_at").between(at(since), at(until)))
    return page(rows, "terminal_at", "task_id", size).select("task_id", "queue_id", "terminal_at", "failure_code", F.lit(None).cast("string").alias("payload"))


def task_lookup(tasks: DataFrame, policies: DataFrame, queues: DataFrame, attempts: DataFrame, now: str, days: int) -> DataFrame:
    """Tasks as their owner sees them: active, or ended and within retention, with attempts and the last failure."""
    seen = tasks.where((F.col("state_code") <= d.LEASED) | (at(now) < plus_days(F.col("terminal_at"), days)))
    named = seen.join(queues.select("queue_id", "name"), "queue_id").join(policies.select("policy_id", "version"), "policy_id")
    failed = F.when(F.col("failure_code").isNotNull() & F.col("ended_at").isNotNull(), F.struct("ended_at", "attempt_id"))
    history = attempts.groupBy("task_id").agg(F.count_if(F.col("outcome_code") != d.ATTEMPT_ACTIVE).alias("ended"), F.max_by("failure_code", failed).alias("last_failure"))
    out = named.join(history, "task_id", "left")
    return out.select("task_id", F.col("name").alias("queue_name"), "state_code", F.when(F.col("state_code") <= d.LEASED, "active").otherwise("terminal").alias("part"), F.col("version").alias("policy_version"), F.coalesce("ended", F.lit(0)).alias("ended_attempts"), F.coalesce("failure_code", "last_failure").alias("failure_code"))


def all_tasks(tasks: DataFrame) -> DataFrame:
    part = lambda where, name: tasks.where(where).select("task_id", "queue_id", "state_code", F.lit(name).alias("part"))
    return part(F.col("state_code") <= d.LEASED, "active").unionByName(part(F.col("state_code") > d.LEASED, "terminal"))


def bulk_candidates(tasks: DataFrame, states: list[int], time: str, cap: int) -> DataFrame:
    """The first cap tasks in the states, oldest first, and whether there are more."""
    rows = tasks.where(F.col("state_code").isin(states)).orderBy(time, "task_id").limit(cap + 1)
    seen = rows.withColumn("r", F.row_number().over(Window.orderBy(time, "task_id"))).withColumn("truncated", F.max("r").over(Window.partitionBy()) > cap)
    return seen.where(F.col("r") <= cap).select("task_id", "queue_id", time, "truncated")


def cancel_apply(tasks: DataFrame, asked: Column, now: str) -> DataFrame:
    """Waiting tasks are cancelled at once; of leased ones the worker is asked, and an acknowledged ask cancels."""
    rows = tasks.where(asked)
    state = F.when(F.col("state_code") <= d.READY, d.CANCELLED).when((F.col("state_code") == d.LEASED) & F.col("cancel_requested"), d.CANCELLED).otherwise(F.col("state_code"))
    result = F.when(F.col("state_code") <= d.READY, "cancelled").when(F.col("state_code") == d.LEASED, F.when(F.col("cancel_requested"), "acknowledged").otherwise("requested")).otherwise("already_terminal")
    return rows.select("task_id", F.col("state_code").alias("old_state"), state.alias("new_state"), result.alias("result"), F.when((F.col("state_code") <= d.LEASED) & (state == d.CANCELLED), at(now)).otherwise(F.col("terminal_at")).alias("terminal_at"))


def completable(now: str) -> Column:
    return (F.col("state_code") == d.LEASED) & (F.col("lease_expires_at") > at(now)) & ~F.col("cancel_requested")


def complete_apply(tasks: DataFrame, now: str) -> DataFrame:
    return tasks.where(completable(now)).select("task_id", "queue_id", F.lit(d.SUCCEEDED).alias("new_state"), at(now).alias("terminal_at"))


def move_terminal(tasks: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(what stays active, what moved to the end) after the completion of every current lease."""
    active = tasks.where(F.col("state_code") <= d.LEASED)
    done = complete_apply(tasks, now).select("task_id")
    moved = active.join(done, "task_id", "left_semi").withColumn("state_code", F.lit(d.SUCCEEDED)).withColumn("terminal_at", at(now))
    return active.join(done, "task_id", "left_anti"), moved


def move_counts(tasks: DataFrame, now: str) -> DataFrame:
    rest, moved = move_terminal(tasks, now)
    both = rest.select("queue_id", F.lit(1).alias("stays")).unionByName(moved.select("queue_id", F.lit(0).alias("stays")))
    return both.groupBy("queue_id").agg(F.sum("stays").alias("remaining"), F.sum(1 - F.col("stays")).alias("moved"))


def lease_fence(tasks: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """Whether a worker with a task's latest generation still holds its lease."""
    last = attempts.groupBy("task_id").agg(F.max("generation").alias("generation"))
    held = tasks.where(F.col("state_code") == d.LEASED).join(last, "task_id")
    return held.select("task_id", "generation", F.when(F.col("lease_expires_at") > at(now), "CURRENT").otherwise("STALE").alias("fence"))


def spawn_children(tasks: DataFrame) -> DataFrame:
    kids = F.sort_array(F.collect_list(F.struct("spawn_ordinal", "task_id")))
    return tasks.where("source_task_id is not null").groupBy("source_task_id").agg(F.count("*").alias("children"), F.array_join(F.transform(kids, lambda x: x["task_id"].cast("string")), ",").alias("child_ids"))


def spawn_fanout(tasks: DataFrame, most: int = 512 * 1024) -> DataFrame:
    total = tasks.where("source_task_id is not null").groupBy("source_task_id").agg(F.count("*").alias("children"), F.sum("payload_bytes").alias("bytes"))
    return total.withColumn("over_limit", F.col("bytes") > most)


def next_spawn_ordinal(tasks: DataFrame) -> DataFrame:
    made = tasks.where("source_task_id is not null").groupBy(F.col("source_task_id").alias("task_id")).agg((F.max("spawn_ordinal") + 1).alias("next_ordinal"))
    return tasks.select("task_id").join(made, "task_id", "left").select("task_id", F.coalesce("next_ordinal", F.lit(0)).alias("next_ordinal"))


def lineage_consistency(tasks: DataFrame) -> DataFrame:
    """Whether the ordinals of a parent's children are 0 to n - 1."""
    got = tasks.where("source_task_id is not null").groupBy("source_task_id").agg(F.count("*").alias("n"), F.countDistinct("spawn_ordinal").alias("k"), F.min("spawn_ordinal").alias("low"), F.max("spawn_ordinal").alias("high"))
    return got.select("source_task_id", F.col("n").alias("children"), ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("k") == F.col("n"))).alias("consistent"))


def spawn_depth(tasks: DataFrame) -> DataFrame:
    """Depth and size of each tree of spawned tasks with two members or more; task_id is unique.

    A task whose source is null, unknown or itself is a root; tasks under a cycle belong to no tree. Each round doubles the
    steps that every task looks up, so a tree of depth n takes log2(n) rounds.
    """
    links = tasks.select("task_id", F.when(F.col("source_task_id") != F.col("task_id"), F.col("source_task_id")).alias("up"))
    known = links.select(F.col("task_id").alias("up"), F.lit(1).alias("steps"))
    reached = cut(links.join(known, "up", "left").select("task_id", F.when(F.col("steps") == 1, F.col("up")).otherwise(F.col("task_id")).alias("up"), F.coalesce("steps", F.lit(0)).alias("steps")))
    climbing, before = F.col("next").isNotNull(), None
    while True:
        above = reached.where("steps > 0").select(F.col("task_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        reached = cut(reached.join(above, "up", "left").select("task_id", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), climbing.alias("climbing")))
        left = reached.where("climbing").count()
        # Paths that end get fewer by each doubling; only those into cycles do not.
        if left in (0, before):
            break
        before = left
    trees = reached.where("not climbing").groupBy(F.col("up").alias("root")).agg(F.max("steps").alias("max_depth"), F.count("*").alias("size"))
    return trees.where("size > 1")
