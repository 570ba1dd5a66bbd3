"""Retention, partitions, measurements, pressure, and checks of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..functions.clock import at, plus_days, seconds_between

# Bounds of the latency histogram in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0, 2.5, 5.0)
# Retention windows, their days, and whether their age shows in partitions.
WINDOWS = (
    ("task_terminal", 90, True), ("attempt", 90, True), ("admin_audit", 90, True), ("correctness_enqueue_dedup", 90, False),
    ("correctness_complete_replay", 7, False), ("correctness_admin_replay", 30, False), ("delivery_published", 30, True), ("delivery_dead_letter", 90, True),
)
# Release gates.
HOT_P99_NS, COMPLETE_P99_NS, LEAST_RATIO, LEAST_CLAIMS = 100_000_000, 200_000_000, 0.999, 500.0


def partition_days(rows: DataFrame, time: str) -> DataFrame:
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("rows"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def missing_partitions(present: DataFrame, parents: DataFrame, first: str, days: int) -> DataFrame:
    """The required days, first to first + days, of parents(parent) that present(parent, day) does not hold."""
    need = parents.select("parent", F.explode(F.expr(f"sequence(DATE'{first}', date_add(DATE'{first}', {days}))")).alias("day"))
    return need.join(present, ["parent", "day"], "left_anti")


def partition_headroom(present: DataFrame, today: str, horizon: int = 30) -> DataFrame:
    """For each parent of present(parent, day) how far its days run on from `today`, whether a gap follows, and which parent is worst.

    Without a partition of today, through is null and remaining -1. A gap begins within the horizon and has a day after it.
    The worst parent is one with a gap, else the one with the least days left; of several, the first by name.
    """
    now, day = F.to_date(F.lit(today)), F.col("day")
    ahead = F.count(F.when(day >= now, 1)).over(Window.partitionBy("parent").orderBy("day"))
    days = present.select("parent", "day").distinct().withColumn("ahead", ahead)
    # Days from today on that are as many as they lie apart form the first run.
    got = days.groupBy("parent").agg(F.max(F.when((day >= now) & (F.date_diff(day, now) == F.col("ahead") - 1), day)).alias("through"), F.max("day").alias("last"))
    missing = F.coalesce(F.date_add("through", 1), now)
    got = got.withColumn("interior_gap", (F.col("last") > missing) & (missing <= F.date_add(now, horizon))).withColumn("remaining", F.coalesce(F.date_diff("through", now), F.lit(-1)))
    least = F.struct(~F.col("interior_gap"), F.when(F.col("interior_gap"), 0).otherwise(F.col("remaining")), "parent")
    worst = got.agg(F.min_by("parent", least).alias("worst_parent"))
    return got.join(F.broadcast(worst)).select("parent", "through", "remaining", "interior_gap", (F.col("parent") == F.col("worst_parent")).alias("worst"))


def partition_names(days: DataFrame, parent: str) -> DataFrame:
    """Child names of days(day), and the days read back from them."""
    name = F.concat(F.lit(f"{parent}_"), F.date_format("day", "yyyyMMdd"))
    return days.select("day", name.alias("child"), F.to_date(F.right(name, F.lit(8)), "yyyyMMdd").alias("parsed_day"))


def retention_plan(days: DataFrame, now: str, keep_days: int) -> DataFrame:
    """days(parent, day, rows): a day goes once its end has expired."""
    gone = plus_days(F.date_add("day", 1).cast("timestamp_ntz"), keep_days) <= at(now)
    return days.select("parent", "day", "rows", F.when(gone, "drop").otherwise("keep").alias("action"))


def retention_window(oldest: DataFrame, today: str) -> DataFrame:
    """oldest(window, day): policy and age of each window."""
    spark = oldest.sparkSession
    table = spark.createDataFrame(list(WINDOWS), "window string, policy_days int, partitioned boolean")
    age = F.date_diff(F.to_date(F.lit(today)), F.col("day"))
    return F.broadcast(table).join(oldest, "window", "left").select("window", "policy_days", F.when(F.col("partitioned"), age).alias("oldest_age_days"))


def retention_alerts(headroom: DataFrame, outcome: str, failures: int, stale: bool) -> DataFrame:
    """The alerts of an instance that hold, one row each, by the headroom(remaining, worst) of its worst parent and the last maintenance run.

    Without parents there is no headroom to warn of. Failures alert only while the last outcome is 'failed'.
    """
    alert = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    low = F.when(F.col("remaining") <= 0, alert("premake_headroom_exhausted", "critical")).when(F.col("remaining") <= 3, alert("premake_headroom_low", "warning"))
    more = [alert("sustained_maintenance_failure", "critical")] * (outcome == "failed" and failures >= 2) + [alert("stats_stale", "warning")] * stale
    worst = headroom.agg(F.max(F.when(F.col("worst"), F.col("remaining"))).alias("remaining"))
    return worst.select(F.explode(F.array_compact(F.array(low, *more))).alias("a")).select("a.kind", "a.severity")


def _valid() -> Column:
    return ~F.col("outcome").isin("planned_pause", "planned_drain", "invalid_request")


def op_stats(samples: DataFrame) -> DataFrame:
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    got = samples.groupBy("operation", "scenario").agg(F.count("*").alias("samples"), F.count_if(_valid()).alias("valid_attempts"), n("success", "empty").alias("successes"), n("error").alias("errors"), n("planned_pause").alias("planned_pause"), n("planned_drain").alias("planned_drain"), n("invalid_request").alias("invalid_requests"))
    return got.withColumn("success_ratio", F.when(F.col("valid_attempts") > 0, F.round(F.col("successes") / F.col("valid_attempts"), 6)))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, **permille: int) -> DataFrame:
    """Nearest-rank percentiles of the known values of each group, exact; keys are not null. permille: column name and rank in thousandths.

    Values are first counted by 64ths of an octave, which finds where each rank lies; only values there are counted one by one.
    So no task sorts or holds a group, but the distinct values of 1/64 of an octave at most.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.floor(F.log2(F.greatest(F.col(value), F.lit(0)) + 1) * 64).alias("bin"))
    run = lambda n, *by: F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]))
    bins = known.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("under", run("n", *keys, "bin") - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.expr(f"(total * {p} + 999) div 1000")).alias("rank")) for name, p in permille.items()])
    asked = bins.select("*", F.explode(ranks).alias("r")).where("r.rank > under and r.rank <= under + n").select(*keys, "bin", "r.name", (F.col("r.rank") - F.col("under")).alias("rank"))
    near = known.join(asked.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "v").agg(F.count("*").alias("c"))
    near = near.withColumn("upto", run("c", *keys, "bin", "v"))
    hit = near.join(asked, [*keys, "bin"]).where("rank > upto - c and rank <= upto")
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).cast("bigint").alias(name) for name in permille])


def op_percentiles(samples: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of valid attempts."""
    return nearest_ranks(samples.where(_valid()), ["operation", "scenario"], "latency_ns", p50_ns=500, p99_ns=990)


def qualification(samples: DataFrame, measured_seconds: float) -> DataFrame:
    """Throughput, success and tail latency against the release gates."""
    gated = ("enqueue", "claim", "heartbeat", "complete")
    tails = nearest_ranks(samples.where(_valid() & (F.col("scenario") == "baseline") & F.col("operation").isin(*gated)), ["operation"], "latency_ns", p99=990)
    tails = tails.agg(*[F.max(F.when(F.col("operation") == op, F.col("p99"))).alias(f"{op}_p99_ns") for op in gated])
    good = F.count_if(F.col("outcome").isin("success", "empty"))
    rates = samples.agg(
        F.round(F.count_if((F.col("operation") == "claim") & (F.col("outcome") == "success")) / F.lit(float(measured_seconds)), 6).alias("claims_per_second"),
        F.round(good / F.nullif(F.count_if(_valid()), F.lit(0)), 6).alias("success_ratio"),
    )
    got = rates.join(F.broadcast(tails))  # one row each
    ok = (F.col("claims_per_second") >= LEAST_CLAIMS) & (F.col("success_ratio") >= LEAST_RATIO) & (F.col("complete_p99_ns") <= COMPLETE_P99_NS)
    for op in ("enqueue", "claim", "heartbeat"):
        ok &= F.col(f"{op}_p99_ns") <= HOT_P99_NS
    return got.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def latency_histogram(samples: DataFrame) -> DataFrame:
    """Cumulative counts of samples under each bound, the last without bound."""
    bounds = F.explode(F.array(*[F.lit(b) for b in (*BUCKETS, float("inf"))])).alias("le")
    n = len(BUCKETS)
    # Each sample falls into one bucket; the sums over buckets make it cumulative, so rows are not multiplied by bounds.
    place = F.lit(n)
    for i in range(n - 1, -1, -1):
        place = F.when(F.col("latency_ns") / 1e9 <= BUCKETS[i], i).otherwise(place)
    counts = samples.groupBy("operation", place.alias("place")).agg(F.count("*").alias("c"))
    grid = counts.select("operation").distinct().select("operation", bounds).withColumn("place", F.row_number().over(Window.partitionBy("operation").orderBy("le")) - 1)
    total = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("operation").orderBy("place"))
    return grid.join(counts, ["operation", "place"], "left").select("operation", F.when(F.col("le") < float("inf"), F.format_string("%.3f", "le")).otherwise("+Inf").alias("le"), total.alias("n"))


def metric_series(samples: DataFrame) -> DataFrame:
    """A counter, a duration sum and the latest duration for each pair of labels."""
    return samples.groupBy("operation", "outcome").agg(F.count("*").alias("counter"), F.sum("latency_ns").alias("sum_ns"), F.max_by("latency_ns", F.struct("ts", "sample_id")).alias("gauge_ns"))


def error_ratio(samples: DataFrame) -> DataFrame:
    """Service errors among the samples that count: empty, paused, draining and invalid ones do not."""
    held = F.count_if(_valid() & (F.col("outcome") != "empty"))
    bad = F.count_if(F.col("outcome") == "error")
    return samples.groupBy("operation").agg(bad.alias("errors"), held.alias("total"), F.when(held > 0, F.round(bad / held, 6)).otherwise(0.0).alias("error_ratio"))


def longpoll_error_ratio(samples: DataFrame) -> DataFrame:
    """Errors among all claims, whatever their outcome."""
    bad = F.count_if(F.col("outcome") == "error")
    return samples.where("operation = 'claim'").agg(bad.alias("errors"), F.count("*").alias("total"), F.when(F.count("*") > 0, F.round(bad / F.count("*"), 6)).otherwise(0.0).alias("error_ratio"))


def select_candidate(candidates: DataFrame) -> DataFrame:
    """candidates(candidate_id, bytes, p99_ns, wal_bytes, success_ratio): why each is out, and the least eligible one."""
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.col("success_ratio") < 0.5, F.lit(True)), "success_ratio"), F.when(F.coalesce(F.col("p99_ns") > 400 * 1_000_000, F.lit(True)), "claim_p99")))
    rows = candidates.withColumn("reasons", F.array_join(reasons, ","))
    best = rows.where("reasons = ''").agg(F.min_by("candidate_id", F.struct("bytes", "p99_ns", "wal_bytes", "candidate_id")).alias("best"))
    return rows.join(F.broadcast(best)).select("candidate_id", "reasons", F.coalesce(F.col("candidate_id") == F.col("best"), F.lit(False)).alias("selected"))


def pressure_status(rows: DataFrame) -> DataFrame:
    """The state of each signal; a pool's is the worse of saturation and waiting, saturation on a tie."""
    state = lambda c: F.when(F.col(c).isNull(), "unavailable").otherwise(d.rank_name(d.ratio_rank(F.col(c)))).alias(f"{c}_status")
    full, wait = d.ratio_rank(F.coalesce("pool_saturation", F.lit(0.0))), d.ratio_rank(F.coalesce("pool_wait_seconds", F.lit(0.0)), 0.05, 0.2)
    reason = F.when(F.greatest(full, wait) == 0, "within_budget").when(full >= wait, "pool_saturation").otherwise("pool_wait")
    return rows.select("observed_at", state("wal"), state("disk"), state("autovacuum"), d.rank_name(F.greatest(full, wait)).alias("pool_status"), reason.alias("pool_reason"))


def peak_pressure(rows: DataFrame) -> DataFrame:
    """The greatest of the known ratios; 1 where none is known, which also blocks clearing."""
    peak = F.greatest("wal", "disk", "autovacuum", "pool_saturation", F.when(F.col("pool_wait_seconds").isNotNull(), d.wait_as_ratio(F.col("pool_wait_seconds"))))
    return rows.select("observed_at", F.round(F.coalesce(peak, F.lit(1.0)), 6).alias("peak"), peak.isNull().alias("clear_blocked"))


def workload_matrix(spark, **axes: list) -> DataFrame:
    """All combinations of the axes' values (small literals), numbered in order."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.withColumn("cell", F.row_number().over(Window.orderBy(*axes)))


def payload_size(docs: DataFrame, soft: int, hard: int) -> DataFrame:
    n = F.octet_length("text")
    return docs.select("doc_id", n.cast("long").alias("bytes"), (n > soft).alias("over_soft"), (n > hard).alias("over_hard"))


def content_hash(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, each with the number of documents that share it, in one pass by fingerprint."""
    keyed = docs.select(F.sha2("text", 256).alias("fingerprint"), "doc_id")
    return keyed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).withColumn("reference", F.substring("fingerprint", 1, 16))


def redact_diag(rows: DataFrame, longest: int) -> DataFrame:
    """Diagnostics with numbers and codes kept, free content hidden and long strings cut."""
    name = F.col("event_type")
    return rows.select("event_id", F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest), F.lit("..."))).otherwise(name).alias("event_type"), "value", F.lit("[REDACTED]").alias("props"))


def event_valid(rows: DataFrame) -> DataFrame:
    """rows(id, source, type): a source is an absolute URI without blanks, a type is not empty."""
    ok = F.col("source").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$")
    return rows.select("id", F.coalesce(ok, F.lit(False)).alias("source_ok"), F.coalesce(F.length("type") > 0, F.lit(False)).alias("type_ok"))


def bound_code(rows: DataFrame) -> DataFrame:
    return rows.select("task_id", d.bounded_code(F.col("failure_code")).alias("code"))


def inv_report(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Violations of each rule, in one scan of each table."""
    quad = (F.col("claimed_at").isNull() != F.col("lease_expires_at").isNull()) | (F.col("claimed_at").isNull() != F.col("worker_id").isNull())
    rules = {
        "claim_fields": quad, "lineage_pair": F.col("source_task_id").isNull() != F.col("spawn_ordinal").isNull(),
        "leased_has_claim": (F.col("state_code") == d.LEASED) & F.col("claimed_at").isNull(), "priority_range": ~F.col("priority").between(-32768, 32767),
        "terminal_time": (F.col("state_code") >= d.SUCCEEDED) != F.col("terminal_at").isNotNull(),
    }
    one = tasks.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()]).unpivot([], list(rules), "invariant", "violations")
    late = {"attempt_ends_after_claim": F.col("ended_at") < F.col("claimed_at"), "active_has_no_end": (F.col("outcome_code") == 1) != F.col("ended_at").isNull()}
    two = attempts.agg(*[F.count_if(rule).alias(name) for name, rule in late.items()]).unpivot([], list(late), "invariant", "violations")
    return one.unionByName(two)


def inv_unique(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inv_due_gating(tasks: DataFrame, now: str) -> DataFrame:
    """For queues with a due task: tasks that wait for a later time, and due ones."""
    due = d.claimable(at(now))
    return tasks.where(F.col("state_code") <= d.LEASED).groupBy("queue_id").agg(F.count_if(due).alias("due"), F.count_if((F.col("state_code") <= d.READY) & ~due).alias("future")).where("due > 0")


def inv_claim_ordering(tasks: DataFrame, heads: DataFrame, now: str) -> DataFrame:
    """Queues whose head does not have the greatest priority among their due tasks; none should be."""
    top = tasks.where(d.claimable(at(now))).groupBy("queue_id").agg(F.max("priority").alias("top"))
    return heads.join(top, "queue_id").agg(F.count_if(F.col("priority") != F.col("top")).alias("violations"))


def ordinal_contiguity(rows: DataFrame) -> DataFrame:
    got = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.countDistinct("turn").alias("k"))
    ok = (F.col("first_turn") == 0) & (F.col("last_turn") == F.col("turns") - 1) & (F.col("k") == F.col("turns"))
    return got.select("conv_id", "turns", "first_turn", "last_turn", ok.alias("contiguous"))


def seconds_old(rows: DataFrame, time: str, now: str) -> DataFrame:
    return rows.withColumn("age_seconds", F.greatest(F.lit(0), seconds_between(F.col(time), at(now))))
