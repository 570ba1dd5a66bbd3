"""File sources and sinks: named-queue catalogs, latency samples, generators, history tables and deliveries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENCY = "operation string, scenario string, latency_ns long, outcome string, fan_out int"
CATALOG_MOST = 1 << 20


class CatalogError(ValueError):
    """A catalog that is not wholly valid; nothing of it is used."""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Queues of a JSON catalog, at most 1 MiB: name, enabled, max_attempts, backoff_strategy, retry_delay_seconds. Any fault refuses the file."""
    lines = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(lines) != 1 or len(lines[0][0].encode()) > CATALOG_MOST:
        raise CatalogError("a catalog is one file of at most 1 MiB")
    try:
        doc = json.loads(lines[0][0])
    except ValueError as e:
        raise CatalogError("not JSON") from e
    policy = {"enabled": bool, "max_attempts": int, "backoff_strategy": str, "retry_delay_seconds": int}
    if not isinstance(doc, dict) or set(doc) != {"schema_version", "queues"} or doc["schema_version"] != 1 or not isinstance(doc["queues"], list):
        raise CatalogError("unknown shape")
    rows = []
    for q in doc["queues"]:
        if not isinstance(q, dict) or set(q) != {"name", "initial_policy"} or not isinstance(q["initial_policy"], dict) or set(q["initial_policy"]) != set(policy):
            raise CatalogError("unknown or missing key in a queue")
        values = q["initial_policy"]
        if any(type(values[k]) is not t for k, t in policy.items()) or values["backoff_strategy"] != "fixed":
            raise CatalogError(f"bad policy of {q['name']!r}")
        rows.append((q["name"], *(values[k] for k in policy)))
    if len({r[0] for r in rows}) != len(rows):
        raise CatalogError("a name stands twice")
    return spark.createDataFrame(rows, "name string, enabled boolean, max_attempts int, backoff_strategy string, retry_delay_seconds int")


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """Latency samples from (gzip) JSON lines; a malformed line fails the read."""
    return spark.read.schema(LATENCY).option("mode", "FAILFAST").json(path)


def generated(spark: SparkSession, n: int, payload_bytes: int, seed: str = "0") -> DataFrame:
    """n synthetic rows with keys and payloads that depend on their number and the seed only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return spark.range(n).select("id", digest.alias("idem_key"), F.substring(F.repeat(digest, payload_bytes // 64 + 1), 1, payload_bytes).alias("payload"))


def round_robin(rows: DataFrame, queues: int) -> DataFrame:
    return rows.withColumn("queue_id", F.pmod("id", F.lit(queues)))


def append_history(rows: DataFrame, path: str, time: str) -> None:
    """Append to a history table laid out by UTC day, so that bounded reads touch only their days."""
    rows.withColumn("day", F.to_date(time)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Rows of the days since to until, both included; other days' files are not opened."""
    return spark.read.parquet(path).where(F.col("day").between(F.to_date(F.lit(since)), F.to_date(F.lit(until))))


def history_days(spark: SparkSession, path: str) -> DataFrame:
    """The days that a history table holds, from its layout."""
    return spark.read.parquet(path).select("day").distinct()


def envelope(rows: DataFrame, source: str) -> DataFrame:
    """rows(event_id, type, at, data) as JSON event envelopes."""
    fields = F.struct(F.lit("1.0").alias("specversion"), F.col("event_id").cast("string").alias("id"), F.lit(source).alias("source"), F.col("type"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.lit("application/json").alias("datacontenttype"), F.col("data"))
    return rows.select("event_id", F.to_json(fields).alias("envelope"))
