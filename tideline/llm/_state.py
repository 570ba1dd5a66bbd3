"""Places for intermediate tables, and joins whose broadcast depends on a measured size."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Most rows of a written table that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: And most bytes, as the optimiser knows them from the files.
BROADCAST_BYTES = 4 << 20
#: Rows of a table of marks at most, and 64-bit words in each: 3 MB, whatever the number of keys.
MARK_ROWS, MARK_WORDS = 1 << 16, 6
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch that goes to Python, unless the session says otherwise: each task holds a few batches of whole texts.
BATCH_ROWS = 500
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Send this package to the executors, and keep batches of texts small where the session has Spark's default."""
    ship(spark)
    if spark.conf.get(BATCHES) == "10000":
        spark.conf.set(BATCHES, str(BATCH_ROWS))


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tideline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a folder of our own only where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_dir()


def _drop(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None and spark.sparkContext._jsc is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The folder goes when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    # Nothing reads this plan's shuffle files once its rows are written, so they can go at once.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_quiet_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _quiet_drop(df.sparkSession, folder)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that results are about to take the names of."""
    return df.drop(*[n for n in names if n in df.columns])


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row of df for each key: the least of its rows, so that repeated rows add none and their order tells nothing."""
    return df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("__least")).select(key, "__least.*")


def _quiet_drop(spark: SparkSession, path: str) -> None:
    try:
        _drop(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already when the driver ends
        pass


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is at most so many rows (counted now) and BROADCAST_BYTES in its files, else df as it is.

    For tables from written(), or projections of them.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df



def _mark(key: str, rows: int) -> tuple[Column, list[Column]]:
    """The row of a key (a column of long numbers) in a table of so many marks, and its bit in each word."""
    turn = F.xxhash64(F.col(key), F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(turn, 6 * k), F.lit(64)).cast("int")) for k in range(MARK_WORDS)]
    return F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(rows)), bits


class Marks:
    """A Bloom filter of the keys (long numbers) in a column, as a table that a join broadcasts whatever their number.

    Each key sets a bit in each word of one row. With 3 million keys some 2 % of other keys seem to be there too;
    more keys let more through, and an exact join has to follow.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int, name: str):
        self.rows = min(MARK_ROWS, n_keys // 16 + 1)
        row, bits = _mark(key, self.rows)
        words = [F.bit_or(b).alias(f"__word{k}") for k, b in enumerate(bits)]
        self.table = written(keys.groupBy(row.alias("__mark")).agg(*words), name)

    def split(self, df: DataFrame, key: str, there: bool) -> DataFrame:
        """The rows of df whose key may be there, or those whose key is not there for sure."""
        row, bits = _mark(key, self.rows)
        own = F.lit(True)
        for k, b in enumerate(bits):
            own = own & (F.col(f"__word{k}").bitwiseAND(b) != 0)
        met = df.withColumn("__row", row).join(F.broadcast(self.table), F.col("__row") == F.col("__mark"), "inner" if there else "left")
        return met.where(own if there else ~F.coalesce(own, F.lit(False))).select(*df.columns)
