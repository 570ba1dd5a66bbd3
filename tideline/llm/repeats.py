"""Which of many (hash, document, position) references share their hash with another, by one even shuffle.

Each task first meets its own references: those that share a hash inside the task are known
to repeat, stay out of the search and leave one witness. So a hash adds at most one row for
each task, however common it is, and no reducer gets a hot group. References travel packed,
20 bytes each, in one binary for each task and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: hash, document key, position (negative: a witness of that many known references).
REF = np.dtype([("hash", "<i8"), ("key", "<i8"), ("pos", "<i4")])
PLACE, SPAN = np.dtype([("key", "<i8"), ("pos", "<i4")]), np.dtype([("key", "<i8"), ("pos", "<i4", (2,))])
#: References that a task gathers before it writes them out; bounds its memory.
GATHER = 1 << 21
SCHEMA = "bucket int, refs binary, known boolean"


def buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Gather:
    """Collects references in a task and yields Arrow batches of SCHEMA."""

    def __init__(self, n_buckets: int):
        self.n, self.parts, self.count = n_buckets, [], 0

    def add(self, hashes: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        refs = np.empty(len(hashes), REF)
        refs["hash"], refs["key"], refs["pos"] = hashes.view(np.int64), keys, pos
        self.parts.append(refs)
        self.count += len(refs)
        if self.count >= GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        refs, self.parts, self.count = np.concatenate(self.parts or [np.empty(0, REF)]), [], 0
        if not len(refs):
            return
        refs = refs[np.argsort(refs["hash"], kind="stable")]
        first, size = runs(refs["hash"])
        many = np.repeat(size > 1, size)
        known, search = refs[many], refs[~many]
        witness = refs[first[size > 1]]
        witness["pos"] = -size[size > 1]
        yield from self._batch(np.concatenate((search, witness)), "hash", False)
        yield from self._batch(known, "key", True)

    def _batch(self, refs: np.ndarray, by: str, known: bool) -> Iterator[pa.RecordBatch]:
        if not len(refs):
            return
        bucket = (refs[by].view(np.uint64) >> np.uint64(20)) % np.uint64(self.n)
        order = np.argsort(bucket, kind="stable")
        refs, bucket = refs[order], bucket[order]
        at, size = runs(bucket)
        blobs = [refs[a : a + k].tobytes() for a, k in zip(at, size, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([known] * len(at))], ["bucket", "refs", "known"])


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal numbers in x."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return at, np.diff(np.concatenate((at, [len(x)])))


def by_bucket(key: np.ndarray, pos: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket of the key, packed places). pos: a number for each key, or a pair."""
    bucket = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    at, size = runs(bucket[order])
    if len(at):
        held = np.empty(len(key), PLACE if pos.ndim == 1 else SPAN)
        held["key"], held["pos"] = key[order], pos[order]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at].astype(np.int32)), pa.array([held[a : a + k].tobytes() for a, k in zip(at, size, strict=True)], pa.binary())], ["bucket", "places"])


def _meet(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, search = [], []
        for b in batches:
            for blob, k in zip(b.column("refs").to_pylist(), b.column("known").to_pylist(), strict=True):
                (known if k else search).append(np.frombuffer(blob, REF))
        refs = np.concatenate(search or [np.empty(0, REF)])
        search.clear()
        refs = refs[np.argsort(refs["hash"], kind="stable")]
        _, size = runs(refs["hash"])
        found = refs[np.repeat(size > 1, size) & (refs["pos"] >= 0)]
        del refs
        for part in (found, np.concatenate(known or [np.empty(0, REF)])):
            yield from by_bucket(part["key"].copy(), part["pos"], n)

    return run


def _collect(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, kind) for b in batches for x in b.column("places").to_pylist()]
        places = np.concatenate(held or [np.empty(0, kind)])
        held.clear()
        places = places[np.argsort(places["key"], kind="stable")]
        at, size = runs(places["key"])
        for i in range(0, len(at), 5000):
            blobs = [[places["pos"][a : a + k].tobytes()] for a, k in zip(at[i : i + 5000], size[i : i + 5000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places["key"][at[i : i + 5000]]), pa.array(blobs, pa.list_(pa.binary()))], ["__key", "places"])

    return run


def by_key(rows: DataFrame, pairs: bool = False) -> DataFrame:
    """(__key, places) from rows (bucket, places) of by_bucket: all of a document's places in one packed binary, in a list."""
    return rows.repartitionById(buckets(rows), F.col("bucket")).mapInArrow(_collect(SPAN if pairs else PLACE), "__key bigint, places array<binary>")


def repeated(refs: DataFrame) -> DataFrame:
    """(__key, places): for each document key the positions, as packed int32 in a list, whose hash has another reference.

    refs: of SCHEMA, made by Gather. Two references count although document and position are equal (repeated rows).
    """
    n = buckets(refs)
    return by_key(refs.repartitionById(n, F.col("bucket")).mapInArrow(_meet(n), "bucket int, places binary"))


def positions(blobs: list[bytes] | None) -> np.ndarray:
    """The sorted distinct positions of a document's packed lists; none for null."""
    return np.unique(np.frombuffer(b"".join(blobs or []), np.int32)).astype(np.int64)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n places of those in [s, s + length) for some start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
