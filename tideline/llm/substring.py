"""Repeated passages of words, found by difference-cover anchors.

Positions whose number modulo PERIOD is in COVER carry an anchor: the hash of the next
window - PERIOD + 1 words. COVER meets every difference modulo PERIOD, so two equal windows
at any two positions hold anchors at the same offset, and these are equal. Repeated anchors
are then extended to all the windows around them, and those are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from ._state import without, written
from ._text import chunks, windows, words

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))))


def _anchors(window: int, text_col: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = repeats.Gather(n_buckets), window - PERIOD + 1
        for b in batches:
            keys = b.column("__key").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in chunks(b.column(text_col)):
                w = words(data, offsets)
                w = _long(w, window)
                h, at = windows(w, size)
                doc = w.doc()[at]
                pos = at - w.first[doc]
                held = np.isin(pos % PERIOD, COVER)
                yield from out.add(h[held], keys[row:end][doc[held]], pos[held])
        yield from out.flush()

    return run


def _long(w, window: int):
    """w with the words of texts that hold no window left out."""
    n = np.diff(w.first)
    if (n >= window).all():
        return w
    keep = np.repeat(n >= window, n)
    w.first = np.concatenate(([0], np.cumsum(np.where(n >= window, n, 0))))
    w.hashes, w.start, w.end = w.hashes[keep], w.start[keep], w.end[keep]
    return w


def _extended(window: int, text_col: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reach = repeats.Gather(n_buckets), PERIOD
        for b in batches:
            keys, found = b.column("__key").to_numpy(zero_copy_only=False), b.column("__places").to_pylist()
            for row, end, data, offsets in chunks(b.column(text_col)):
                w = words(data, offsets)
                h, at = windows(w, window)
                doc = w.doc()[at]
                pos = at - w.first[doc]
                near = np.zeros(len(at) + 1, np.int32)
                first = np.searchsorted(doc, np.arange(end - row + 1))
                for d in range(end - row):
                    if (n := first[d + 1] - first[d]) and found[row + d]:
                        p = repeats.positions(found[row + d])
                        np.add.at(near, first[d] + np.clip(p - reach + 1, 0, n), 1)
                        np.add.at(near, first[d] + np.minimum(p + 1, n), -1)
                held = np.cumsum(near[:-1]) > 0
                yield from out.add(h[held], keys[row:end][doc[held]], pos[held])
        yield from out.flush()

    return run


RESULT = "n_words bigint, n_removed bigint, kept_sha256 string"


def _cut(window: int, text_col: str, columns: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows = b.column("__places").to_pylist(), []
            for row, end, data, offsets in chunks(b.column(text_col)):
                w = words(data, offsets)
                raw = data.tobytes()
                for d in range(end - row):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    start, stop = w.start[lo:hi], w.end[lo:hi]
                    if found[row + d]:
                        keep = ~repeats.covered(repeats.positions(found[row + d]), window, hi - lo)
                        start, stop = start[keep], stop[keep]
                    kept = b" ".join([raw[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)])
                    rows.append((hi - lo, hi - lo - len(start), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            n, removed, sha, text = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [b.column(c) for c in columns] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                arrays.append(pa.array(text, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """df(doc_id, text, ...) with n_words, n_removed, kept_sha256 and (with_text) kept_text: the words left, joined by one space.

    A word goes if a window of words around it starts anywhere else, in the same text or another; windows are
    judged on the input. Null is an empty text; empty texts and those under `window` words stay whole. Repeated
    rows repeat each other's windows. Hashes of 64 bits stand for windows. window must be over 21.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD}")
    df = without(df, "n_words", "n_removed", "kept_sha256", "kept_text")
    keyed = _keyed(df, text_col)
    slim = keyed.select("__key", text_col)
    n = repeats.buckets(df)
    anchors = written(repeats.repeated(slim.mapInArrow(_anchors(window, text_col, n), repeats.SCHEMA)), "cover-anchors")
    near = slim.join(anchors.withColumnRenamed("places", "__places"), "__key").mapInArrow(_extended(window, text_col, n), repeats.SCHEMA)
    found = written(repeats.repeated(near), "cover-windows")
    columns = [c for c in df.columns if c != text_col or with_text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns) + ", " + RESULT + ", kept_text string" * with_text
    return keyed.join(found.withColumnRenamed("places", "__places"), "__key", "left").mapInArrow(_cut(window, text_col, columns, with_text), schema)


def report(documents: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text)."""
    return remove_repeats(documents.select("doc_id", "text"), with_text=False)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT p.rid, p.i FROM p JOIN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) USING (h)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM r),
k AS (SELECT rid, list(k) AS ks FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
