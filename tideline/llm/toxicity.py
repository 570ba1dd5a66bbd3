"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each n-gram gives two features: whether the text holds it, scaled by the log ratio of the
shares of texts, and how dense it is there, scaled by the log ratio of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from ._state import one_each, without, written
from ._text import chunks, lower_ascii

#: Labelled rows that the classifier is fitted on at most: those whose id hashes lowest.
SAMPLE = 3_000
#: n-grams are runs of so many bytes of the lower-cased text, hashed into 2**BITS features.
SIZES, BITS = (4, 6), 18
#: Features that are kept, by the size of their ratio and support, and texts of a class that must hold one.
FEATURES, SUPPORT, ALPHA = 4_000, 5, 1.0
#: Ridge and steps of the fit.
L2, STEPS = 1e-2, 200
POSITIVE_FROM = 0.7


@dataclass
class Model:
    """Weights of all hashed n-grams, of presence and of density (ratio times coefficient, 0 where unused), intercept and calibration."""

    present: np.ndarray
    dense: np.ndarray
    intercept: float
    a: float = 1.0
    b: float = 0.0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, number of its text) of each n-gram, one size at a time. A text reads as if a space stood before and after it."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * doc + 1] = lower_ascii(data)
    padded[(padded == 10) | (padded == 9) | (padded == 13)] = 32
    edges = offsets + 2 * np.arange(n + 1)
    owner = np.repeat(np.arange(n), np.diff(edges))
    for size in SIZES:
        count = len(padded) - size + 1
        if count <= 0:
            continue
        code = np.full(count, size, np.uint64)
        for j in range(size):
            code = code * np.uint64(257) + padded[j : j + count]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        inside = owner[:count] == owner[size - 1 :]
        yield code[inside].astype(np.int64), owner[:count][inside]


def density(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.log1p(2000.0 * counts / (size + 400.0))


def _counts(text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, counts, sizes = [], [], []
            for row, end, data, offsets in chunks(b.column(text_col)):
                pairs, times = np.unique(np.concatenate([(d << BITS) | f for f, d in features(data, offsets)] or [np.zeros(0, np.int64)]), return_counts=True)
                cut = np.searchsorted(pairs, np.arange(end - row + 1) << BITS).tolist()
                gram, times = (pairs & ((1 << BITS) - 1)).astype(np.int32), times.astype(np.int32)
                grams += [gram[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                counts += [times[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                sizes.append(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(grams, pa.binary()), pa.array(counts, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], [*columns, "grams", "counts", "size"])

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Fit on at most `sample` rows of labels(doc_id, <label>), the ones given; without both classes every score is the share of positives.

    Null ids and labels are left out; an id with several labels takes the highest, and one with several texts its least.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    chosen = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "__y"), "toxicity-sample")  # bounded, so it can be broadcast
    held = one_each(documents.select("doc_id", text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", "__y", text_col), "__id")
    got = held.mapInArrow(_counts(text_col, ["__id", "__y"]), f"__id {documents.schema['doc_id'].dataType.simpleString()}, __y int, grams binary, counts binary, size bigint").toPandas()
    got = got.sort_values(["__id", "size"], kind="stable")
    y, size = got["__y"].to_numpy(dtype=float), got["size"].to_numpy()
    none = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        return Model(none, none, float(np.log(share / (1 - share))))
    grams, counts = [[np.frombuffer(x, np.int32) for x in got[c]] for c in ("grams", "counts")]
    # For each class, positives first: texts with the n-gram, and its occurrences. A text holds an n-gram once in its list.
    texts, totals = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    for g, c, t in zip(grams, counts, y, strict=True):
        texts[int(t == 0), g] += 1
        totals[int(t == 0), g] += c
    n = np.array([y.sum(), len(y) - y.sum()])
    by_text = np.log((texts[0] + ALPHA) / (n[0] + 2 * ALPHA)) - np.log((texts[1] + ALPHA) / (n[1] + 2 * ALPHA))
    by_count = np.log((totals[0] + ALPHA) / (totals[0].sum() + 1)) - np.log((totals[1] + ALPHA) / (totals[1].sum() + 1))
    worth = np.maximum(np.abs(by_text), np.abs(by_count)) * np.sqrt(np.minimum(texts[0] + texts[1], 400))
    worth[np.maximum(texts[0], texts[1]) < SUPPORT] = 0
    kept = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    kept = kept[worth[kept] > 0]
    m = len(kept)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(m)
    rows = []
    for g, c, s in zip(grams, counts, size, strict=True):
        at = place[g]
        c, at = c[at >= 0], at[at >= 0]
        rows.append((np.concatenate((at, at + m)), np.concatenate((by_text[kept[at]], by_count[kept[at]] * density(c, s)))))
    fold = np.arange(len(y)) % 5 == 0  # for calibration
    train, all_rows = linear.Sparse([r for r, f in zip(rows, fold, strict=True) if not f]), linear.Sparse(rows)
    w, b = linear.logistic(train.dot, lambda e: train.back(e, 2 * m), 2 * m, y[~fold], l2=L2, steps=STEPS, rate=0.01)
    margin = all_rows.dot(w) + b
    a, c = linear.platt(margin[fold], y[fold]) if 0 < y[fold].sum() < fold.sum() else (1.0, 0.0)
    present, dense = none.copy(), none.copy()
    present[kept], dense[kept] = w[:m] * by_text[kept], w[m:] * by_count[kept]
    return Model(present, dense, b, max(a, 1e-3), c)


def _score(model: Model, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = (model.present != 0) | (model.dense != 0)
        for b in batches:
            parts = []
            for row, end, data, offsets in chunks(b.column(text_col)):
                n, size, total = end - row, np.diff(offsets), np.zeros(end - row)
                for f, d in features(data, offsets):
                    held = used[f]
                    pairs, times = np.unique((d[held] << BITS) | f[held], return_counts=True)
                    doc, gram = pairs >> BITS, pairs & ((1 << BITS) - 1)
                    total += np.bincount(doc, model.present[gram] + model.dense[gram] * density(times, size[doc]), minlength=n)
                parts.append(total)
            margin = np.concatenate(parts) + model.intercept if parts else np.zeros(0)
            score = linear.sigmoid(model.a * margin + model.b)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(score), pa.array((score >= POSITIVE_FROM).astype(np.int32))], [*columns, "score", "predicted"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score, the calibrated chance of the label, and predicted (score >= 0.7). Null is an empty text and has a score too."""
    df = without(df, "score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double, predicted int"
    return df.mapInArrow(_score(model, text_col, df.columns), schema)


def held_out() -> Column:
    """Whether labels of this doc_id stay unseen: its checksum's remainder is 1. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text) and labels(doc_id, toxic)."""
    model = fit(documents, labels.where(~held_out()))
    return score(documents.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
