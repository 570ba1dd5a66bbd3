"""Quality rules: fixed text statistics, and a hashed n-gram likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import small_side, without, written
from ._text import chunks, draws, mix, windows, words

#: Buckets of the two multinomials, bytes in an n-gram, and what is added to each bucket's count.
BUCKETS, GRAM, SMOOTH = 1 << 14, 4, 0.5
#: Least mean log-likelihood ratio for each n-gram of a document that is kept.
THRESHOLD = -0.5
#: Most labelled rows that the join broadcasts (9 bytes each).
LABEL_ROWS = 1_000_000
FEW_WORDS, REPEAT_PERCENT = 50, 50
# The characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its text) of each run of GRAM bytes in one text."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | data[j : j + n]
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    at = np.repeat(offsets[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return bucket[at].astype(np.int64), np.repeat(np.arange(len(counts)), counts)


def _count(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            trusted = np.asarray(b.column("__trusted").to_pylist(), bool)
            for row, end, data, offsets in chunks(b.column(text_col)):
                bucket, doc = gram_buckets(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[trusted[row:end][doc]], minlength=BUCKETS)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(raw[held]), pa.array(target[held])], ["bucket", "raw", "target"])

    return run


def log_ratios(df: DataFrame, trusted: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(p(bucket | trusted) / p(bucket | all)) over all rows of df. trusted: the doc_ids of trusted documents.

    BUCKETS numbers come to the driver, whatever the input's size. Without trusted text every ratio is 0.
    """
    mark = small_side(written(trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().withColumn("__trusted", F.lit(True)), "rules-trusted"), LABEL_ROWS)
    rows = df.select("doc_id", text_col).join(mark, F.col("doc_id") == F.col("__id"), "left").select(text_col, F.coalesce("__trusted", F.lit(False)).alias("__trusted"))
    counts = rows.mapInArrow(_count(text_col), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (target + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum())


def _lines_repeated(raw: bytes, start: np.ndarray) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def _measure(ratios: np.ndarray, threshold: float, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, _, data, offsets in chunks(b.column(text_col)):
                n = len(offsets) - 1
                w = words(data, offsets)
                doc = w.doc()
                n_words = np.diff(w.first)
                leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
                chars = np.bincount(doc, leads[w.end] - leads[w.start], minlength=n).astype(np.int64)
                symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
                h, at = windows(w, 3)
                wdoc = doc[at]
                key = mix(h ^ draws(n, 7)[wdoc])
                _, back, times = np.unique(key, return_inverse=True, return_counts=True)
                hit = at[times[back] > 1]
                mask = np.zeros(len(doc), bool)
                for j in range(3):
                    mask[hit + j] = True
                raw = data.tobytes()
                lines = [_lines_repeated(raw[i:j], w) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                bucket, gdoc = gram_buckets(data, offsets)
                grams = np.bincount(gdoc, minlength=n)
                score = np.bincount(gdoc, ratios[bucket], minlength=n) / np.maximum(grams, 1)
                parts.append((n_words, chars, np.diff(symbols[offsets]), np.array(lines, np.int64), np.bincount(doc[mask], minlength=n), score))
            n_words, chars, symbols, lines, repeats, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
            failed = (n_words < FEW_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
            made = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats}
            arrays = [b.column(c) for c in columns] + [pa.array(x.astype(np.int64)) for x in made.values()]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], [*columns, *made, "base_failed", "kept", "llr"])

    return run


def score(df: DataFrame, trusted: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df(doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr.

    llr is the mean log-likelihood ratio of the text's n-grams; kept needs the rules to pass and llr >= threshold.
    Null is an empty text; texts of under 50 words fail the rules. A text of fewer bytes than an n-gram has llr 0.
    """
    df = without(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double"
    return df.mapInArrow(_measure(log_ratios(df, trusted, text_col), threshold, text_col, df.columns), schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text); trusted are the documents that all their labels call good."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return score(documents.select("doc_id", "text"), good).drop("text")
