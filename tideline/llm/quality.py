"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The content view sees hashed n-grams of the text; the metadata view sees language, source,
size and the page's layout (lines, character classes), never the n-grams. In each round each
view scores all documents outside the labelled sample and labels those that it is surest of for
the other.
The labelled sample is held by the driver; the gradients of all documents with pseudo-labels
are summed over tasks. Both views are calibrated on labelled rows that neither has seen, and
their calibrated log odds are added, weighted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from ._state import forget, one_each, without, written
from ._text import chunks

#: Labelled rows that are fitted on at most. All other documents take part as unlabelled ones.
LABELLED = 3_000
#: Rounds of exchange, and pseudo-labels of a class that a view gives in one, as a share of the unlabelled rows.
ROUNDS, SHARE, SURE = 3, 0.08, 0.9
#: Weight of a pseudo-label, and of all that a view is told at most, as a share of the labelled rows.
PSEUDO = 0.5
#: Margins are counted in bins of 1 / BINS to find the cuts.
BINS = 256
#: Passes over the documents with pseudo-labels in a round.
PASSES = 14
CONTENT, METADATA, GRAM = 2048, 128, 4
L2 = 1e-4
ACCEPT_FROM = 0.5


def _content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of n-gram counts in CONTENT buckets."""
    n, count = len(offsets) - 1, max(len(data) - GRAM + 1, 0)
    code = np.zeros(count, np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | data[j : j + count]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    inside = owner[:count] == owner[GRAM - 1 :] if count else np.zeros(0, bool)
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
    x = np.sqrt(np.bincount((owner[:count] * CONTENT + bucket)[inside], minlength=n * CONTENT).reshape(n, CONTENT)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


CLASSES = np.zeros(256, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 4
CLASSES[[32, 9, 13]] = 5
CLASSES[10] = 6
CLASSES[[33, 44, 46, 63, 39, 34, 45, 58, 59, 40, 41]] = 7


def _metadata(data: np.ndarray, offsets: np.ndarray, lang: list, source: list) -> np.ndarray:
    """Shares of character classes, sizes of text and lines, and hashed language and source."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 8 + CLASSES[data], minlength=n * 8).reshape(n, 8)
    x = np.zeros((n, METADATA), np.float32)
    x[:, :8] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    lines = kinds[:, 6] + 1
    x[:, 8] = np.log1p(size) / 10
    x[:, 9] = np.log1p(lines) / 6
    x[:, 10] = np.log1p(size / lines) / 10
    x[:, 11] = size < 200
    for d in range(n):
        x[d, 12 + zlib.crc32(f"lang {lang[d]}".encode()) % 16] = 0.3
        x[d, 28 + zlib.crc32(f"source {source[d]}".encode()) % 100] = 0.3
    return x


def _views(text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source, out = b.column("lang").to_pylist(), b.column("source").to_pylist(), ([], [])
            for row, end, data, offsets in chunks(b.column(text_col)):
                out[0].extend(v.astype(np.float16).tobytes() for v in _content(data, offsets))
                out[1].extend(v.astype(np.float16).tobytes() for v in _metadata(data, offsets, lang[row:end], source[row:end]))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(o, pa.binary()) for o in out], [*columns, "content", "metadata"])

    return run


@dataclass
class Model:
    content: np.ndarray
    content_bias: float
    metadata: np.ndarray
    metadata_bias: float
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        (a1, b1), (a2, b2) = self.calibration
        one = a1 * (content @ self.content + self.content_bias) + b1
        two = a2 * (metadata @ self.metadata + self.metadata_bias) + b2
        return linear.sigmoid(self.mix[0] * one + self.mix[1] * two)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    return linear.logistic(lambda w: x @ w.astype(np.float32), lambda e: e.astype(np.float32) @ x, x.shape[1], y, weight, l2=L2, steps=150, rate=0.1)


def _halved(view: np.ndarray) -> np.ndarray:
    return view.astype(np.float16).astype(np.float32)


#: Weights and intercept of each view, and for each view the margin from which it is sure of 1, and that below which it is sure of 0.
Round = tuple[list[tuple[np.ndarray, float]], list[tuple[float, float]]]


def _told(history: list[Round], views: list[np.ndarray]) -> list[np.ndarray]:
    """What each view has been told by the other in all rounds: 1, 0, or -1 for nothing."""
    told = [np.full(len(views[0]), -1, np.int32) for _ in views]
    for models, cuts in history:
        for k, (x, (w, b), (high, low)) in enumerate(zip(views, models, cuts, strict=True)):
            margin = x @ w.astype(np.float32) + b
            told[1 - k][margin >= high] = 1
            told[1 - k][margin < low] = 0
    return told


def _each(text_col: str, rows):
    """Record batches of rows(views) for each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for row, end, data, offsets in chunks(b.column(text_col)):
                yield rows([_halved(_content(data, offsets)), _halved(_metadata(data, offsets, lang[row:end], source[row:end]))])

    return run


def _margins(models: list[tuple[np.ndarray, float]]):
    def rows(views: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((x @ w.astype(np.float32) + b).astype(float)) for x, (w, b) in zip(views, models, strict=True)], ["m0", "m1"])

    return rows


def _taught(history: list[Round]):
    def rows(views: list[np.ndarray]) -> pa.RecordBatch:
        told = _told(history, views)
        at = np.flatnonzero((told[0] >= 0) | (told[1] >= 0))
        packed = [pa.array([v.tobytes() for v in x[at].astype(np.float16)], pa.binary()) for x in views]
        return pa.RecordBatch.from_arrays([*[pa.array(t[at]) for t in told], *packed], ["told0", "told1", "content", "metadata"])

    return rows


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, wb: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted logistic loss at wb (weights, then intercept), and its gradient."""
    margin = x @ wb[:-1].astype(np.float32) + wb[-1]
    e = weight * (linear.sigmoid(margin) - y)
    return float((weight * (np.logaddexp(0, margin) - y * margin)).sum()), np.append(e.astype(np.float32) @ x, e.sum())


def _sums(at: list[np.ndarray], by_class: list[tuple[float, float]]):
    """One row a task and view: loss and gradient of its documents with pseudo-labels at `at`; by_class: weights of a 0 and a 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = [0.0, 0.0], [np.zeros(len(a)) for a in at]
        for b in batches:
            for k, c in enumerate(("content", "metadata")):
                told = b.column(f"told{k}").to_numpy()
                own = np.flatnonzero(told >= 0)
                for part in np.array_split(own, len(own) // 2000 + 1):
                    if len(part):
                        x = np.frombuffer(b"".join(b.column(c).take(pa.array(part)).to_pylist()), np.float16).reshape(len(part), -1).astype(np.float32)
                        more, g = _loss(x, told[part], np.array(by_class[k])[told[part]], at[k])
                        loss[k] += more
                        gradient[k] += g
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(loss), pa.array([g.tobytes() for g in gradient], pa.binary())], ["view", "loss", "gradient"])

    return run


def _cuts(pool: DataFrame) -> tuple[int, list[tuple[float, float]]]:
    """Number of rows of pool(m0, m1), and for each view the margins beyond which it labels: SHARE of all rows for each class (to a bin), those it is SURE of."""
    bin_ = lambda m: F.floor(F.greatest(F.least(F.col(m), F.lit(1000.0)), F.lit(-1000.0)) * BINS)
    both = pool.select(F.explode(F.array(*[F.struct(F.lit(k).alias("view"), bin_(f"m{k}").alias("bin")) for k in (0, 1)])).alias("b"))
    got = both.groupBy("b.view", "b.bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin")
    n, sure, cuts = int(got.n[got["view"] == 0].sum()), np.log(SURE / (1 - SURE)), []
    for k in (0, 1):
        own = got[got["view"] == k]
        bins, count, wanted = own.bin.to_numpy(), own.n.to_numpy(), max(1, int(SHARE * n))
        if len(bins):
            high = bins[::-1][np.searchsorted(np.cumsum(count[::-1]), wanted)] / BINS
            low = (bins[np.searchsorted(np.cumsum(count), wanted)] + 1) / BINS
            cuts.append((max(high, sure), min(low, -sure)))
    return n, cuts


def _refit(taught: DataFrame, models: list[tuple[np.ndarray, float]], views: list[np.ndarray], y: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Both views' models fitted to the labelled rows and all of taught, from where they stand."""
    counts = {(r["view"], r["told"]): r["n"] for r in taught.select(F.explode(F.array(*[F.struct(F.lit(k).alias("view"), F.col(f"told{k}").alias("told")) for k in (0, 1)])).alias("t")).groupBy("t.view", "t.told").agg(F.count("*").alias("n")).collect()}
    labelled, by_class = [], []
    for k in (0, 1):
        n = [counts.get((k, value), 0) for value in (0, 1)]
        each = min(PSEUDO, PSEUDO * len(y) / max(sum(n), 1))
        mass = [(y == value).sum() + each * n[value] for value in (0, 1)]
        # Classes weigh the same; all weights add up to one.
        share = [0.5 / max(m, 1e-9) for m in mass]
        labelled.append(np.where(y == 1, share[1], share[0]))
        by_class.append((each * share[0], each * share[1]))
    runs = [linear.descent(np.append(w, b), PASSES) for w, b in models]
    at = [next(r) for r in runs]
    best = list(at)
    for _ in range(PASSES):
        rows = taught.mapInArrow(_sums(at, by_class), "view int, loss double, gradient binary").collect()
        for k, run in enumerate(runs):
            loss, g = _loss(views[k], y, labelled[k], at[k])
            loss += sum(r["loss"] for r in rows if r["view"] == k) + 0.5 * L2 * float(at[k][:-1] @ at[k][:-1])
            g = g + sum((np.frombuffer(r["gradient"]) for r in rows if r["view"] == k), np.append(L2 * at[k][:-1], 0.0))
            at[k], best[k] = run.send((loss, g))
    return [(b[:-1], float(b[-1])) for b in best]


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", labelled: int = LABELLED) -> Model:
    """Co-train on at most `labelled` rows of labels(doc_id, <label>), those whose ids hash lowest, and all other documents(doc_id, lang, source, text).

    Null ids and labels are left out of the labelled rows; an id with several labels takes the lowest, and one with several rows its least. Documents with a null id are unlabelled,
    and so are those whose labels are beyond the bound.
    Without labels of both classes every document gets the same score, 1 if any is good.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("__y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select(F.col("doc_id").alias("__id"), "__y")
    sample = written(chosen, "quality-sample")  # bounded, so it can be broadcast
    held = one_each(documents.select("doc_id", "lang", "source", text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("__id", "__y", "lang", "source", text_col), "__id")
    got = held.mapInArrow(_views(text_col, ["__id", "__y"]), f"__id {documents.schema['doc_id'].dataType.simpleString()}, __y int, content binary, metadata binary").toPandas()
    got = got.sort_values("__id", kind="stable")
    y = got["__y"].to_numpy()
    views = [np.array([np.frombuffer(v, np.float16) for v in got[c]], np.float32).reshape(len(y), k) for c, k in (("content", CONTENT), ("metadata", METADATA))]
    if len(np.unique(y)) < 2:
        flat = 20.0 if not len(y) or y.max() > 0 else -20.0
        return Model(np.zeros(CONTENT, np.float32), flat, np.zeros(METADATA, np.float32), flat, ((1.0, 0.0), (1.0, 0.0)), (1.0, 0.0))
    known = np.arange(len(y))
    held_back, train = known[known % 4 == 0], known[known % 4 > 0]
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held_back])) < 2:
        held_back = train = known
    own, mine = [x[train] for x in views], y[train]
    balanced = np.where(mine == 1, 0.5 / mine.mean(), 0.5 / (1 - mine.mean()))
    models = [_train(x, mine.astype(float), balanced) for x in own]
    # The sample is bounded and so always broadcast: neither texts nor views are shuffled, at any size.
    pool = documents.select("doc_id", "lang", "source", text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left_anti").drop("doc_id")
    free = lambda fn, schema: pool.mapInArrow(_each(text_col, fn), schema)
    history: list[Round] = []
    for _ in range(ROUNDS):
        n, cuts = _cuts(free(_margins(models), "m0 double, m1 double"))
        if not n:
            break
        history.append((models, cuts))
        taught = written(free(_taught(history), "told0 int, told1 int, content binary, metadata binary"), "quality-taught")
        models = _refit(taught, models, own, mine)
        forget(taught)
    margins = [v[held_back] @ w.astype(np.float32) + b for v, (w, b) in zip(views, models, strict=True)]
    fits = tuple(linear.platt(m, y[held_back]) for m in margins)
    odds = [np.clip(a * m + b, -8, 8) for m, (a, b) in zip(margins, fits, strict=True)]
    # Views weigh as their calibrated log-likelihood gains over the prior.
    prior = np.clip(y[held_back].mean(), 1e-3, 1 - 1e-3)
    base = -(prior * np.log(prior) + (1 - prior) * np.log(1 - prior))
    gain = [max(base + np.mean(np.where(y[held_back] == 1, np.log(linear.sigmoid(o)), np.log(linear.sigmoid(-o)))), 0.0) for o in odds]
    total = sum(gain) or 1.0
    return Model(models[0][0].astype(np.float32), models[0][1], models[1][0].astype(np.float32), models[1][1], fits, (gain[0] / total, gain[1] / total) if sum(gain) else (0.5, 0.5))


def _score(model: Model, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source, parts = b.column("lang").to_pylist(), b.column("source").to_pylist(), []
            for row, end, data, offsets in chunks(b.column(text_col)):
                # As in the fit, views pass through half precision.
                content = _content(data, offsets).astype(np.float16).astype(np.float32)
                meta = _metadata(data, offsets, lang[row:end], source[row:end]).astype(np.float16).astype(np.float32)
                parts.append(model.score(content, meta).astype(float))
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(score), pa.array(score >= ACCEPT_FROM)], [*columns, "quality_score", "accepted"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df(lang, source, text, ...) with quality_score (0 to 1) and accepted (score >= 0.5). Null texts are empty, null lang and source are values of their own."""
    df = without(df, "quality_score", "accepted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", quality_score double, accepted boolean"
    return df.mapInArrow(_score(model, text_col, df.columns), schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score and accepted for every row of documents(doc_id, lang, source, text)."""
    docs = documents.select("doc_id", "lang", "source", "text")
    return score(docs, fit(docs, labels)).select("doc_id", "quality_score", "accepted")
