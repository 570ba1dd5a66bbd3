"""Near-duplicate documents by DartMinHash signatures of weighted shingles, banded, and verified exactly.

Darts fall on the plane of weight and rank of each element, one for each unit of area on
average, at places that hashes of the element fix. A document is hit by the darts below the
weights of its elements. Each dart belongs to one coordinate of the signature; the dart of
least rank that hits is the coordinate's value. Two documents agree in a coordinate with the
chance of their weighted Jaccard similarity (sum of least over sum of greatest weights).
The area is cut into dyadic regions of weight and rank, so only few darts that miss are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import Marks, forget, small_side, written
from ._text import U64, chunks, draws, mix, windows, words
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8, some band of 5 in 32 agrees with a chance of 0.999997.
BANDS, ROWS = 32, 5
#: Height of the lowest rank region.
UNIT = 1 / 16
#: Bytes of text that are signed at once: a dart takes several numbers.
SIGN_BYTES = 1 << 18
#: Members of a bucket whose pairs are compared one by one.
SMALL = 8
#: Comparisons with one document that go to a task at most, about.
PART = 1000
#: Elements whose counts are held by every task: a limit on memory, not on what is found.
ORDERED = 100_000


def _poisson(levels: int = 26) -> list[np.ndarray]:
    """Cumulative chances of 0, 1, ... darts in a region of area UNIT * 2**level, as 53-bit fractions."""
    out = []
    for level in range(levels):
        mean = UNIT * 2.0**level
        k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
        logs = k * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(k))))))
        out.append(np.cumsum(np.exp(logs)))
    return out


CHANCES = _poisson(20)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(document, coordinate, rank, dart) of the darts that hit, up to each document's rank limit."""
    out: list[tuple[np.ndarray, ...]] = []
    v = 0
    while len(own := np.flatnonzero(weight > 2.0**v - 1)):
        r = 0
        while len(own := own[limit[doc[own]] > UNIT * (2.0**r - 1)]):
            region = mix(element[own] ^ mix(np.array([(v << 8) | r], U64)))
            level = min(v + r, len(CHANCES) - 1)
            split = 2 ** (v + r - level)  # regions beyond the table are drawn in equal parts
            for part in range(split):
                seed = mix(region + U64(part))
                n = np.searchsorted(CHANCES[level], _unit(seed), "right")
                who = np.repeat(np.arange(len(own)), n)
                if not len(who):
                    continue
                j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(seed[who] + (j.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
                rank = UNIT * ((2.0**r - 1) + 2.0**r * (part + _unit(mix(dart ^ U64(0x5851F42D4C957F2D)))) / split)
                high = (2.0**v - 1) + 2.0**v * _unit(mix(dart ^ U64(0x14057B7EF767814F)))
                e = own[who]
                hit = (high < weight[e]) & (rank < limit[doc[e]])
                dart = dart[hit]
                out.append((doc[e[hit]], (mix(dart ^ U64(0x2545F4914F6CDD1D)) % U64(k)).astype(np.int64), rank[hit], dart))
            r += 1
        v += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k dart ids for each of n documents; of zeros for those without elements. Elements of a document differ.

    A first throw is so high that k ln k + 2 k darts hit on average. Documents with an empty coordinate throw twice
    as high, again and again; the darts of least rank don't depend on how high was thrown.
    """
    out = np.zeros((n, k), U64)
    total = np.bincount(doc, weight, minlength=n)
    open_ = np.flatnonzero(total > 0)
    height = k * np.log(k) + 2 * k
    while len(open_):
        mine = np.zeros(n, bool)
        mine[open_] = True
        held = mine[doc]
        limit = np.zeros(n)
        limit[open_] = height / total[open_]
        d, c, rank, dart = _throw(element[held], weight[held], doc[held], limit, k)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, d * k + c, rank)
        first = best[d * k + c] == rank
        flat = out.reshape(-1)
        flat[(d * k + c)[first]] = dart[first]
        open_ = open_[np.isinf(best.reshape(n, k)[open_]).any(axis=1)]
        height *= 2
    return out


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, number of its text) of the different shingles of each text, by text, then hash. A-Z read as a-z; a shorter text is one shingle."""
    w = words(data, offsets, lower=True)
    h, at = windows(w, size, short=True)
    doc = w.doc()[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return h[first], np.diff(np.concatenate((first, [len(h)]))), doc[first]


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows) * (draws(rows, 11) | U64(1))
    return mix(parts.sum(axis=2, dtype=U64) ^ draws(bands, 12))


def elements(h: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element, document), by document, then element: a shingle held c times is c different elements, so weighted Jaccard is that of sets."""
    at = np.cumsum(count) - count
    turn = (np.arange(int(count.sum())) - np.repeat(at, count)).astype(U64)
    h, doc = np.repeat(h, count), np.repeat(doc, count)
    e = np.where(turn > 0, mix(h ^ mix(turn)), h)
    order = np.lexsort((e, doc))
    return e[order], doc[order]


def _sign(text_col: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            weights: list[np.ndarray] = [np.zeros(0, np.int64)]
            for row, end, data, offsets in chunks(b.column(text_col), SIGN_BYTES):
                h, count, doc = weighted_shingles(data, offsets, size)
                bands = band_hashes(signatures(h, count.astype(float), doc, end - row))
                weight = np.bincount(doc, count, minlength=end - row).astype(np.int64)
                out += [x.tobytes() if w else None for x, w in zip(bands, weight, strict=True)]
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(np.concatenate(weights)), pa.array(out, pa.binary())], ["doc_id", "node", "weight", "bands"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each node."""
    for b in batches:
        bands = np.frombuffer(b"".join(b.column("bands").to_pylist()), U64)
        own = [pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), BANDS)) for c in ("node", "weight")]
        yield pa.RecordBatch.from_arrays([pa.array(bands.view(np.int64)), *own], ["bucket", "node", "weight"])


def _element_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in chunks(b.column("text")):
                e, doc = elements(*weighted_shingles(data, offsets, size))
                cut = np.searchsorted(doc, np.arange(end - row + 1))
                sets = [e[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(row, end - row), pa.array(np.diff(cut)), pa.array(sets, pa.binary())], ["node", "weight", "elements"])

    return run


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), U64) for x in column)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, which are arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(len(both) - shared, 1)


def _compare(least: float):
    """Rows come by (b, part), first the set of b itself (where a is null), then the sets to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, U64)
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            heads = batch.column("a").is_null().to_numpy(zero_copy_only=False)
            for k, own in enumerate(_sets(batch.column("elements"))):
                if heads[k]:
                    head = own.copy()
                else:
                    ok[k] = similarity(own, head) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The different pairs(a, b) of nodes whose sets(node, elements) are similar.

    The set of b goes once to each group of about PART of its pairs, however many these are, and is met there in passing.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
    head = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    other = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), "parts").alias("part"), "a")
    wanted = written(head.select("b", "part", F.lit(None).cast("long").alias("a")).union(other), "minhash-places")
    both = small_side(wanted).withColumn("node", F.coalesce("a", "b")).join(sets.select("node", "elements"), "node").select("b", "part", "a", "elements")
    met = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return met.mapInArrow(_compare(least), "a bigint, b bigint")


def _pieces(parts: Iterator[tuple[np.ndarray, ...]], most: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns joined into pieces of about `most` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _listed(key: str):
    """(key, element) for each element of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            each = ((np.full(len(e), k, np.int64), e) for k, e in zip(keys, _sets(b.column("elements")), strict=True))
            for k, e in _pieces(each):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(e.view(np.int64))], [key, "element"])

    return run


class Common:
    """Counts of the most common elements by group, and the core of each group: the elements that more than half of its members hold.

    Only speed depends on which elements are listed. What is exact holds for any core and any order of elements.
    """

    def __init__(self, group: np.ndarray, element: np.ndarray, count: np.ndarray, members: np.ndarray) -> None:
        key = self.key(group, element.view(U64))
        order = np.argsort(key)
        self.keys, self.counts = key[order], count[order]
        half = count * 2 > members
        own = np.lexsort((element[half].view(U64), group[half]))
        self.core_group, self.core = group[half][own], element[half].view(U64)[own]

    @staticmethod
    def key(group: np.ndarray, element: np.ndarray) -> np.ndarray:
        return mix(element ^ mix(group.view(U64)))

    def differing(self, group: int, own: np.ndarray) -> np.ndarray:
        """The elements in which a set differs from the core of its group."""
        i, j = np.searchsorted(self.core_group, [group, group], "left")[0], np.searchsorted(self.core_group, group, "right")
        return np.setxor1d(own, self.core[i:j], assume_unique=True) if j > i else own

    def rarest_first(self, group: int, own: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return own
        key = self.key(np.full(len(own), group, np.int64), own)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return own[np.lexsort((own, np.where(self.keys[at] == key, self.counts[at], 0)))]


def _distances(common: Common):
    """apart: the number of elements in which a member differs from its group's core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column("group").to_numpy(zero_copy_only=False)
            apart = [len(common.differing(g, e)) for g, e in zip(groups, _sets(b.column("elements")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group", "node", "weight")), pa.array(np.array(apart, np.int64))], ["group", "node", "weight", "apart"])

    return run


def _prefixes(common: Common, least: float):
    """The rarest elements in which a member differs from the core, as many as a similar member may lack, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "node", "label", "weight")]

            def each() -> Iterator[tuple[np.ndarray, ...]]:
                for g, node, label, weight, own in zip(*columns, _sets(b.column("elements")), strict=True):
                    d = common.differing(g, own)
                    e = common.rarest_first(g, d)[: int(weight * (1 - least) / least + 1e-6) + 1]
                    yield (e.view(np.int64), np.arange(len(e)), *(np.full(len(e), x, np.int64) for x in (g, node, label, weight, len(d))))

            for piece in _pieces(each()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in piece], ["element", "at", "group", "node", "label", "weight", "apart"])

    return run


def _most_common(counts: DataFrame, group_sizes: DataFrame) -> Common:
    """The counts(group, element, n) of ORDERED elements at most, those at or above a power of two."""
    levels = sorted(counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    held, least = 0, 64
    for r in levels:
        if (held := held + r.n) > ORDERED:
            break
        least = r.level
    rows = counts.where(F.col("n") >= 2**least).join(group_sizes, "group").select("group", "element", "n", "members").toPandas() if least < 64 else None
    if rows is None:
        none = np.zeros(0, np.int64)
        return Common(none, none, none, none)
    return Common(*(rows[c].to_numpy(np.int64) for c in ("group", "element", "n", "members")))


def _several(rows: DataFrame, name: str) -> DataFrame:
    """Of rows(bucket, node, label), those of buckets with two labels or more; and low, the least label there."""
    labels = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "low")
    return written(rows.join(labels, "bucket"), name)


def _large_buckets(rows: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame | None, least: float) -> DataFrame | None:
    """All links within large buckets between nodes that links do not join yet; None if there are none to look for.

    Nodes are left out if more of their elements than similar sets may lack stand in no other node. What is left is
    grouped, so that nodes that share a bucket are in one group. Two similar sets differ in few elements, so each differs
    from the group's core in nearly the same elements, or both hardly differ from it: then the member that is next to the
    core is similar to both. Else the rarest elements in which they differ from the core have one in common; pairs are
    looked up by it, and by how far it stands from the front.
    """
    open_ = _several(_labelled(rows, labels).select("bucket", "node", "label"), "minhash-open")
    if open_.isEmpty():
        return None
    lacks = (1 - least) / (1 + least)  # Similar sets differ in at most this share of their sizes' sum.
    own = written(open_.select("node", "label").distinct().join(sets, "node"), "minhash-members")
    single = own.mapInArrow(_listed("node"), "node bigint, element bigint").groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    single = single.groupBy("node").agg(F.count("*").alias("single"))
    kept = own.select("node", "weight").join(single, "node", "left").where(F.coalesce("single", F.lit(0)) <= F.col("weight") * (1 - least) + 1e-6)
    open_ = _several(open_.select("bucket", "node", "label").join(written(kept.select("node"), "minhash-kept"), "node"), "minhash-open")
    if open_.isEmpty():
        return None
    groups = components(open_.select(F.col("label").alias("a"), F.col("low").alias("b")).distinct())
    groups = groups.select(F.col("node").alias("label"), F.col("label").alias("group"))
    members = written(own.join(open_.select("node").distinct(), "node", "left_semi").join(groups, "label").select("group", "node", "label", "weight", "elements"), "minhash-members")
    group_sizes = members.groupBy("group").agg(F.count("*").alias("members"))
    counts = members.mapInArrow(_listed("group"), "group bigint, element bigint").groupBy("group", "element").agg(F.count("*").alias("n")).where("n > 1")
    common = _most_common(written(counts, "minhash-counts"), group_sizes)
    if len(common.core):
        far = written(members.select("group", "node", "weight", "elements").mapInArrow(_distances(common), "group bigint, node bigint, weight bigint, apart bigint"), "minhash-apart")
        excess = F.col("apart") - F.col("weight") * lacks
        nearest = far.groupBy("group").agg(F.min(F.struct(excess.alias("excess"), F.col("node").alias("next"))).alias("m")).select("group", "m.*")
        star = far.join(nearest, "group").where((excess + F.col("excess") <= 1e-6) & (F.col("node") != F.col("next"))).select(F.col("node").alias("a"), F.col("next").alias("b"))
        near = written(_linked(written(star, "minhash-pairs"), sets, least), "minhash-links")
        links = links.unionByName(near)
        # Those next to the core get its label; others of their classes keep theirs, which costs comparisons only.
        ends = near.select(F.col("a").alias("node"), F.col("b").alias("label")).union(near.select("b", "b")).distinct()
        ends = ends.select("node", F.col("label").alias("end"))
        known = members.select("group", "node", "label").join(ends, "node", "left").select("group", "node", F.coalesce("end", "label").alias("label"))
        known = written(known, "minhash-known")
        split = known.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
        members = members.drop("group", "label").join(known.join(split, "group", "left_semi"), "node")
    front = written(members.mapInArrow(_prefixes(common, least), "element bigint, at bigint, group bigint, node bigint, label bigint, weight bigint, apart bigint"), "minhash-fronts")
    side = lambda x: front.select(*[F.col(c).alias(c if c in ("group", "element") else f"{x}_{c}") for c in front.columns])
    room = (F.col("a_weight") + F.col("b_weight")) * lacks + 1e-6
    more = F.col("a_apart") - F.col("b_apart")
    near = side("a").join(side("b").where(F.col("b_at") <= F.col("b_weight") * (1 - least) / least / 2 + 1e-6), ["group", "element"]).where(
        (F.col("a_label") != F.col("b_label"))
        & ((more > 0) | (more == 0) & (F.col("a_node") > F.col("b_node")))
        & (F.least("a_weight", "b_weight") >= F.greatest("a_weight", "b_weight") * least - 1e-6)
        & (F.col("a_at") * 2 <= room + more) & (F.col("b_at") * 2 <= room - more) & (F.col("a_at") + F.col("b_at") <= room)
        & (F.least(F.col("a_apart") - F.col("a_at"), F.col("b_apart") - F.col("b_at")) * 2 >= F.col("a_apart") + F.col("b_apart") - room)
    )
    pairs = written(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "minhash-pairs")
    if not pairs.isEmpty():
        links = links.unionByName(written(_linked(pairs, sets, least), "minhash-links"))
    return links


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows(node, ...) with a label: that of the node's component, or the node itself."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(df: DataFrame, text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, label, class_id) for each row of df(doc_id, text, ...). node is a hash of the text, label the least node of its class.

    class_id is the least doc_id of all documents that links of similarity >= `least` join, equal texts among them.
    Shingles are weighted by how often the text holds them. Texts without a word (null, empty, blank) are equal only to
    texts that are the same, null being empty. A null doc_id is a document too, but the least id only where all are null.

    Equal texts are joined first. Every document is then compared with the least one of all its buckets; in buckets of
    SMALL documents at most, all pairs that are not joined yet are compared; larger ones go by the rare elements of their
    documents (_large_buckets). Each step leaves out pairs that are joined, or can't be similar, and no others.
    """
    docs = df.select("doc_id", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    signed = written(docs.mapInArrow(_sign("text", size), f"doc_id {kind}, node bigint, weight bigint, bands binary"), "minhash-signed")
    nodes = written(signed.groupBy("node", "weight", "bands").agg(F.min("doc_id").alias("rep")), "minhash-nodes")
    rows = nodes.where("bands is not null").select("node", "weight", "bands").mapInArrow(_buckets, "bucket bigint, node bigint, weight bigint")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    # Only buckets of several nodes go on.
    rows = written(rows.join(shared, "bucket").select("bucket", "node", "weight", "head", "n"), "minhash-rows")
    wanted = written(rows.select("node").distinct(), "minhash-wanted")
    # Texts of other nodes are not shuffled, whatever the number of those that are wanted.
    marks = Marks(wanted, "node", wanted.count(), "minhash-marks")
    texts = marks.split(docs.select("node", "text"), "node", True).dropDuplicates(["node"]).join(small_side(wanted), "node", "left_semi")
    sets = written(texts.select("node", "text").mapInArrow(_element_sets(size), "node bigint, weight bigint, elements binary"), "minhash-sets")
    forget(marks.table)
    forget(wanted)

    first = written(rows.groupBy("node").agg(F.min("head").alias("head")).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), "minhash-pairs")
    links = written(_linked(first, sets, least), "minhash-links")
    # Each node has one link at most yet: its end is a label that only nodes of one class have.
    hop = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    few = written(_labelled(rows.where(F.col("n") <= SMALL).select("bucket", "node", "weight"), hop), "minhash-few")
    other = few.select("bucket", F.col("node").alias("other"), F.col("weight").alias("other_weight"), F.col("label").alias("other_label"))
    alike = F.least("weight", "other_weight") >= F.greatest("weight", "other_weight") * least - 1e-6
    pairs = few.join(other, "bucket").where((F.col("label") != F.col("other_label")) & (F.col("node") > F.col("other")) & alike)
    pairs = written(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "minhash-pairs")
    if not pairs.isEmpty():
        links = links.unionByName(written(_linked(pairs, sets, least), "minhash-links"))
    forget(few)
    labels = components(links)
    more = _large_buckets(rows.where(F.col("n") > SMALL).select("bucket", "node"), sets, links, labels, least)
    if more is not None:
        labels = components(more)
    classes = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    names = classes.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = written(classes.join(names, "label").select("node", "label", "class_id"), "minhash-classes")
    for spent in (nodes, rows, sets):
        forget(spent)
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "node", "label", "class_id")


def keep_one(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of df(doc_id, text, ...) for each class: of least doc_id (null where all are), then of least node; any one of rows that share both."""
    every = near_duplicates(df, text_col)
    found = every.groupBy("label", "doc_id", "node").agg(F.count("*").alias("times"))
    # Structs compare field by field, so a null id comes after all others. A node has one label: no two classes choose the same (doc_id, node).
    first = F.min_by(F.struct("doc_id", "node", "times"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("c")
    chosen = found.groupBy("label").agg(first, F.sum("times").alias("members"))
    chosen = written(chosen.select("label", F.col("c.doc_id").alias("__id"), F.col("c.node").alias("__node"), F.col("c.times").alias("__times"), "members"), "minhash-chosen")
    shared = written(every.join(chosen.where("members > 1").select("label"), "label", "left_semi").select("node").distinct(), "minhash-shared")
    marks = Marks(shared, "node", shared.count(), "minhash-marks")
    some = written(marks.split(chosen, "__node", True).select("__id", "__node", "__times"), "minhash-kept")
    for spent in (every, chosen, shared):
        forget(spent)
    # Documents alone in their classes stay where they are, whatever the number of classes; only the others are joined.
    rows = df.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    alone = marks.split(rows, "__own", False).drop("__own")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__node") == F.col("__own"))
    kept = marks.split(rows, "__own", True).join(small_side(some), same).drop("__id", "__own")
    if some.where("__times > 1").isEmpty():
        return alone.unionByName(kept.drop("__node", "__times"))
    once = kept.where("__times = 1")
    return alone.unionByName(once.unionByName(kept.where("__times > 1").dropDuplicates(["doc_id", "__node"])).drop("__node", "__times"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (its doc_id is the class's) for every row of documents(doc_id, text)."""
    found = near_duplicates(documents.select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
