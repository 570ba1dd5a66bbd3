"""Repeated byte strings, decided by suffix arrays over shards that hold all texts which may share one.

A string of `length` bytes is anchored at the GRAM bytes in it whose hash is least, which depends
on the string alone. Strings with one anchor, side by side in a document, make a fragment. Only
anchors that occur twice or more matter; their fragments are dealt to shards by the anchor's hash,
so equal strings meet in one shard. There, equal fragments are joined, and a suffix array with its
common prefixes shows which strings of the others repeat. A group too large for one array is cut
into blocks whose sorted strings are merged by binary search. The most common anchors, HOT_LIST of them
at most, would load single shards: their strings meet by hash in packed references instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, suffixes
from ._state import without, written
from ._text import BYTES, U64, chunks, mix

LENGTH, GRAM = 200, 40
#: Bytes of one suffix array.
SHARD_BYTES = 1 << 20
#: Anchors with at least HOT_FROM places are hot; at most HOT_LIST, the most common, are treated so (8 bytes each).
HOT_FROM, HOT_LIST = 2_000, 100_000
#: A byte that UTF-8 never holds ends each fragment.
STOP = np.uint8(255)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


class Rolling:
    """Hashes of any range of some bytes, from sums of their prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, BASE, U64)
        power[0] = 1
        power = np.cumprod(power)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTES[data] * power[:n])))
        back = np.full(n + 1, INVERSE, U64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours in x (by van Herk's blocks of running minima)."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """(anchor's hash, its place, first and last start of its strings, number of the text) of each fragment in some texts."""
    n, width = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U64), none, none, none, none
    start = np.arange(n - GRAM + 1)
    gram = roll.of(start, start + GRAM)
    bits = U64(max(n, 2).bit_length())
    low = (U64(1) << bits) - U64(1)
    # The place in the low bits: the leftmost of equal grams is the anchor.
    anchor = (least((gram & ~low) | start.astype(U64), width) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(anchor)] == doc[length - 1 : length - 1 + len(anchor)]
    begin = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])))
    s1 = np.flatnonzero(begin)
    s2 = np.concatenate((s1[1:], [len(anchor)])) - 1
    kept = inside[s1]
    s1, s2 = s1[kept], s2[kept]
    return gram[anchor[s1]], anchor[s1], s1, s2, doc[s1]


def _anchors(length: int, text_col: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = repeats.Gather(n_buckets)
        for b in batches:
            keys = b.column("__key").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in chunks(b.column(text_col)):
                h, at, _, _, doc = fragments(data, offsets, length, Rolling(data))
                yield from out.add(h, keys[row:end][doc], at - offsets[doc])
        yield from out.flush()

    return run


FRAGMENT = "shard int, hash bigint, __key bigint, start int, fragment binary, places binary"


def _chosen(b: pa.RecordBatch, text_col: str, length: int) -> Iterator[tuple]:
    """Fragments of the repeated anchors in each chunk of a batch."""
    keys, found = b.column("__key").to_numpy(zero_copy_only=False), b.column("__places").to_pylist()
    for row, end, data, offsets in chunks(b.column(text_col)):
        roll = Rolling(data)
        h, at, s1, s2, doc = fragments(data, offsets, length, roll)
        wanted = np.concatenate([repeats.positions(found[row + d]) + offsets[d] for d in range(end - row)] or [np.zeros(0, np.int64)])
        kept = np.isin(at, wanted)
        yield data, offsets, roll, h[kept], s1[kept], s2[kept], doc[kept], keys[row:end]


def _deal(length: int, text_col: str, n_shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: list[tuple] = []
            for data, offsets, roll, h, s1, s2, doc, keys in _chosen(b, text_col, length):
                cold = ~np.isin(h.view(np.int64), hot)
                h, s1, s2, doc = h[cold], s1[cold], s2[cold], doc[cold]
                raw = data.tobytes()
                whole = roll.of(s1, s2 + length) ^ (s2 - s1).astype(U64)
                seen.append((h, whole, keys[doc], s1 - offsets[doc], s2 - s1, [raw[i:j] for i, j in zip(s1.tolist(), (s2 + length).tolist(), strict=True)]))
            if not seen:
                continue
            h, whole, key, start, last = (np.concatenate([x[k] for x in seen]) for k in range(5))
            text = [t for x in seen for t in x[5]]
            # Equal fragments in a batch are known to repeat; one of them still goes to the shard, without a key's place.
            order = np.argsort(whole, kind="stable")
            at, size = repeats.runs(whole[order])
            single, many = order[at[size == 1]], order[np.repeat(size > 1, size)]
            witness = order[at[size > 1]]
            send = np.concatenate((single, witness))
            shard = ((h[send] >> U64(20)) % U64(n_shards)).astype(np.int32)
            starts = np.where(np.arange(len(send)) < len(single), start[send], -1).astype(np.int32)
            if len(send):
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h[send].view(np.int64)), pa.array(key[send]), pa.array(starts), pa.array([text[i] for i in send.tolist()], pa.binary()), pa.nulls(len(send), pa.binary())], FIELDS)
            if len(many):
                spans = np.column_stack((start[many], start[many] + last[many])).astype(np.int32)
                ks, spans, cut = _by_key(key[many], spans)
                n = len(cut) - 1
                shard = ((ks.view(np.uint64) >> U64(20)) % U64(n_shards)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.nulls(n, pa.int64()), pa.array(ks), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([spans[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], FIELDS)

    return run


FIELDS = ["shard", "hash", "__key", "start", "fragment", "places"]


def _by_key(key: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    order = np.argsort(key, kind="stable")
    at, _ = repeats.runs(key[order])
    return key[order][at], spans[order], [*at.tolist(), len(key)]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct fragments the starts in it whose string of `length` bytes starts at another place among them too.

    Blocks of SHARD_BYTES have an array each; the strings that each block holds once are then merged by binary search.
    """
    out, block, size, sorted_blocks = [np.zeros(0, np.int64)] * len(texts), [], 0, []
    flags = [np.zeros(max(len(t) - length + 1, 0), bool) for t in texts]

    def close() -> None:
        joined = np.frombuffer(b"".join(texts[i] + b"\xff" for i in block), np.uint8)
        sa, _ = suffixes.refine(joined)
        lcp = suffixes.kasai(joined, sa, length)
        tie = lcp >= length
        tied = tie | np.concatenate((tie[1:], [False]))
        hit = np.zeros(len(joined), bool)
        hit[sa[tied]] = True
        begin = np.cumsum([0, *[len(texts[i]) + 1 for i in block]])
        owner, at = np.full(len(joined), -1), np.zeros(len(joined), np.int64)
        for b, i in zip(begin, block, strict=False):
            n = len(flags[i])
            flags[i] |= hit[b : b + n]
            owner[b : b + n], at[b : b + n] = i, np.arange(n)
        if len(texts) > len(block):  # one string of each class, in order, for the other blocks
            heads = sa[~tie]
            heads = heads[owner[heads] >= 0]
            strings = np.array([joined[i : i + length].tobytes() for i in heads], f"S{length}")
            classes = np.cumsum(~tie) - 1
            members = sa[owner[sa] >= 0]
            sorted_blocks.append((strings, owner, at, heads, members, classes[owner[sa] >= 0]))

    for i in range(len(texts)):
        if block and size + len(texts[i]) + 1 > SHARD_BYTES:
            close()
            block, size = [], 0
        block.append(i)
        size += len(texts[i]) + 1
    if block:
        close()
    for x in range(len(sorted_blocks)):
        for y in range(x):
            for (_, owner, at, heads, members, classes), mask in zip((sorted_blocks[x], sorted_blocks[y]), suffixes.shared_between(sorted_blocks[x][0], sorted_blocks[y][0]), strict=True):
                place = np.full(len(owner), -1)
                place[members] = classes
                wanted = np.unique(place[heads[mask]])
                for p in members[np.isin(classes, wanted)]:
                    flags[owner[p]][at[p]] = True
    for i, f in enumerate(flags):
        out[i] = np.flatnonzero(f)
    return out


def _shard(length: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, starts, texts = [], [], [], []
        for b in batches:
            known = b.filter(b.column("places").is_valid())
            if len(known):
                spans = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in known.column("places").to_pylist()]
                yield from repeats.by_bucket(np.repeat(known.column("__key").to_numpy(zero_copy_only=False), [len(x) for x in spans]), np.concatenate(spans), n_buckets)
            sent = b.filter(b.column("places").is_null())
            hashes.append(sent.column("hash").to_numpy(zero_copy_only=False).astype(np.int64))
            keys.append(sent.column("__key").to_numpy(zero_copy_only=False).astype(np.int64))
            starts.append(sent.column("start").to_numpy(zero_copy_only=False).astype(np.int64))
            texts += sent.column("fragment").to_pylist()
        if not texts:
            return
        hashes, keys, starts = (np.concatenate(x) for x in (hashes, keys, starts))
        order = np.argsort(hashes, kind="stable")
        at, size = repeats.runs(hashes[order])
        hits: list[tuple] = []
        waiting: list[tuple[list[bytes], list[list[int]]]] = []
        held = 0

        def decide() -> None:
            flat = [t for g, _ in waiting for t in g]
            rows = [r for _, g in waiting for r in g]
            for text, members, found in zip(flat, rows, repeated_starts(flat, length), strict=True):
                del text
                if len(found):
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(found) > 1)))
                    spans = np.column_stack((found[cut], found[np.concatenate((cut[1:], [len(found)])) - 1]))
                    hits.extend((keys[m], starts[m] + s) for m in members if starts[m] >= 0 for s in [spans])

        for a, k in zip(at.tolist(), size.tolist(), strict=True):
            same: dict[bytes, list[int]] = {}
            for i in order[a : a + k].tolist():
                same.setdefault(texts[i], []).append(i)
            lone = {}
            for text, members in same.items():
                if len(members) > 1:  # all strings of equal fragments repeat
                    hits.extend((keys[m], np.array([[starts[m], starts[m] + len(text) - length]])) for m in members if starts[m] >= 0)
                lone[text] = members
            if len(lone) > 1:
                n = sum(len(t) + 1 for t in lone)
                if waiting and held + n > SHARD_BYTES:
                    decide()
                    waiting, held = [], 0
                waiting.append((list(lone), list(lone.values())))
                held += n
        if waiting:
            decide()
        if hits:
            key = np.concatenate([np.full(len(s), k, np.int64) for k, s in hits])
            yield from repeats.by_bucket(key, np.concatenate([s for _, s in hits]).astype(np.int32), n_buckets)

    return run


def _hot_strings(length: int, text_col: str, n_buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = repeats.Gather(n_buckets)
        for b in batches:
            for _, offsets, roll, h, s1, s2, doc, keys in _chosen(b, text_col, length):
                warm = np.isin(h.view(np.int64), hot)
                s1, s2, doc = s1[warm], s2[warm], doc[warm]
                n = s2 - s1 + 1
                at = np.repeat(s1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                d = np.repeat(doc, n)
                yield from out.add(roll.of(at, at + length), keys[d], at - offsets[d])
        yield from out.flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, number of places) for the hashes of packed references, so far as one task sees them."""
    for b in batches:
        search = [np.frombuffer(x, repeats.REF) for x, k in zip(b.column("refs").to_pylist(), b.column("known").to_pylist(), strict=True) if not k]
        refs = np.concatenate(search or [np.empty(0, repeats.REF)])
        hashes, back = np.unique(refs["hash"], return_inverse=True)
        times = np.bincount(back, np.where(refs["pos"] < 0, -refs["pos"].astype(np.int64), 1), minlength=len(hashes)).astype(np.int64)
        kept = times >= 8
        yield pa.RecordBatch.from_arrays([pa.array(hashes[kept]), pa.array(times[kept])], ["hash", "places"])


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(length: int, text_col: str, columns: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, hot = b.column("__spans").to_pylist(), b.column("__places").to_pylist()
            rows = []
            for row, end, data, offsets in chunks(b.column(text_col)):
                for d in range(end - row):
                    text = data[offsets[d] : offsets[d + 1]]
                    n, removed, pieces = len(text), 0, 0
                    if spans[row + d] or hot[row + d]:
                        s = np.frombuffer(b"".join(spans[row + d] or []), np.int32).reshape(-1, 2).astype(np.int64)
                        p = repeats.positions(hot[row + d])
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, np.concatenate((s[:, 0], p)), 1)
                        np.add.at(edge, np.concatenate((s[:, 1] + length, p + length)), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        pieces = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        text = text[~gone]
                    rows.append((n, removed, pieces, hashlib.sha256(text.tobytes()).hexdigest(), text.tobytes() if with_text else None))
            made = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [b.column(c) for c in columns] + [pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)][: 4 + with_text]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text)

    return run


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """df(doc_id, text, ...) with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and (with_text) kept_bytes.

    A byte goes if a string of `length` bytes around it starts anywhere else, in the same text or another, overlaps
    included; strings are judged on the input. Texts are their UTF-8 bytes (what is left may not be UTF-8); null is
    empty; shorter texts stay whole. Repeated rows repeat each other. length must be over GRAM.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    df = without(df, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
    keyed = df.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))))
    slim = keyed.select("__key", text_col)
    n = repeats.buckets(df)
    refs = written(slim.mapInArrow(_anchors(length, text_col, n), repeats.SCHEMA), "suffix-refs")
    common = refs.mapInArrow(_count, "hash bigint, places bigint").groupBy("hash").agg(F.sum("places").alias("places")).where(F.col("places") >= HOT_FROM)
    hot = np.array(sorted(r["hash"] for r in common.orderBy(F.desc("places"), "hash").limit(HOT_LIST).collect()), np.int64)
    anchors = written(repeats.repeated(refs), "suffix-anchors")
    near = slim.join(anchors.withColumnRenamed("places", "__places"), "__key")
    shards = near.mapInArrow(_deal(length, text_col, n, hot), FRAGMENT).repartitionById(n, F.col("shard"))
    spans = repeats.by_key(shards.mapInArrow(_shard(length, n), "bucket int, places binary"), pairs=True).withColumnRenamed("places", "__spans")
    spans = written(spans, "suffix-spans")
    out = keyed.join(spans, "__key", "left")
    if len(hot):
        places = written(repeats.repeated(near.mapInArrow(_hot_strings(length, text_col, n, hot), repeats.SCHEMA)), "suffix-hot")
        out = out.join(places.withColumnRenamed("places", "__places"), "__key", "left")
    else:
        out = out.withColumn("__places", F.expr("cast(null as array<binary>)"))
    columns = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns) + ", " + RESULT + ", kept_bytes binary" * with_text
    return out.mapInArrow(_cut(length, text_col, columns, with_text), schema)


def report(documents: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text)."""
    return remove_repeats(documents.select("doc_id", "text"), with_text=False)
