"""Best-two-fit packing of token sequences.

Pieces are dealt by chance into groups of a fixed number, each packed by itself. In a group,
bins are filled greedily with the largest piece that still fits. Then each bin with a gap
tries to give up its smallest piece for two unpacked ones that together fill the widened
gap more tightly. Piece lengths are small numbers, so groups work on counts by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import without, written

CAPACITY = 2048
#: Pieces packed together: enough that each length finds its partners, few enough for one task.
GROUP = 5_000
#: Texts tokenised in one call hold about so many characters; ids of so many different words are remembered.
BATCH_CHARS, REMEMBERED = 1 << 20, 1_000_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of texts as packed uint32, word by word, each different word encoded once.

    Only for tokenizers whose tokens never reach over a space or newline (white space dropped, words by themselves), as
    independent_words finds out; for others each text is encoded whole. Full stops and commas after a letter, and ASCII
    capitals, do not make a word a different one: such tokenizers split off the former and drop the latter.
    """

    def __init__(self, path: str):
        self.most = REMEMBERED
        self.tok, self.known = _tokenizer(path), {"": b""}
        self.by_word = independent_words(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.most:  # short words come again, long ones hardly do
            short = {k: v for k, v in self.known.items() if len(k) < 6}
            self.known = short if 2 * len(short) < self.most else {"": b""}
        new = {w for s in split for w in s}.difference(self.known)
        if new:
            parts = []
            for w in new:
                base = w.rstrip(".,")
                if not base or not base[-1].lower().isalpha():
                    base = w
                parts.append((w, base.lower() if base.isascii() else base, w[len(base) :]))
            self._learn(list({k for _, *p in parts for k in p}.difference(self.known)))
            for w, base, tail in parts:
                self.known[w] = self.known[base] + self.known[tail] if tail else self.known[base]
        return [b"".join([self.known[w] for w in s]) for s in split]

    def _learn(self, words: list[str]) -> None:
        """Encode words; runs of letters many at a time, since the end of each shows in its last token."""
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(some):
                raw = ids.tobytes()
                self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))
            else:
                rest += some
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has learnt serves its later tasks."""
    return Encoder(path)


@cache
def independent_words(path: str) -> bool:
    """Whether the tokenizer drops white space before it looks at words: no template is added, and its splitter removes what lies between."""
    import json

    spec = json.loads(_tokenizer(path).to_str())
    splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
    first = splitters[0] if splitters else {}
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit") or first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern"))
    lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
    return bool(drops) and lowers and spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>"


def _pieces(path: str, capacity: int, text_col: str, columns: list[str], remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        words.most = remembered
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            row = 0
            while row < len(texts):
                end, size = row, 0
                while end < len(texts) and (end == row or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                out = []
                for i, ids in enumerate(words.ids(texts[row:end]), row):
                    ids += bytes(4)
                    pieces = [ids[s : s + 4 * capacity] for s in range(0, len(ids), 4 * capacity)]
                    out += [(i, k, k * capacity, len(p) // 4, zlib.crc32(p), p) for k, p in enumerate(pieces)]
                at = pa.array([x[0] for x in out], pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in columns] + [pa.array([x[k + 1] for x in out], t) for k, t in enumerate(kinds)], [*columns, "piece", "start", "length", "ids_crc32", "ids"])
                row = end

    return run


def tokenised(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, text_col: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece of each document: its other columns, piece, start, length, ids_crc32 and (keep_ids) ids, packed as uint32.

    A document is its token ids and an id 0 after them; null is an empty text. Only longer ones are cut, into full pieces and a rest.
    A worker remembers the ids of about `remembered` words (some 200 bytes each) as long as it lives; fewer take more time.
    """
    df = without(df, "piece", "start", "length", "ids_crc32", "ids")
    columns = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns) + ", piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    out = df.mapInArrow(_pieces(tokenizer, capacity, text_col, columns, remembered), schema)
    return out if keep_ids else out.drop("ids")


class Lengths:
    """How many pieces of each length are unpacked; finds the longest of at most so much."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.mask = 0
        for n in np.flatnonzero(counts).tolist():
            self.mask |= 1 << n

    def fit(self, room: int) -> int:
        """The longest unpacked length <= room, 0 if there is none."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.mask & ((1 << (room + 1)) - 2) else 0

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.mask &= ~(1 << n)

    def give(self, n: int) -> None:
        self.counts[n] += 1
        self.mask |= 1 << n

    def pair(self, room: int, over: int) -> tuple[int, int]:
        """Two unpacked lengths whose sum is the most that fits into room and is over `over`; (0, 0) if there is none."""
        best, pair, a = over, (0, 0), self.fit(room - 1)
        while a and 2 * a > best:
            self.take(a)
            b = self.fit(min(room - a, a))
            self.give(a)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = self.fit(a - 1)
        return pair


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths, each of capacity at most: greedy, largest first, then one-for-two exchanges."""
    left, bins = Lengths(np.bincount(lengths, minlength=capacity + 1)), []
    while n := left.fit(capacity):
        held, room = [], capacity
        while n:
            left.take(n)
            held.append(n)
            room -= n
            n = left.fit(room)
        if room and len(held) > 1:
            small = held[-1]
            a, b = left.pair(room + small, small)
            if a:
                held[-1:] = [a, b]
                left.take(a)
                left.take(b)
                left.give(small)
        bins.append(held)
    return bins


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__order"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        queue = np.searchsorted(lengths, np.arange(capacity + 2)).tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, held in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for n in held:
                seq[queue[n]], off[queue[n]] = k, at
                queue[n] += 1
                at += n
        pdf["sequence_id"] = pdf["__group"] * 4_194_304 + seq
        pdf["offset"] = off
        return pdf

    return run


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset. Pieces of length 0 or over the capacity are not allowed.

    pieces must be a written table: its row numbers deal the pieces over n_pieces / group groups, n_pieces being about how many
    there are, so that no group grows with the data or with repeated rows.
    """
    pieces = without(pieces, "sequence_id", "offset")
    groups = max(1, round(n_pieces / group))
    dealt = pieces.withColumn("__order", F.monotonically_increasing_id()).withColumn("__group", F.pmod(F.xxhash64("__order"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("__group").applyInPandas(_pack(capacity), schema).drop("__order", "__group")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The query's columns for documents(doc_id, text)."""
    pieces = written(tokenised(documents.select("doc_id", "text"), tokenizer or public_tokenizer(), keep_ids=False), "packing-pieces")
    return pack(pieces, pieces.count())
