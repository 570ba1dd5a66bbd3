"""Benchmark decontamination: a broadcast hash set of test n-grams, probed by every window of the training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import small_side, written

WINDOW = 10
#: Most windows of the benchmark that are broadcast (two long numbers each); beyond it the join shuffles.
SET_ROWS = 2_000_000
# The words of the contract, and the same runs before A-Z become a-z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORDS})"), F.lit(1))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(hash, n, words, items): the distinct windows of benchmark(item_id, text) and the items that hold them.

    An item of fewer words, but not none, is one window; null and empty items have none. A null item_id stands as ''.
    """
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("hash"), F.size("words").alias("n"), "words", "items")


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs, __n_words, and __hits: verified (pos, n, items) of benchmark windows in the text, by the number of their first word.

    Null has no words. Rows of docs may repeat. Columns of docs stay as they are.
    """
    grams = written(item_windows(benchmark, size), "decontam-grams")
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most `size` numbers
    keyed = docs.withColumn("__words", word_array(F.col(text_col))).withColumn("__n_words", F.size("__words").cast("long"))
    none = F.expr("cast(array() as array<struct<n:int,pos:int,hash:bigint>>)")

    def grams_of(w: Column, n: int) -> Column:
        at = lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.xxhash64(F.slice(w, i + 1, n)).alias("hash"))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), at)).otherwise(none)

    # The words are bound to a lambda variable: else the optimiser puts their expression into each window's.
    hashes = lambda w: F.concat(none, *[grams_of(w, n) for n in lengths])
    probe = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__key"), F.explode_outer(F.transform(F.array(word_array(F.col(text_col))), hashes)[0]).alias("h")).select("__key", "h.*")
    met = probe.join(small_side(grams.select("hash", "n").distinct(), SET_ROWS), ["hash", "n"]).select("__key", "n", "pos", "hash").distinct()
    hits = met.join(small_side(grams), ["hash", "n"]).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "words", "items"))).alias("__hits"))
    hits = written(hits, "decontam-hits").withColumnRenamed("__key", "__hit_key")
    out = keyed.join(small_side(hits, 20_000), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("__hit_key"), "left").drop("__hit_key")
    sure = F.filter(F.col("__hits"), lambda x: F.slice(F.col("__words"), x["pos"] + 1, x["n"]) == x["words"])
    plain = F.transform(sure, lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), x["items"].alias("items")))
    return out.withColumn("__hits", F.coalesce(plain, F.expr("cast(array() as array<struct<pos:int,n:int,items:array<string>>>)"))).drop("__words")


def hit_words() -> Column:
    """Numbers of the words inside any hit, each once."""
    return F.array_distinct(F.flatten(F.transform(F.col("__hits"), lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, drop_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without what the benchmark holds: hit words go from the text, and documents with at least `drop_from` of their words hit go whole.

    Characters between words stay. Documents without a hit, null and empty ones among them, stay unchanged.
    """
    found = find(docs, benchmark, size, text_col).withColumn("__hit", hit_words())
    found = found.where(F.col("__n_words").isNull() | (F.col("__n_words") == 0) | (F.size("__hit") < drop_from * F.col("__n_words")))
    gaps, kept = F.split(text_col, CASED_WORDS, -1), F.regexp_extract_all(F.col(text_col), F.lit(f"({CASED_WORDS})"), F.lit(1))
    cut = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), kept.alias("word")), lambda x, i: F.concat(x["gap"], F.when(F.array_contains(F.col("__hit"), i), "").otherwise(F.coalesce(x["word"], F.lit(""))))), "")
    out = found.withColumn("__cut", F.when(F.size("__hit") > 0, cut).otherwise(F.col(text_col)))
    return out.select(*[F.col("__cut").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text) and benchmark(item_id, text)."""
    found = find(documents.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct(F.flatten(F.col("__hits.items"))))
    out = found.select("doc_id", F.col("__n_words").alias("n_words"), F.size(hit_words()).cast("long").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT p.rid, p.i, s.n, g.item
  FROM p CROSS JOIN (SELECT DISTINCT n FROM g) AS s
  JOIN g ON g.n = s.n AND g.gram = array_to_string(p.w[p.i:p.i + s.n - 1], ' ')
  WHERE p.i + s.n - 1 <= len(p.w)),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
